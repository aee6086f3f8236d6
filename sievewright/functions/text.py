"""Text normalisation as column expressions; pandas UDFs only where a dynamic pattern or NFKC needs them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters, digits and signs that count in a description key (portable class: the same in Java and RE2).
KEY_CHARS = r"\p{L}\p{N}_{}/*+\-"


def fold(text: Column) -> Column:
    """Lower case with sharp s written out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def description_key(text: Column) -> Column:
    """Key under which descriptions are the same: other characters and blanks become one blank."""
    return F.trim(F.regexp_replace(fold(text), f"[^{KEY_CHARS}]+", " "))


def whitespace_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def compatibility_key(text: Column) -> Column:
    """NFKC, case folded, punctuation dropped, blanks collapsed; null stays null. ASCII texts stay in the JVM."""

    @F.pandas_udf("string")
    def key(texts: pd.Series) -> pd.Series:
        drop = re.compile(r"[^\w{}/*+\- ]+")
        return texts.map(lambda t: None if t is None else " ".join(drop.sub(" ", unicodedata.normalize("NFKC", t).casefold()).split()), na_action="ignore")

    ascii_only = text.rlike(r"^[\x00-\x7F]*$")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_{}/*+\- ]+", " "), " +", " "))
    return F.when(ascii_only, plain).otherwise(key(F.when(~ascii_only, text)))


def strip_lines(text: Column) -> Column:
    """Without blanks at line ends and around the whole."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\r]+\n", "\n"), r"^\s+|\s+$", "")


def without_parentheses(text: Column) -> Column:
    """Balanced parentheses removed with what they hold; null where they do not balance.

    Each round removes the innermost pairs, and there are at most as many rounds as opening ones.
    """
    opened = F.length(F.regexp_replace(text, r"[^(]", ""))
    bare = F.aggregate(F.sequence(F.lit(0), opened), text, lambda t, _: F.regexp_replace(t, r"\([^()]*\)", ""))
    return F.when(~bare.rlike(r"[()]"), strip_lines(bare))


def replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """Only the first match is replaced; groups of `pattern` count from $2 in `replacement`."""
    return F.regexp_replace(text, f"(?s)^(.*?){pattern}", f"$1{replacement}")


def words(text: Column) -> Column:
    """Words in lower case joined by single blanks."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")


def holds_phrase(joined: Column, phrase: Column) -> Column:
    """Whether words joined by blanks hold the words of `phrase` in a row."""
    return F.contains(F.concat(F.lit(" "), joined, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def mentioned(word: Column, joined: Column) -> Column:
    """Whether a word occurs, in itself or in a plural form."""
    w = F.lower(word)
    forms = F.array(w, F.concat(w, F.lit("s")), F.concat(w, F.lit("es")), F.regexp_replace(w, "y$", "ies"))
    return F.exists(forms, lambda f: holds_phrase(joined, f))


def bind_names(text: Column, own: Column, others: Column | None = None, placeholder: str = "CARDNAME") -> Column:
    """A record's own name, full or short, and the names of its other sides replaced in its text; what follows `named` stays.

    `others`: array of (`name`, `alias`). Longer names go first, one after another, and a name inside a longer word stays. The
    short form of a name is what comes before its first comma. The short form of another side's name counts as the own one
    if the own name begins with it. Null texts stay null, null and empty names name nothing; the characters U+0001 and
    U+0002 are dropped.
    """
    pair = lambda name, alias: F.struct(name.alias("name"), alias.alias("alias"))
    short = lambda name: F.split(name, ",")[0]
    pairs = F.array(pair(own, F.lit(placeholder)), pair(short(own), F.lit(placeholder)))
    if others is not None:
        begins = lambda n: F.contains(n, F.lit(",")) & (F.startswith(own, F.concat(short(n), F.lit(" "))) | F.startswith(own, F.concat(short(n), F.lit(","))))
        shared = F.transform(F.filter(others, lambda o: begins(o["name"])), lambda o: pair(short(o["name"]), F.lit(placeholder)))
        pairs = F.concat(pairs, F.coalesce(others, F.array().cast("array<struct<name:string,alias:string>>")), F.coalesce(shared, F.array().cast("array<struct<name:string,alias:string>>")))
    named = F.filter(pairs, lambda p: F.coalesce(p["name"], F.lit("")) != "")
    ordered = F.array_sort(F.transform(named, lambda p: F.struct((-F.length(p["name"])).alias("n"), p["name"].alias("name"), p["alias"].alias("alias"))))
    pattern = lambda name: F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    replaced = lambda part: F.aggregate(ordered, part, lambda t, p: F.regexp_replace(t, pattern(p["name"]), p["alias"]))
    # Clauses that stay are put between two signs, so that each part holds at most one, at its beginning.
    marked = F.regexp_replace(F.translate(text, "\x01\x02", ""), r"(?U)(\bnamed\s+[^.\n;]+)", "\x01$1\x02")
    parts = F.transform(F.split(marked, "\x01"), lambda p: F.when(F.contains(p, F.lit("\x02")), F.concat(F.substring_index(p, "\x02", 1), replaced(F.substring_index(p, "\x02", -1)))).otherwise(replaced(p)))
    return F.array_join(parts, "")


# Older wordings and their present form.
MODERN = [
    ("comes into play", "enters"),
    ("come into play", "enter"),
    ("enters the battlefield", "enters"),
    ("enter the battlefield", "enter"),
    ("leaves play", "leaves the battlefield"),
    ("his or her", "their"),
    ("he or she", "they"),
    ("to your mana pool", ""),
]
# The types by which a text names its own record.
SELF_TYPES = ["creature", "artifact", "enchantment", "land", "planeswalker", "battle", "aura"]


def wording_signature(text: Column, type_line: Column) -> Column:
    """What must agree for two wordings to be taken as one; null where parentheses do not balance."""
    t = F.lower(F.translate(without_parentheses(text), "−’“”", "-'\"\""))
    for kind in SELF_TYPES:
        t = F.when(F.contains(F.lower(type_line), F.lit(kind)), F.replace(t, F.lit(f"this {kind}"), F.lit("cardname"))).otherwise(t)
    for old, new in MODERN:
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.regexp_replace(t, r"""[^\p{L}\p{N}_{}/*+\-.,:;!?"'\n]+""", " ")
    t = F.regexp_replace(F.regexp_replace(t, " *\n[ \n]*", "\n"), r" +([.,:;!?])", "$1")
    return F.trim(t)


# The wording rules in their order, by name, pattern and replacement; the one without a pattern is `renowned_self`.
WORDING_RULES = [
    ("enters", r"\b([Ee]nters?) the battlefield\b", "$1"),
    ("quotes", "[“”]", '"'),
    ("loyalty-minus", r"(?m)^(\[?)-([0-9X]+\]?:)", "$1−$2"),
    ("renowned-self", None, None),
    (
        "sacrifice-choice",
        r"\b((?:[Ee]ach (?:player|opponent)|[Tt]arget (?:player|opponent)|[Tt]hat player) sacrifices (?:a (?:nonland permanent|creature or planeswalker|creature|permanent|land)|an (?:artifact|enchantment)))([.,])",
        "$1 of their choice$2",
    ),
    (
        "owner-choice",
        r"((?:[Tt]he owner of target (?:nonland permanent|permanent|creature)|[Ii]ts owner) puts it on) the top or bottom of their library",
        "$1 their choice of the top or bottom of their library",
    ),
]


def renowned_self(text: Column, name: Column, type_line: Column) -> Column:
    """A creature's own name at the start of a line outside quotes, where it is said to be renowned."""
    lines = F.split(text, "\n")
    quotes = lambda before: F.length(F.regexp_replace(F.array_join(before, ""), "[^\"“”]", ""))
    prefix = F.concat(F.lit("As long as "), name, F.lit(" is renowned,"))
    changed = lambda line: F.concat(F.lit("As long as this creature is renowned,"), F.substring(line, F.length(prefix) + 1, F.length(line)))
    made = F.transform(lines, lambda line, i: F.when(F.startswith(line, prefix) & (quotes(F.slice(lines, F.lit(1), i)) % 2 == 0), changed(line)).otherwise(line))
    creature = F.array_contains(F.split(F.split(type_line, "—")[0], " "), "Creature")
    return F.when(F.coalesce(creature & (name != ""), F.lit(False)), F.array_join(made, "\n")).otherwise(text)


def normalize_wording(text: Column, rules: list[tuple] = WORDING_RULES, name: Column | None = None, type_line: Column | None = None) -> tuple[Column, Column]:
    """The text after all rules in order, and the names of the rules that changed it. Null texts are changed by none."""
    steps, at = [], text
    for rule, pattern, replacement in rules:
        if pattern is None:
            after = at if name is None or type_line is None else renowned_self(at, name, type_line)
        else:
            after = F.regexp_replace(at, pattern, replacement)
        steps.append(F.when(after != at, F.lit(rule)))
        at = after
    return at, F.array_compact(F.array(*steps))


def colors_of(cost: Column) -> Column:
    """Colour letters of a cost in the usual order."""
    return F.filter(F.array(*map(F.lit, "WUBRG")), lambda c: F.contains(cost, c))


def mana_value(cost: Column) -> Column:
    """Sum over symbols: the largest number in one, else one; three if any symbol is a variable."""
    symbols = F.regexp_extract_all(cost, F.lit(r"\{([^}]+)\}"), F.lit(1))
    number = lambda s: F.coalesce(F.array_max(F.transform(F.split(s, "/"), lambda p: F.when(p.rlike("^[0-9]+$"), p).try_cast("int"))), F.lit(1))
    return F.when(F.exists(symbols, lambda s: s.isin("X", "Y", "Z")), 3).otherwise(F.aggregate(symbols, F.lit(0), lambda a, s: a + number(s)))


def family_key(layout: Column, text: Column) -> Column:
    """JSON text whose digest names a family: numbers, symbols and colours do not tell members apart."""
    t = F.regexp_replace(text, r"\{[^}]+\}|[0-9]+|\b(?:one|two|three|four|five|six|seven|eight|nine|ten)\b", "#")
    t = F.regexp_replace(t, r"\b(?:white|blue|black|red|green)\b", "COLOR")
    from sievewright.functions.canon import json_list

    return json_list(layout, F.trim(F.regexp_replace(F.lower(t), r"\s+", " ")))


# Card types and rule patterns that make up the features of a record.
CARD_TYPES = [
    "artifact", "battle", "conspiracy", "creature", "dungeon", "enchantment", "instant", "kindred",
    "land", "phenomenon", "plane", "planeswalker", "scheme", "sorcery", "vanguard",
]
FEATURE_PATTERNS = {
    "loyalty_positive": r"(?m)^\+[0-9]+:",
    "loyalty_negative": r"(?m)^[−-][0-9]+:",
    "loyalty_zero": r"(?m)^0:",
    "loyalty_variable": r"(?m)^[+−-]?X:",
    "rummage": r"(?i)discard.*then draw",
    "loot": r"(?i)draw.*then discard",
    "opponent_library": r"(?i)opponent(?:'s|s’|s')? librar",
    "modal": r"•",
    "replacement": r"(?i)\binstead\b",
    "alternate_win": r"(?i)\bwin the game\b",
    "alternate_loss": r"(?i)\blose the game\b",
    "extra_turn": r"(?i)\bextra turn",
    "copy": r"(?i)\bcopy\b",
    "mana": r"(?i)\badd \{",
    "token": r"(?i)\btoken\b",
    "counter": r"(?i)\bcounter\b",
    "exile": r"(?i)\bexile\b",
}


def features(layout: Column, type_line: Column, text: Column, colors: Column, keywords: Column | None = None) -> Column:
    """Tagged features of a side of a record: keywords, layout, types, ability words, rule patterns, colours.

    Headings before a dash are ability words only if they are among the `keywords`.
    """
    none = F.array().cast("array<string>")
    words = F.transform(F.coalesce(keywords, none), F.lower) if keywords is not None else none
    headings = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^([A-Za-z][A-Za-z ,'-]{1,45}) — "), F.lit(1)), F.lower)
    kinds = F.filter(F.split(F.lower(F.split(type_line, "—")[0]), r"\s+"), lambda w: w.isin(CARD_TYPES))
    found = [F.when(text.rlike(p), F.lit(f"pattern:{k}")) for k, p in FEATURE_PATTERNS.items()]
    ordered = F.filter(F.array(*map(F.lit, "WUBRG")), lambda c: F.array_contains(F.coalesce(colors, none), c))
    bucket = F.when(F.size(ordered) == 0, "colorless").when(F.size(ordered) > 1, "multicolor").otherwise(F.get(ordered, F.lit(0)))
    combination = F.when(F.size(ordered) == 0, "C").otherwise(F.array_join(ordered, ""))
    tagged = lambda tag, values: F.transform(F.coalesce(values, none), lambda w: F.concat(F.lit(tag), w))
    single = F.array(
        F.concat(F.lit("layout:"), F.coalesce(layout, F.lit("normal"))), *found, F.concat(F.lit("color_bucket:"), bucket), F.concat(F.lit("color_combination:"), combination)
    )
    parts = [tagged("keyword:", words), F.array_compact(single), tagged("type:", kinds), tagged("ability_word:", F.array_intersect(F.coalesce(headings, none), words)), tagged("color:", ordered)]
    return F.array_distinct(F.concat(*parts))


# Corruptions of a text in their order: kind, pattern (its groups count from $2), replacement of the first match.
CORRUPTIONS = [
    ("trigger_comma", r"\b((?:When|Whenever)[^\n,.]+), ", "$2 "),
    ("activation_colon", r"(\}): ", "$2 "),
    ("flying_typo", r"\bFlying\b", "Flyng"),
    ("vigilance_typo", r"\bVigilance\b", "Vigilence"),
    ("draw_grammar", r"\b[Dd]raw a card\b", "draws one card"),
    ("old_enters_wording", r"\b(CARDNAME) enters\b", "$2 comes into play"),
    ("tap_words", r"\{T\}", "Tap"),
    ("loyalty_colon", r"(?m)^([+−-]?[0-9]+): ", "$2 "),
    ("loyalty_words", r"(?m)^\+([0-9]+): ", "plus $2: "),
    ("scry_grammar", r"\b[Ss]cry ([0-9]+)\b", "look at the top $2 cards and scry them"),
    ("counter_grammar", r"\ba \+1/\+1 counter\b", "one +1/+1 counters"),
    ("create_grammar", r"\b[Cc]reate (a|two)\b", "make $2"),
]


def corruptions(text: Column, name: Column | None = None, kinds: list[tuple[str, str, str]] = CORRUPTIONS) -> Column:
    """Every corruption that changes the text, as an array of (kind, text); with a `name` also the first word of it for the placeholder.

    A name of one word, or with a comma, is not shortened.
    """
    made = [F.struct(F.lit(k).alias("kind"), replace_first(text, p, r).alias("text")) for k, p, r in kinds]
    if name is not None:
        short = F.when(F.contains(name, F.lit(" ")) & ~F.contains(name, F.lit(",")), F.replace(text, F.lit("CARDNAME"), F.substring_index(name, " ", 1)))
        made.append(F.struct(F.lit("short_self_reference").alias("kind"), short.alias("text")))
    return F.filter(F.array(*made), lambda m: m["text"] != text)


def word_windows(n: Column, width: int = 480, stride: int = 448) -> Column:
    """First places of overlapping windows over `n` tokens; the last one reaches the end. No token, no window."""
    count = F.greatest(F.ceil((n - width) / stride) + 1, F.lit(1))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1), lambda i: i * stride))


#: Parts of composed names, sixteen of each.
PARTS = [
    "Amber Birch Cinder Dawn Ember Fallow Gale Harrow Iron Juniper Kestrel Linden Marrow Nettle Onyx Plover".split(),
    "Ash Brook Crag Dell Elm Fen Glen Heath Isle Knoll Lea Moor Nook Peak Ridge Shore".split(),
    "Archer Brewer Carver Drover Envoy Forger Gleaner Herald Joiner Keeper Lancer Miller Notary Painter Reaper Scribe".split(),
]


def composed_name(number: Column) -> Column:
    """A name of three parts, each chosen by four bits of a number."""
    part = lambda i, words: F.element_at(F.array(*map(F.lit, words)), (F.floor(number / 16**i) % 16 + 1).cast("int"))
    return F.concat_ws(" ", *(part(i, p) for i, p in enumerate(PARTS)))


def map_strings(value: Column, kind: T.DataType, f: Callable[[Column], Column]) -> Column:
    """A nested value with `f` applied to every string in it; nulls stay null."""
    if isinstance(kind, T.StringType):
        return f(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: map_strings(x, kind.elementType, f))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(map_strings(value[c.name], c.dataType, f).alias(c.name) for c in kind.fields)))
    return value


def pooled(vectors: Column, dimensions: int) -> Column:
    """The mean of an array of vectors, brought to length 1; no vectors, or a mean of zero, give null."""
    mean = lambda k: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + F.get(v, F.lit(k))) / F.size(vectors)
    means = F.array(*(mean(k) for k in range(dimensions)))
    scaled = lambda m: F.transform(m, lambda x: x / F.nullif(F.sqrt(F.aggregate(m, F.lit(0.0), lambda s, y: s + y * y)), F.lit(0.0)))
    return F.when(F.size(vectors) > 0, F.transform(F.array(means), scaled)[0])
