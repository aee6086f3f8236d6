"""Text that looks the same but differs in its characters (problem 5).

The skeleton of a text is its decomposition with every character replaced by the prototype of its look-alikes,
decomposed again. Originals with equal skeletons look equal. The plain form of a text is read off its skeleton: the
prototypes, composed, in the alphabet of each word. A text that is not its own plain form is a case.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other alphabets that look like Latin ones, each with its Latin prototype.
CYRILLIC = dict(zip("абвгдезийклмнопрстухѕіјһԁԛԝүѵАВЕЅІЈКМНОРСТУХԚԜӀҮԌԐ", "aбвгдeзийклмнoпpcтyxsijhdqwyvABESIJKMHOPCTYXQWIYGE"))
GREEK = dict(zip("αγικνορτυχωϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ayiкvopтuxwcjABEZHIKMNOPTYXCJ"))
ARMENIAN = dict(zip("ոօսհզցյաՍՏՕ", "nouhqgjwUSO"))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏎᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴᏵ", "DRTiAJEWMHGZ4RWSVSLCPKBG"))
COPTIC = dict(zip("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲥⲣ", "ABEHIKMNOPCTYXocp"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
OTHER = {"ı": "i", "ɑ": "a", "ɡ": "g", "ʏ": "y"}
#: Look-alike letters with their prototype in another alphabet; letters that stand for themselves are left out.
LETTERS = {a: b for a, b in (CYRILLIC | GREEK | ARMENIAN | CHEROKEE | COPTIC | LISU | OTHER).items() if a != b}
# Ordinary characters that look alike among themselves, for the grouping by skeleton only.
ALIKE, ALIKE_TO, PAIR, PAIR_TO = "01I|", "Olll", "m", "rn"
#: Signs that look like the hyphen. Dashes are signs of their own.
HYPHENS = set("‐‑⁃˗﹣－")
#: Invisible though of no format category: fillers and variation selectors.
FILLERS = {"\u034f", "\u115f", "\u1160", "\u17b4", "\u17b5", "\u3164", "\uffa0", "\u2800"}
#: Signs beyond ASCII that stand for themselves.
PLAIN_SIGNS = "‘’“”–—•…"
LINE_AND_TAB = set("\t\n\r")
#: Kinds of compatibility decomposition that change the look of a character but not what it says.
WIDTHS = ("<wide>", "<narrow>", "<font>")


@lru_cache(maxsize=65536)
def invisible(ch: str) -> bool:
    """Format characters, fillers, variation selectors and control characters other than tab and line ends."""
    kind = unicodedata.category(ch)
    return kind == "Cf" or ch in FILLERS or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF or (kind == "Cc" and ch not in LINE_AND_TAB)


@lru_cache(maxsize=65536)
def blank(ch: str) -> bool:
    """Blanks other than the ordinary one."""
    return unicodedata.category(ch) in ("Zs", "Zl", "Zp") and ch != " "


@lru_cache(maxsize=65536)
def unfolded(ch: str) -> str:
    """The ordinary-width, unjoined form of one character; itself if it has none."""
    kind, _, _ = unicodedata.decomposition(ch).partition(" ")
    if kind in WIDTHS:
        return unicodedata.normalize("NFKC", ch)
    if kind == "<compat>" and unicodedata.category(ch)[0] == "L":
        return unicodedata.normalize("NFKC", ch)
    return ch


@lru_cache(maxsize=65536)
def simple(ch: str) -> str:
    """What stays of one character besides its alphabet: no odd blank, hyphen, width or joined letter."""
    if invisible(ch):
        return ""
    if blank(ch):
        return " "
    if ch in HYPHENS:
        return "-"
    return unfolded(ch)


@lru_cache(maxsize=65536)
def prototype(ch: str) -> str:
    """The look-alike prototype of one decomposed character."""
    return "".join(LETTERS.get(c, c) for c in simple(ch))


def read_table(path: str) -> dict[str, str]:
    """Look-alikes of a file in the format of Unicode's table of confusables: code points; code points of the prototype; comment.

    Only letters beyond ASCII count, of which the prototype is letters too; add them to LETTERS before any use.
    """
    made = {}
    with open(path, encoding="utf-8-sig") as lines:
        for line in lines:
            parts = line.split("#")[0].split(";")
            if len(parts) > 1:
                a, b = ("".join(chr(int(c, 16)) for c in p.split()) for p in parts[:2])
                if len(a) == 1 and a > "\x7f" and unicodedata.category(a)[0] == "L" and b.isalpha() and a != b:
                    made[a] = b
    return made


@lru_cache(maxsize=65536)
def alphabet(ch: str) -> str:
    """The alphabet of a letter by the first word of its name, '' for all else."""
    if unicodedata.category(ch)[0] != "L":
        return ""
    return unicodedata.name(unfolded(ch)[:1], "").split(" ")[0]


def skeleton(text: str) -> str:
    """Decompose, replace every character by its prototype, decompose again."""
    decomposed = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFD", "".join(map(prototype, decomposed)))


def words(text: str) -> list[str]:
    """Runs of letters, digits and the marks that go with them, and the runs between, in order."""
    parts, inside, at = [], None, 0
    for i, ch in enumerate(text):
        now = unicodedata.category(ch)[0] in "LNM"
        if inside is not None and now != inside:
            parts.append(text[at:i])
            at = i
        inside = now
    return [*parts, text[at:]] if text else []


def mixed(word: str) -> bool:
    """Whether the letters of a word are of more than one alphabet."""
    return len({a for a in map(alphabet, word) if a}) > 1


def own_alphabet(word: str) -> str:
    """The alphabet of a word: its only one, or that of most of its letters without look-alikes; else Latin."""
    kinds = {a for a in map(alphabet, word) if a}
    if len(kinds) < 2:
        return min(kinds, default="")
    own: dict[str, int] = {}
    word = unicodedata.normalize("NFD", word)
    for ch in word:
        if (a := alphabet(ch)) and ch not in LETTERS and a != "LATIN":
            own[a] = own.get(a, 0) + 1
    latin = sum(alphabet(c) == "LATIN" for c in word)
    return max(own, key=lambda a: (own[a], a)) if own and max(own.values()) > latin else "LATIN"


@lru_cache(maxsize=64)
def members(target: str) -> dict[str, str]:
    """The letter of an alphabet for each prototype that one of its letters has."""
    return {b: a for a, b in reversed(LETTERS.items()) if alphabet(a) == target}


def in_alphabet(ch: str, target: str) -> str:
    """A decomposed character in the alphabet of its word: itself, or its prototype there."""
    if alphabet(ch) in ("", target):
        return simple(ch)
    return "".join(members(target).get(c, c) for c in prototype(ch))


def plain_form(text: str) -> str:
    """The skeleton's prototypes, composed, each word in its own alphabet: one consistent form of all that looks alike.

    Marks that no letter of Latin, Greek or Cyrillic takes in are dropped. What one step leaves may have another alphabet as
    its own, Latin at last, so steps go on until nothing changes, which takes two or three.
    """
    for _ in range(8):
        if (made := one_step(text)) == text:
            break
        text = made
    return text


def one_step(text: str) -> str:
    flat = unicodedata.normalize("NFC", "".join(map(simple, text)))
    made = []
    for w in words(flat):
        target = own_alphabet(w)
        made.append(unicodedata.normalize("NFC", "".join(in_alphabet(c, target) for c in unicodedata.normalize("NFD", w))))
    out = "".join(made)
    return "".join(ch for i, ch in enumerate(out) if not loose_mark(out, i))


def loose_mark(text: str, i: int) -> bool:
    """Whether a combining mark stands after a letter that has no single character with it."""
    if unicodedata.category(text[i]) != "Mn":
        return False
    while i and unicodedata.category(text[i]) == "Mn":
        i -= 1
    return text[i].isalpha() and alphabet(text[i]) in ("LATIN", "CYRILLIC", "GREEK")


def look_key(skeletons: Column) -> Column:
    """Digest of what a skeleton looks like: ordinary characters that look alike among themselves are one."""
    return F.sha2(F.replace(F.translate(skeletons, ALIKE, ALIKE_TO), F.lit(PAIR), F.lit(PAIR_TO)), 256)


def lookalike_forms(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Skeleton and plain form of each named text column of `df`, one row per row and field that is not null.

    Columns: `id`, `field_name`, `original`, `skeleton`, `form`, `is_case`. A text of printable ASCII, tabs, line ends
    and the signs of PLAIN_SIGNS is its own skeleton and form and never leaves the JVM. Any other is a case if it is not the
    form that its skeleton gives, or if that still has words of two alphabets for want of look-alikes. Null fields give no row, empty ones are plain.
    """

    @F.pandas_udf("skeleton string, form string, is_case boolean")
    def forms(texts: pd.Series) -> pd.DataFrame:
        made = [(skeleton(t), plain_form(t)) for t in texts]
        return pd.DataFrame([(s, f, f != t or any(map(mixed, words(f)))) for t, (s, f) in zip(texts, made)], columns=["skeleton", "form", "is_case"])

    long = df.select(
        F.col(id_col).alias("id"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("original")) for f in fields))).alias("x"),
    ).select("id", "x.field_name", F.make_valid_utf8("x.original").alias("original")).filter("original is not null")
    odd = F.col("original").rlike(rf"[^\t\n\r\x20-\x7E{PLAIN_SIGNS}]")
    made = long.filter(odd).withColumn("f", forms("original")).select("id", "field_name", "original", "f.skeleton", "f.form", "f.is_case")
    plain = long.filter(~odd).select("id", "field_name", "original", F.col("original").alias("skeleton"), F.col("original").alias("form"), F.lit(False).alias("is_case"))
    return made.unionByName(plain)


def lookalike_groups(forms: DataFrame) -> DataFrame:
    """Originals with an equal skeleton: one row per field and skeleton that has several originals or a case.

    Hot skeletons are aggregated in part before the shuffle; distinct originals are counted on a second level.
    """
    key = look_key(F.col("skeleton")).alias("skeleton_key")
    per = forms.groupBy("field_name", key, F.sha2("original", 256).alias("o")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("is_case").alias("has_case"), F.min("form").alias("form")
    )
    return (
        per.groupBy("field_name", "skeleton_key")
        .agg(F.count(F.lit(1)).alias("originals"), F.sum("n").alias("fields"), F.min("first_id").alias("first_id"), F.max("has_case").alias("has_case"), F.min("form").alias("form"))
        .filter("originals > 1 or has_case")
    )
