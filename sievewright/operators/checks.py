"""Surface checks of descriptions against the fields they state, and texts that must survive normalisation (inventory K02 to K05, K15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewright.functions import text

_NONE = "array<string>"
# Subtypes by which an enchantment is known, and the colour names.
ENCHANTMENT_KINDS = ("Aura", "Saga", "Class", "Case", "Room", "Shrine", "Curse", "Background")
COLOR_NAMES = {"W": "white", "U": "blue", "B": "black", "R": "red", "G": "green"}


def said(word: Column, joined: Column) -> Column:
    """Whether a type word occurs among words joined by blanks, in itself or in its plural."""
    w = text.words(F.regexp_replace(word, r"^[,.;]+|[,.;]+$", ""))
    plural = F.when(F.endswith(w, F.lit("y")), F.regexp_replace(w, "y$", "ies")).when(F.endswith(w, F.lit("s")), F.concat(w, F.lit("es"))).otherwise(F.concat(w, F.lit("s")))
    return text.holds_phrase(joined, w) | text.holds_phrase(joined, plural)


def description_issues(description: Column, style: Column, target: str = "target") -> Column:
    """Sorted distinct codes of what a description lacks or gives away of the fields of its `target`.

    A cost must be stated as written, stats as power/toughness; each type word must be said unless something said implies it.
    The sparse styles must not tell a cost or stats that their target has not. Null descriptions have null issues.
    """
    t = lambda f: F.col(f"{target}.{f}")
    kind = F.coalesce(t("type_line"), F.lit(""))
    subtypes = F.when(F.contains(kind, F.lit(" — ")), F.filter(F.split(F.substring_index(kind, " — ", -1), r"\s+"), lambda w: w != "")).otherwise(F.array().cast(_NONE))
    sparse = style.isin("minimal", "concept")

    def issues(read: Column) -> Column:
        joined, stats, kinds = read["joined"], read["stats"], read["subtypes"]
        told = lambda w: said(F.lit(w), joined)
        implied = stats | (F.contains(kind, F.lit("Creature")) & (F.size(kinds) > 0) & F.forall(kinds, lambda w: said(w, joined))) | description.rlike(r"(?i)\b(?:flyer|flier)s?\b")
        named = F.exists(F.array(*map(F.lit, ENCHANTMENT_KINDS)), lambda k: F.array_contains(kinds, k) & said(k, joined))
        excused = lambda w: (
            ((w == "Creature") & implied) | ((w == "Planeswalker") & told("walker")) | ((w == "Enchantment") & named)
            | ((w == "Artifact") & (description.rlike(r"(?i)\bmana rocks?\b") | (F.array_contains(kinds, "Equipment") & told("Equipment"))))
        )
        words = F.filter(F.split(kind, r"\s+|—|//"), lambda w: (w != "") & ~said(w, joined))  # the excuses only of what is not said
        missing = F.transform(F.filter(words, lambda w: ~excused(w)), lambda w: F.concat(F.lit("missing_type_word:"), w))
        single = F.array_compact(F.array(
            F.when((t("mana_cost") != "") & ~F.array_contains(read["costs"], t("mana_cost")), F.concat(F.lit("missing_or_changed_mana_cost:"), t("mana_cost"))),
            F.when(t("power").isNotNull() & ~F.contains(F.replace(description, F.lit(" ")), F.concat(t("power"), F.lit("/"), F.coalesce(t("toughness"), F.lit("")))), F.lit("missing_or_changed_stats")),
            F.when(sparse & t("mana_cost").isNull() & description.rlike(r"\{[^}]+\}"), F.lit("detail_level_leaked_mana_cost")),
            F.when(sparse & t("power").isNull() & stats, F.lit("detail_level_leaked_exact_stats")),
            F.when((F.length(description) > 12000) | (F.trim(description) == ""), F.lit("invalid_description_length")),
        ))
        return F.array_sort(F.array_distinct(F.concat(single, missing)))

    # What several checks read is bound by an outer transform, or each of them would read the description again.
    read = F.struct(
        text.words(description).alias("joined"), description.rlike(r"\b[0-9]+\s*/\s*[0-9]+\b").alias("stats"), subtypes.alias("subtypes"),
        F.regexp_extract_all(description, F.lit(r"(?:\{[0-9A-Z/]+\})+"), F.lit(0)).alias("costs"),
    )
    return F.when(description.isNotNull(), F.transform(F.array(read), issues)[0])


def name_leak(description: Column, name: Column, type_line: Column, colors: Column, rules: Column) -> Column:
    """Whether a description tells the source's name, other than as vocabulary of the target.

    Names of up to four characters, names made of the type's words and colours, names that the type or rules text uses and
    the noun for regenerating leak nothing.
    """
    needle, said_words = text.words(name), text.words(description)
    own = F.concat(F.split(text.words(F.coalesce(type_line, F.lit(""))), " "), F.coalesce(F.transform(colors, lambda c: F.create_map(*(F.lit(x) for p in COLOR_NAMES.items() for x in p))[c]), F.array().cast(_NONE)))
    ordinary = F.size(F.array_except(F.split(needle, " "), own)) == 0
    used = text.holds_phrase(text.words(F.coalesce(type_line, F.lit(""))), needle) | text.holds_phrase(text.words(F.coalesce(rules, F.lit(""))), needle)
    alias = (needle == "regeneration") & F.coalesce(rules.rlike(r"(?i)\bregenerate\b"), F.lit(False))
    return F.coalesce((F.length(name) > 4) & (needle != "") & text.holds_phrase(said_words, needle) & ~ordinary & ~used & ~alias, F.lit(False))


def admission(review: Column, issues: Column, controls: Column, valid: Column) -> tuple[Column, Column]:
    """(route, sorted reasons): accepted only if the review passed, there is no issue, the controls hold and the schema does; else quarantined."""
    no = lambda c, why: F.when(~F.coalesce(c, F.lit(False)), F.lit(why))
    reasons = F.array_sort(F.array_compact(F.concat(F.coalesce(issues, F.array(F.lit("no_description"))), F.array(no(review, "review_not_passed"), no(controls, "controls_failed"), no(valid, "invalid_schema")))))
    return F.when(F.size(reasons) == 0, "accepted").otherwise("quarantined"), reasons


def canonical_target(reviewed: Column, bare_status: Column, whole_status: Column, bare_meaning: Column, meaning: Column) -> tuple[Column, Column]:
    """(text, policy) of a reviewed text that should lose its reminders.

    `absent`: it has none; `removed`: without them it is still read and means the same; `retained_for_parser`: it is only read
    with them; else null with the policy `unreadable` or `changed_meaning`. The statuses and meanings are a parser's, of the
    text without and with reminders.
    """
    bare = text.without_parentheses(reviewed)
    drops = F.coalesce(bare != reviewed, F.lit(True))
    kept = (bare_status == "rejected") & drops
    policy = F.when(~drops, "absent").when(kept, "retained_for_parser").otherwise("removed")
    status, same = F.when(kept, whole_status).otherwise(bare_status), kept | (bare_meaning == meaning)
    final = F.when(F.coalesce(status, F.lit("")) != "parsed", "unreadable").when(~F.coalesce(same, F.lit(False)), "changed_meaning").otherwise(policy)
    return F.when(final == "retained_for_parser", reviewed).when(final.isin("absent", "removed"), bare), final
