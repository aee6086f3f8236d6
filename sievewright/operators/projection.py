"""Records as drafts of their sides, and drafts as tasks of several levels of detail (inventory J01 to J06, H01, H14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import canon, text

SIDE = ("name", "type_line", "mana_cost", "colors", "power", "toughness", "oracle_text")
# The fields that a level of detail may leave out, in order.
FIELDS = ("mana_cost", "type_line", "colors", "power", "toughness", "loyalty", "defense", "hand_modifier", "life_modifier")
STYLES = ("minimal", "concept", "mechanics", "complete", "casual_complete")
_NONE = "array<string>"


def sides(faces: str = "card_faces") -> Column:
    """The faces of a record, or the record itself as its only side, as an array of structs of SIDE; face colours default to the record's."""
    own = F.array(F.struct(*SIDE))
    each = F.transform(faces, lambda f: F.struct(*(F.coalesce(f["colors"], F.col("colors")).alias("colors") if c == "colors" else f[c].alias(c) for c in SIDE)))
    return F.when(F.size(faces) > 0, each).otherwise(own)


def in_order(colors: Column) -> Column:
    return F.filter(F.array(*map(F.lit, "WUBRG")), lambda c: F.array_contains(colors, c))


def aliases(of: Column) -> Column:
    """(`name`, `alias`) of each side; the alias of side i counts from 1."""
    return F.transform(of, lambda s, i: F.struct(s["name"].alias("name"), F.concat(F.lit("Draft Face "), (i + 1).cast("string")).alias("alias")))


def draft_rules(side: Column, others: Column) -> Column:
    """Rules text of a side without reminders (kept where parentheses do not balance), names replaced; null is the empty text."""
    raw = F.coalesce(side["oracle_text"], F.lit(""))
    bare = F.coalesce(text.without_parentheses(raw), raw)
    return text.bind_names(bare, F.coalesce(side["name"], F.lit("")), F.filter(others, lambda o: ~o["name"].eqNullSafe(side["name"])))


def drafts(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per side of each record: `keep`, `face` from 0, `faces` (0 if it has none), and the draft's fields.

    `draft_name` is null for a record without faces; colours are the side's, else those of its cost, and none with Devoid.
    """
    rows = df.select(*keep, "layout", F.when(F.size("card_faces") > 0, F.size("card_faces")).otherwise(0).alias("faces"), F.col("type_line").alias("whole_type"), sides().alias("_s"))
    rows = rows.withColumn("_a", aliases(F.col("_s")))
    each = rows.select(*keep, "layout", "faces", "whole_type", "_a", F.posexplode("_s").alias("face", "s"))
    devoid = F.coalesce(F.col("s.oracle_text").rlike(r"(?m)^Devoid\b"), F.lit(False))
    of_cost = F.when(devoid, F.array().cast(_NONE)).otherwise(text.colors_of(F.coalesce("s.mana_cost", F.lit(""))))
    colors = in_order(F.coalesce("s.colors", of_cost))
    name = F.when(F.col("faces") > 0, F.concat(F.lit("Draft Face "), (F.col("face") + 1).cast("string")))
    return each.select(
        *keep, "layout", "faces", "whole_type", "face", F.col("s.name").alias("name"), name.alias("draft_name"), "s.type_line", "s.mana_cost", colors.alias("colors"), "s.power", "s.toughness",
        draft_rules(F.col("s"), F.col("_a")).alias("rules"),
    )


def bound_back(rules: Column, name: Column, names: Column) -> Column:
    """A draft's placeholders replaced by names: the own one, then those of the sides."""
    own = F.replace(rules, F.lit("CARDNAME"), F.coalesce(name, F.lit("Draft Card")))
    return F.aggregate(F.sequence(F.lit(1), F.size(names)), own, lambda t, i: F.replace(t, F.concat(F.lit("Draft Face "), i.cast("string")), F.element_at(names, i)))


def family() -> Column:
    """Family digest of a record with the columns `layout`, `card_faces` and those of SIDE: its sides' drafted rules, joined."""
    of = sides()
    rules = F.transform(of, lambda s: draft_rules(s, aliases(of)))
    layout = F.when(F.size("card_faces") > 0, F.coalesce("layout", F.lit("normal"))).otherwise("single")
    return canon.digest(text.family_key(layout, F.array_join(rules, "\nFACE\n")))


def sparse_defaults(colors: Column, cost: Column, rules: Column, colors_stated: Column, cost_stated: Column) -> tuple[Column, Column, Column]:
    """(colours, cost, what changed) of a design without rules text whose colours are none though its cost has some.

    Colours that were not asked for follow the cost; if only the cost was not asked for, it becomes a colourless one of the
    same value. Anything stated, and any design with rules text, stays.
    """
    own = text.colors_of(F.coalesce(cost, F.lit("")))
    odd = (F.coalesce(rules, F.lit("")) == "") & (F.size(colors) == 0) & (F.size(own) > 0)
    change = F.when(odd & ~colors_stated, "colors").when(odd & ~cost_stated, "mana_cost")
    plain = F.concat(F.lit("{"), text.mana_value(cost).cast("string"), F.lit("}"))
    return F.when(change == "colors", own).otherwise(colors), F.when(change == "mana_cost", plain).otherwise(cost), change


def projections(df: DataFrame, ident: str, version: str, keep: list[str]) -> DataFrame:
    """Five tasks per record, from a sparse idea to the whole: `keep`, `style`, `id`, the target's main fields and the field sets.

    `specified` are the paths that the task states, `proposed` those of its target that it does not, `omitted` the FIELDS
    that it leaves out; `colors_before` and `cost_before` are those before coherent defaults. The sparse levels take the
    first side only, without its rules, superfluous supertypes and unfixed stats.
    """
    rows = drafts(df, list(dict.fromkeys([*keep, ident])))
    per = rows.groupBy(*dict.fromkeys([*keep, ident])).agg(
        F.min_by(F.struct("layout", "faces", "whole_type", "type_line", "mana_cost", "colors", "power", "toughness", "rules"), "face").alias("p"),
        F.sort_array(F.collect_list(F.struct("face", "type_line", "mana_cost", "colors", "power", "toughness", "rules"))).alias("sides"),  # a record's own sides
        F.bool_or(F.col("rules") != "").alias("has_rules"),
    )
    joined = lambda paths: F.array_compact(F.array(*paths))
    many, odd_layout = F.col("p.faces") > 0, F.coalesce("p.layout", F.lit("normal")) != "normal"
    kind = F.coalesce("p.type_line", F.lit(""))
    main, rest = F.substring_index(kind, " — ", 1), F.when(F.contains(kind, F.lit(" — ")), F.expr("substring(p.type_line, instr(p.type_line, ' — ') + 3)"))
    broad = F.array_join(F.filter(F.split(main, " +"), lambda w: ~w.isin("Legendary", "Snow", "World", "Basic") & (w != "")), " ")
    short = F.when(F.contains(broad, F.lit("Creature")) & rest.isNotNull(), F.concat(broad, F.lit(" — "), rest)).otherwise(broad)
    number = lambda c, p: F.coalesce(F.col(c).rlike(p), F.lit(False))
    fixed = number("p.power", r"^-?\d+$") & number("p.toughness", r"^-?\d+$")
    sized = number("p.power", r"^\d+$") & number("p.toughness", r"^\d+$")
    largest = F.greatest(F.col("p.power").try_cast("int"), F.col("p.toughness").try_cast("int"))
    note = F.when(sized, F.when(largest <= 2, "small").when(largest <= 4, "midsize").otherwise("large"))
    has = lambda prefix, f: F.when(F.col(f"{prefix}.{f}").isNotNull(), F.lit(f))
    side_paths = F.flatten(F.transform("sides", lambda s: F.transform(
        F.array_compact(F.array(F.lit("name"), *(F.when(s[f].isNotNull(), F.lit(f)) for f in ("type_line", "mana_cost", "power", "toughness")), F.lit("colors"), F.lit("oracle_text"))),
        lambda f: F.concat(F.lit("card_faces."), s["face"].cast("string"), F.lit("."), f),
    )))
    mechanic_paths = F.flatten(F.transform("sides", lambda s: F.transform(F.array(*map(F.lit, ("name", "type_line", "oracle_text"))), lambda f: F.concat(F.lit("card_faces."), s["face"].cast("string"), F.lit("."), f))))
    primary = [has("p", "type_line"), has("p", "mana_cost"), has("p", "power"), has("p", "toughness"), F.lit("colors"), F.lit("oracle_text")]
    layout = F.when(many | odd_layout, F.lit("layout"))
    whole = F.when(many, F.concat(joined([layout, F.lit("type_line"), F.lit("oracle_text")]), side_paths)).otherwise(joined([*primary, layout]))
    sparse = joined([F.lit("type_line"), *primary[1:]])
    stated = {
        "minimal": joined([F.lit("type_line"), F.lit("oracle_text"), F.when(fixed, F.lit("power")), F.when(fixed, F.lit("toughness"))]),
        "concept": joined([F.lit("type_line"), F.lit("colors"), F.lit("oracle_text"), F.when(note.isNotNull(), F.lit("design_notes"))]),
        "mechanics": F.when(many, F.concat(joined([F.lit("layout"), F.lit("type_line"), F.lit("oracle_text")]), mechanic_paths)).otherwise(joined([F.lit("type_line"), F.lit("oracle_text"), layout])),
        "complete": whole, "casual_complete": whole,
    }
    levels = F.array(*(F.struct(F.lit(s).alias("style"), stated[s].alias("stated"), (F.concat(sparse, F.when(note.isNotNull() & F.lit(s == "concept"), F.array(F.lit("design_notes"))).otherwise(F.array().cast(_NONE))) if s in STYLES[:2] else whole).alias("target")) for s in STYLES))
    every = per.withColumns({"short": short, "fixed": fixed, "note": note}).select("*", F.explode(levels).alias("l"))
    is_sparse, star = F.col("l.style").isin(*STYLES[:2]), F.col("p.power").isNotNull() & ~F.col("fixed")
    stat = lambda f: F.when(is_sparse & star, F.lit("3")).otherwise(F.col(f"p.{f}"))
    rules = F.when(is_sparse, F.lit("")).otherwise(F.col("p.rules"))
    colors, cost, change = sparse_defaults(F.col("p.colors"), F.col("p.mana_cost"), rules, F.array_contains("l.stated", "colors"), F.array_contains("l.stated", "mana_cost"))
    omitted = F.filter(F.array(*map(F.lit, FIELDS)), lambda f: ~F.array_contains("l.stated", f))
    return every.select(
        *keep, "l.style", F.substring(canon.digest_list(F.lit(version), F.col(ident), F.col("l.style")), 1, 24).alias("id"),
        F.when(is_sparse, F.col("short")).when(F.col("p.faces") > 0, F.col("p.whole_type")).otherwise(F.col("p.type_line")).alias("type_line"), rules.alias("rules"),
        colors.alias("colors"), cost.alias("mana_cost"), stat("power").alias("power"), stat("toughness").alias("toughness"),
        F.when(F.col("l.style") == "concept", F.col("note")).alias("note"), change.alias("adjusted"), F.col("p.colors").alias("colors_before"), F.col("p.mana_cost").alias("cost_before"),
        F.when(is_sparse, "unspecified").when(F.col("has_rules"), "all").otherwise("explicit_none").alias("rules_coverage"),
        F.array_sort("l.stated").alias("specified"), F.array_sort(F.array_except("l.target", "l.stated")).alias("proposed"), omitted.alias("omitted"),
    )
