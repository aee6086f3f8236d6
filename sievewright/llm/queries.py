"""Queries of the nine problems over the test tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.llm import copies, cutoff, fragments, lookalikes, mixing, overlap, packing, spans, splits
from sievewright.llm.components import component_pairs, components
from sievewright.llm.shingles import expand
from sievewright.llm.tokens import RANKS, token_count
from sievewright.sources.shared import materialize
from sievewright.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
RECORD = "struct<name:string,type_line:string,mana_cost:string,oracle_text:string>"


def _copies(spark: SparkSession, d: str) -> list[tuple[str, tuple[DataFrame, DataFrame]]]:
    fields = ["name", "type_line", "mana_cost", "oracle_text"]
    record = F.from_json("record", RECORD)
    printed = table(spark, d, "printed_wordings").select("wording_id", record.alias("r"))
    return [
        ("cards", copies.collapse_copies(table(spark, d, "cards"), "card_no", [F.col(c) for c in fields])),
        ("printed_wordings", copies.collapse_copies(printed, "wording_id", [F.col(f"r.{c}") for c in fields])),
    ]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = (members.select(F.lit(tab).alias("tab"), "first_id", "other_id") for tab, (_, members) in _copies(spark, d))
    return a.unionByName(b)


def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    a, b = (groups.select(F.lit(tab).alias("tab"), "first_id", "copies") for tab, (groups, _) in _copies(spark, d))
    return a.unionByName(b)


def _example_side() -> Column:
    return F.when(F.col("split") == "train", 0).when(F.col("split").isin("validation", "test"), 1)


def _group_key() -> Column:
    return F.lower(F.trim("source_group_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows, side = table(spark, d, "examples"), _example_side()
    like = overlap.like_texts(rows, "row_id", side, F.col("description"), likeness=0.6, words=3)
    same = overlap.same_key(rows, "row_id", side, F.col("example_id"))
    group = overlap.same_key(rows, "row_id", side, _group_key())
    every = like.unionByName(same).unionByName(group)
    return every.select(F.least("a", "b").alias("row_a"), F.greatest("a", "b").alias("row_b")).distinct()


def _overlap_counts(held: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """Per split, origin and kind: held-out rows with links, their links, and all rows of the split and origin."""
    hit = None
    for kind, links in kinds.items():
        part = links.select("id", "links", F.lit(kind).alias("kind"))
        hit = part if hit is None else hit.unionByName(part)
    total = held.groupBy("split", "origin").agg(F.count(F.lit(1)).alias("rows"))
    per = held.join(hit, "id").groupBy("split", "origin", "kind").agg(F.count(F.lit(1)).alias("overlapping_rows"), F.sum("links").alias("links"))
    return per.join(total.withColumnsRenamed({"split": "s", "origin": "o"}), (F.col("split") == F.col("s")) & F.col("origin").eqNullSafe(F.col("o"))).drop("s", "o")


def _held_out(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "examples").filter("split in ('validation', 'test')").select(F.col("row_id").alias("id"), "split", "origin")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Held-out rows per split and origin that recur in train, by kind of overlap; links are counted by class and by key."""
    rows, side = table(spark, d, "examples"), _example_side()
    kinds = {
        "description": overlap.like_counts(*overlap.like_classes(rows, "row_id", side, F.col("description"), likeness=0.6, words=3)),
        "example_id": overlap.key_counts(rows, "row_id", side, F.col("example_id")),
        "source_group_id": overlap.key_counts(rows, "row_id", side, _group_key()),
    }
    return _overlap_counts(_held_out(spark, d), kinds)


def p2_weighted(spark: SparkSession, d: str) -> DataFrame:
    """As p2_report, for descriptions alone, by the cosine of runs of five words weighted by their rarity in the corpus."""
    rows, side = table(spark, d, "examples"), _example_side()
    links = overlap.like_counts(*overlap.weighted_classes(rows, "row_id", side, F.col("description")))
    return _overlap_counts(_held_out(spark, d), {"weighted description": links})


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "custom_cards").select("card_id", "draft.type_line", "draft.oracle_text")
    return rows.filter(F.col("oracle_text").rlike(r"(?U)\S"))  # not blank


def _designs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return fragments.fragment_join(_eligible(spark, d), "card_id", F.concat_ws("\n", "type_line", "oracle_text"), likeness=0.6, words=3)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = _designs(spark, d)
    far = expand(pairs.select("a", "b"), members).select(F.least("a", "b").alias("card_a"), F.greatest("a", "b").alias("card_b"))
    return far.unionByName(fragments.within_classes(members).toDF("card_a", "card_b")).distinct()


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per design whose rules text is not null (a blank one is like nothing): its group (itself if it is like no other), how many distinct designs it is like, and the size of its class of equal ones."""
    pairs, members = _designs(spark, d)
    every = table(spark, d, "custom_cards").filter("draft.oracle_text is not null").select("card_id").distinct()
    return design_groups(every, pairs.select("a", "b"), members)


def design_groups(designs: DataFrame, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(`card_id`, `group_id`, `links`, `equals`) of every row of `designs`; pairs and members as `fragment_join` gives them."""
    root = components(pairs.toDF("u", "v").unionByName(members.select("rep", "id").toDF("u", "v"))).withColumnRenamed("node", "card_id")
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("rep").agg((F.count(F.lit(1)) + 1).alias("equals"))
    rows = designs.join(members.select(F.col("id").alias("card_id"), "rep"), "card_id", "left").withColumn("rep", F.coalesce("rep", "card_id"))
    every = rows.join(root, "card_id", "left").join(links, "rep", "left").join(sizes, "rep", "left")
    return every.select("card_id", F.coalesce("root", "card_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("equals", F.lit(1)).alias("equals"))


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_outputs(table(spark, d, "candidates"), "candidate_id", "raw", "arm", "hit_token_limit")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).filter("is_cut").select(F.col("id").alias("candidate_id"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_report(_cut(spark, d)).withColumnRenamed("source", "arm")


def _forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_forms(table(spark, d, "cards"), "card_no", ["name", "oracle_text"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).filter("is_case").select(F.col("id").alias("card_no"), "field_name")


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).select(F.col("id").alias("card_no"), "field_name", "form", "is_case")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_groups(_forms(spark, d)).select("field_name", "skeleton_key", "originals", "fields", "first_id", "form")


def _family_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "examples")
    return components(splits.key_edges(rows, [F.col("source_group_id"), F.col("family_id")]))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    groups = _family_groups(spark, d).filter("node like '0:%'").select(F.substring("node", 3, 1 << 30).alias("node"), "root")
    return component_pairs(groups).select(F.col("a").alias("group_a"), F.col("b").alias("group_b"))


def _splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "examples"), "row_id", [F.col("source_group_id"), F.col("family_id")], table(spark, d, "split_targets"))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d).select(F.col("id").alias("row_id"), "split")


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per split its wanted share, rows and share reached, and how many keys it shares with another split."""
    placed = materialize(_splits(spark, d), "splits")
    per = placed.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy())  # one row per split
    wanted = table(spark, d, "split_targets").select("split", F.col("share").alias("target_share"))
    leaks = splits.leaking_keys(table(spark, d, "examples"), "row_id", [F.col("source_group_id"), F.col("family_id")], placed)
    shares = per.withColumn("share", F.round(F.col("rows") / total, 6)).join(wanted, "split").join(leaks, "split", "left")
    return shares.select("split", "target_share", "rows", "share", F.coalesce("leaking", F.lit(0)).alias("leaking_keys"))


def _items(spark: SparkSession, d: str, ranks: str = RANKS) -> DataFrame:
    docs = table(spark, d, "documents")
    return materialize(docs.select(F.col("doc_id").alias("id"), "source", token_count("text", ranks).alias("tokens")), "tokens")


def _packed(spark: SparkSession, d: str, ranks: str = RANKS) -> DataFrame:
    return packing.pack_items(_items(spark, d, ranks), table(spark, d, "pack_plans"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("id", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(_packed(spark, d), table(spark, d, "pack_plans"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.balance(_items(spark, d), table(spark, d, "mix_targets"))[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.balance(_items(spark, d), table(spark, d, "mix_targets"))[1]


def _spans(spark: SparkSession, d: str) -> spans.SharedSpans:
    return spans.SharedSpans(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).pairs().select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).report().withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_copies, p2_found, p2_report, p2_weighted, p3_found, p3_groups, p4_found, p4_report, p5_found, p5_forms, p5_groups,
        p6_found, p6_splits, p6_shares, p7_packed, p7_report, p8_mix, p8_shares, p9_found, p9_report,
    )
}
