"""Connected components of keys that occur together (problem 6, and the groups of problem 3).

Parallel hooking and shortcutting: every root hooks onto its smallest neighbour, the forest is flattened by
doubling pointers, edges are relabelled by their roots, until none is left. All tables stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.sources.shared import materialize


def flatten(parents: DataFrame) -> DataFrame:
    """Shortcut (`node`, `parent`) until every parent is a root; roots themselves have no row."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = materialize(parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), "parents")
        parents = jumped.select("node", "parent")
        if jumped.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(`node`, `root`) of every node of the `edges` (`u`, `v`), `root` being the smallest node of its component.

    Edges with a null end and loops are ignored; repeated edges count once. An empty table gives no rows. A node
    may be in any share of the edges: minima are taken in part before the shuffle.
    """
    clean = edges.filter("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left = materialize(clean, "edges")
    roots = materialize(left.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while not left.isEmpty():
        hooks = left.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"))
        forest = flatten(materialize(hooks, "hooks"))
        up = forest.select(F.col("node").alias("root"), F.col("parent").alias("new"))
        roots = materialize(roots.join(up, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "roots")
        a, b = (forest.select(F.col("node").alias(c), F.col("parent").alias(f"r{c}")) for c in "uv")
        moved = left.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("ru", "u").alias("x"), F.coalesce("rv", "v").alias("y"))
        left = materialize(moved.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
    return roots


def component_pairs(members: DataFrame, node: str = "node") -> DataFrame:
    """All pairs (`a` < `b`) of nodes of one component, for results that ask for pairs."""
    x = members.select("root", F.col(node).alias("a"))
    y = members.select("root", F.col(node).alias("b"))
    return x.join(y, "root").filter("a < b").select("a", "b")
