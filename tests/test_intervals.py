import numpy as np
from pyspark.sql import functions as F

from sievewright.operators import statistics
from sievewright.queries import QUERIES


def test_classes_have_the_law_of_single_draws(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 9, 120)
    rows = [(f, int(x)) for f, n in enumerate(sizes) for x in rng.integers(-1, 2, n) + (n > 6)]
    paired = spark.createDataFrame(rows, "family int, d int")
    r = statistics.class_bootstrap(paired, "family", F.col("d")).first()
    assert (r["families"], r["cases"]) == (120, len(rows)) and abs(r["estimate"] - 100 * sum(x for _, x in rows) / len(rows)) < 1e-5
    d, c = np.bincount([f for f, _ in rows], [x for _, x in rows]), sizes
    at = rng.integers(0, 120, (5000, 120))
    s = np.sort(100 * d[at].sum(axis=1) / c[at].sum(axis=1))
    sd = s.std()
    assert abs(r["lower"] - s[124]) < 0.15 * sd and abs(r["upper"] - s[4874]) < 0.15 * sd
    assert r == statistics.class_bootstrap(paired.repartition(7), "family", F.col("d")).first()
    assert statistics.class_bootstrap(paired.limit(0), "family", F.col("d")).first()["families"] == 0


def test_families_are_source_groups(spark, tmp_path):
    cases = [f"c{i}" for i in range(40)]
    groups = [("  G%d" if i % 2 else "g%d ") % (i % 4) for i in range(36)] + [None, None, None]  # c39 has no example
    families = [None] * 36 + ["f", "F ", None]
    spark.createDataFrame(list(zip(cases, groups, families)), "example_id string, source_group_id string, family_id string").write.parquet(f"{tmp_path}/examples.parquet")
    rows = [(c, arm, arm == "base" and i % 4 == 0) for i, c in enumerate(cases) for arm in ("base", "sft")]
    spark.createDataFrame(rows, "case_id string, arm string, hit_token_limit boolean").write.parquet(f"{tmp_path}/candidates.parquet")
    for name in ("l01_group_bootstrap", "l02_several_metrics", "l03_panel_interval", "l04_wide_interval"):
        for r in QUERIES[name](spark, str(tmp_path)).collect():
            assert (r["families"], r["cases"]) == (7, 40)  # four groups, a family, two cases alone
