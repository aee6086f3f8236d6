from pyspark.sql import functions as F

from sievewright.llm.queries import QUERIES


def test_designs_without_rules_text_are_like_nothing(spark, tmp_path):
    blank = ["", " ", "\n", "\t \r\n", " ", "　", None]
    rows = [(i, ("Legendary Creature — Faer", t)) for i, t in enumerate(blank + ["Run far.", "Run far.", "x"])]
    df = spark.createDataFrame(rows, "card_id long, draft struct<type_line string, oracle_text string>").withColumn("id", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/custom_cards.parquet")
    found = sorted(tuple(r) for r in QUERIES["p3_found"](spark, str(tmp_path)).collect())
    n = len(blank)
    assert found == [(n, n + 1)]
    groups = {r["card_id"]: r["group_id"] for r in QUERIES["p3_groups"](spark, str(tmp_path)).collect()}
    assert groups == {i: n if i == n + 1 else i for i in range(n + 3) if i != n - 1}  # blank ones alone, the null one without a row
