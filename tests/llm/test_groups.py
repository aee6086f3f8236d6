from sievewright.llm.queries import p3_groups

TEXT = "whenever the amber gate opens you may move two counters from this tower onto another tower you lead this turn"


def test_every_design_has_a_row(spark, tmp_path):
    texts = [TEXT, TEXT, TEXT + " twice", "equal words in both of these designs", "equal words in both of these designs", "quite alone among all the other rows", "", None]
    rows = [(i, ("Artifact", t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "card_id long, draft struct<type_line string, oracle_text string>").write.parquet(f"{tmp_path}/custom_cards.parquet")
    got = {r["card_id"]: (r["group_id"], r["links"], r["equals"]) for r in p3_groups(spark, str(tmp_path)).collect()}
    assert got == {0: (0, 1, 2), 1: (0, 1, 2), 2: (0, 1, 1), 3: (3, 0, 2), 4: (3, 0, 2), 5: (5, 0, 1), 6: (6, 0, 1)}
