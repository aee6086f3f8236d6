from pyspark.sql import functions as F

from sievewright.llm.copies import collapse_copies


def run(spark, rows, schema="id long, name string, text string", fields=("name", "text"), **kw):
    groups, members = collapse_copies(spark.createDataFrame(rows, schema), "id", [F.col(c) for c in fields], **kw)
    return sorted((r["first_id"], r["copies"]) for r in groups.collect()), sorted((r["first_id"], r["other_id"]) for r in members.collect())


def test_form_does_not_count_but_signs_do(spark):
    rows = [(3, "A  b!", "x+1"), (1, "ab", "X +1."), (2, "ab", "x-1"), (4, "AB", "x+1")]
    groups, members = run(spark, rows)
    assert groups == [(1, 3), (2, 1)] and members == [(1, 3), (1, 4)]


def test_null_missing_and_empty_agree(spark):
    groups, members = run(spark, [(1, None, "..."), (2, "", None), (3, "", ""), (None, "a", "b")])
    assert groups == [(1, 3)] and members == [(1, 2), (1, 3)]


def test_field_borders_count(spark):
    assert run(spark, [(1, "ab", "c"), (2, "a", "bc")])[1] == []


def test_hot_keys_repeated_rows_and_long_texts(spark):
    rows = [(i, "same", "x" * 50_000) for i in range(40)] + [(0, "same", "x" * 50_000), (100, "other", "y")]
    groups, members = run(spark, rows)
    assert groups == [(0, 41), (100, 1)] and members == [(0, i) for i in range(1, 40)]


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == ([], [])
    rows = [(1, "a", "b", "k", 1), (2, "A", "B", "k2", 2)]
    assert run(spark, rows, "id long, key string, n string, copies string, first_id int", ("key", "n"))[1] == [(1, 2)]


def test_case_folding_beyond_lower_case(spark):
    assert run(spark, [(1, "Straße", "ΟΔΟΣ α"), (2, "STRASSE", "οδος Α")])[1] == [(1, 2)]
