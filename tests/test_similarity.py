import numpy as np

from sievewright.operators import statistics


def vectors(spark, rows, name):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} long, vector array<float>")


def test_counts_are_over_all_items(spark, monkeypatch):
    monkeypatch.setattr(statistics, "BLOCK", 16)  # several blocks on each side
    raw = np.random.default_rng(5).normal(size=(60, 4)).astype("float32")
    unit = raw.astype("float64") / np.linalg.norm(raw.astype("float64"), axis=1, keepdims=True)
    rows = [*enumerate(raw), (60, np.zeros(4)), (61, None)]
    got = {r["query"]: r for r in statistics.similarity_counts(vectors(spark, rows, "qid"), vectors(spark, rows, "id"), 0.2).collect()}
    assert sorted(got) == list(range(60))
    s = np.round(unit @ unit.T, 9)
    for i in range(60):
        own = np.delete(s[i], i)
        assert (got[i]["items"], got[i]["near"]) == (59, (own > 0.2).sum())
        assert abs(got[i]["low"] - own.min()) < 1e-8 and abs(got[i]["most"] - own.max()) < 1e-8
    assert max(r["near"] for r in got.values()) > 10  # not the length of a list of neighbours


def test_similarity_to_the_own_reference(spark):
    asked = vectors(spark, [(1, [1, 0]), (2, [3, 4]), (3, [1, 1]), (4, [0, 0])], "qid")
    own = vectors(spark, [(1, [2, 0]), (2, [4, 3]), (4, [1, 0]), (9, [1, 0])], "qid")
    got = {r["query"]: r["to_reference"] for r in statistics.reference_similarity(asked, own).collect()}
    assert got == {1: 1.0, 2: 0.96}
