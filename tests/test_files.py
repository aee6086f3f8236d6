import gzip
import hashlib
import json
import lzma

import pytest
from pyspark.sql import functions as F

from sievewright.sources import files, sinks
from sievewright.streaming import incremental


def test_lines_split_files_and_gzip(spark, tmp_path):
    for name, n in (("train", 3), ("test", 1)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"id": i}) + "\n" for i in range(n)))
    got = files.split_files(spark, str(tmp_path), "id int").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 3, "test": 1}
    assert files.split_files(spark, str(tmp_path / "none"), "id int").count() == 0
    with gzip.open(tmp_path / "s.jsonl.gz", "wt") as f:
        f.write('{"id": 7}\n')
    assert files.json_lines(spark, str(tmp_path / "s.jsonl.gz"), "id int", 2).first()["id"] == 7


def test_xz_is_unpacked_first(spark, tmp_path):
    with lzma.open(tmp_path / "a.json.xz", "wt") as f:
        f.write(json.dumps({"data": {"s1": {"cards": [{"name": "a"}, {"name": "b"}]}, "s2": {"cards": []}}}))
    files.xz_to_lines(str(tmp_path / "a.json.xz"), str(tmp_path / "a.json"))
    got = files.nested_document(spark, str(tmp_path / "a.json"), "data map<string,struct<cards:array<struct<name:string>>>>", "data", "cards")
    assert sorted((r["set_key"], r["name"]) for r in got.collect()) == [("s1", "a"), ("s1", "b")]


def test_changed_missing_and_unlisted_files_are_told(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_text(n)
    pins = files.file_pins(spark, str(tmp_path)).select("file", "sha256")
    manifest = spark.createDataFrame([tuple(r) for r in pins.filter("file <> 'c'").collect()] + [("d", "0")], "file string, sha256 string")
    (tmp_path / "a").write_text("changed")
    got = {r["file"]: r["state"] for r in files.check_pins(spark, str(tmp_path), manifest).collect()}
    assert got == {"a": "changed", "c": "unlisted", "d": "missing"}
    with pytest.raises(ValueError, match="a changed"):
        files.checked(spark, str(tmp_path), manifest)


def test_nested_names_and_links_are_refused(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    for name in ("a", "c", "sub/c"):
        (root / name).write_text(name)
    pin = lambda text: hashlib.sha256(text.encode()).hexdigest()
    manifest = spark.createDataFrame([("a", pin("a")), ("c", pin("sub/c"))], "file string, sha256 string")
    got = {r["file"]: r["state"] for r in files.check_pins(spark, str(root), manifest).collect()}
    assert got == {"c": "changed", "sub/c": "unlisted"}  # the nested one does not stand for it
    nested = spark.createDataFrame([("a", pin("a")), ("c", pin("c")), ("sub/c", pin("sub/c"))], "file string, sha256 string")
    assert {r["file"]: r["state"] for r in files.check_pins(spark, str(root), nested).collect()} == {"sub/c": "nested"}
    (root / "sub" / "c").unlink()
    (root / "l").symlink_to(root / "a")
    linked = spark.createDataFrame([("a", pin("a")), ("c", pin("c")), ("l", pin("a"))], "file string, sha256 string")
    assert {r["file"]: r["state"] for r in files.check_pins(spark, str(root), linked).collect()} == {"l": "link"}
    assert files.checked_file(spark, str(root), "a", linked).endswith("/a")
    for name in ("l", "sub/c", "..", "gone"):
        with pytest.raises(ValueError):
            files.checked_file(spark, str(root), name, linked)
    (root / "a").write_text("other")
    with pytest.raises(ValueError):
        files.checked_file(spark, str(root), "a", linked)
    with pytest.raises(ValueError):
        files.checked(spark, str(root), linked.limit(0), {"family_leak": True})


def test_sources_need_unique_keys_and_manifests_lead_to_their_parents(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"k": "a", "v": 1}\n{"k": "b", "v": 2}\n')
    pins = lambda: files.file_pins(spark, str(tmp_path), ["s.jsonl"])
    assert files.load_sources(spark, str(tmp_path), "s.jsonl", pins(), "k string, v int", "k").count() == 2
    (tmp_path / "s.jsonl").write_text('{"k": "a", "v": 1}\n{"k": "a", "v": 2}\n')
    with pytest.raises(ValueError):
        files.load_sources(spark, str(tmp_path), "s.jsonl", pins(), "k string, v int", "k")
    parent, child = tmp_path / "parent", tmp_path / "parent" / "child"
    sinks.replace_json(spark, str(parent / "manifest.json"), {"source": {"name": "x"}})
    told = {"source_root": "..", "source_manifest_sha256": hashlib.sha256((parent / "manifest.json").read_bytes()).hexdigest()}
    sinks.replace_json(spark, str(child / "manifest.json"), told)
    assert files.source_manifest(spark, str(child)) == files.source_manifest(spark, str(parent)) == {"name": "x"}
    sinks.replace_json(spark, str(parent / "manifest.json"), {"source": {"name": "y"}})
    with pytest.raises(ValueError):
        files.source_manifest(spark, str(child))


def test_archives_are_checked_when_read(spark, tmp_path):
    df = spark.createDataFrame([(1, [3.0, 4.0], "a"), (2, [0.0, 0.0], "b"), (3, None, "c")], "id int, v array<float>, name string")
    told = sinks.vector_index(df, str(tmp_path / "i"), "id", "v", 2, ["name"])
    assert told["rows"] == 1
    row = files.load_archive(spark, str(tmp_path / "i")).first()
    assert (row["id"], row["name"]) == (1, "a") and [round(x, 6) for x in row["vector"]] == [0.6, 0.8]
    (tmp_path / "i" / "data" / "more.parquet").write_bytes(b"x")
    with pytest.raises(ValueError):
        files.load_archive(spark, str(tmp_path / "i"))
    with pytest.raises(Exception):
        sinks.vector_index(df, str(tmp_path / "j"), "id", "v", 3, [])


def test_logs_and_tables_of_results(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "x"), (2, None, "a|b")], "step int, loss double, note string")
    sinks.write_csv_log(df, str(tmp_path / "log"), ["step", "loss"])
    assert sorted(map(tuple, files.csv_log(spark, str(tmp_path / "log"), "step int, loss double").collect())) == [(1, 0.5), (2, None)]
    assert sinks.markdown(df.orderBy("step"), ["step", "note"]) == "| step | note |\n| --- | --- |\n| 1 | x |\n| 2 | a\\|b |"
    with pytest.raises(ValueError):
        sinks.markdown(df, ["step"], most=1)
    folder = tmp_path / "work"
    folder.mkdir()
    for i in (2, 1):
        (folder / f"{i}.json").write_text(f'{{"id": {i}}}')
    assert [(r["id"], r["file"]) for r in files.work_folder(spark, str(folder), "id int").orderBy("file").collect()] == [(1, "1.json"), (2, "2.json")]


def test_outputs_are_never_overwritten_and_receipts_ignore_order(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "id int, v string")
    a = sinks.write_lines(df, str(tmp_path / "out"), ["id"], files=1).first()
    assert a == sinks.receipt(df.orderBy(F.desc("id"))).first() and a["rows"] == 2
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part*")) == '{"id":1,"v":null}\n{"id":2,"v":"b"}\n'
    assert a["bytes"] == len('{"id":1,"v":null}\n{"id":2,"v":"b"}\n')
    with pytest.raises(Exception):
        sinks.write_lines(df, str(tmp_path / "out"), ["id"])


def test_routes_lose_no_row(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, r string")
    sinks.write_routed(df, str(tmp_path / "o"), F.col("r"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_wrong_dimensions_fail(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 2.0])], "id int, embedding array<float>").write.parquet(str(tmp_path / "v"))
    assert files.vectors(spark, str(tmp_path / "v"), 2).count() == 1
    with pytest.raises(Exception):
        files.vectors(spark, str(tmp_path / "v"), 3).collect()


def test_queue_and_appends_add_nothing_twice(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.json").write_text('{"id": 1}\n{"id": 2}\n')
    run = lambda c: incremental.run_queue(spark, str(folder), "id int", "id", lambda b: b.withColumn("d", F.col("id") * 2), out, str(tmp_path / c)).awaitTermination()
    run("c1")
    run("c1")
    (folder / "b.json").write_text('{"id": 2}\n{"id": 3}\n')
    run("c1")
    run("c2")  # a lost checkpoint delivers all again
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    stream = spark.readStream.schema("id int").json(str(folder))
    for _ in range(2):
        incremental.append_once(stream, "id", str(tmp_path / "once"), str(tmp_path / "c3")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "once")).collect()) == [1, 2, 3]


def test_a_queue_stops_at_its_drain_file_and_at_failures(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.json").write_text('{"id": 1}\n')

    def work(batch):
        if batch.filter("id = 2").count() and not (tmp_path / "mended").exists():
            raise RuntimeError("job 2 fails")
        return batch.withColumn("state", F.when(F.col("id") == 3, "needs_review").otherwise("completed"))

    def run():
        try:
            incremental.run_queue(spark, str(folder), "id int", "id", work, out, str(tmp_path / "c"), drain=str(tmp_path / "drain")).awaitTermination()
        except Exception:
            return False
        return True

    (tmp_path / "drain").touch()
    assert not run() and not (tmp_path / "out").exists()
    (tmp_path / "drain").unlink()
    assert run()
    (folder / "b.json").write_text('{"id": 2}\n{"id": 3}\n')
    assert not run() and not run()
    (tmp_path / "mended").touch()
    (folder / "c.json").write_text('{"id": 4}\n')
    assert run()
    jobs = spark.createDataFrame([(i,) for i in range(1, 6)], "id int")
    states = {r["id"]: r["state"] for r in incremental.queue_states(jobs, spark.read.parquet(out), "id").collect()}
    assert states == {1: "completed", 2: "completed", 3: "needs_review", 4: "completed", 5: "pending"}


def test_logs_keep_whole_lines_of_known_keys_once(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"k": "a", "v": 1}\n{"k": "b", "v": 2}\n{"k": "a", "v": 3}\n{"k": "z", "v": 4}\n\n{"k": "c", "v"')
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    rows, refused = incremental.whole_lines(spark, str(tmp_path / "log.jsonl"), "k string, v int", "k", known)
    assert sorted(map(tuple, rows.collect())) == [("a", 1), ("b", 2)]
    assert sorted(r["reason"] for r in refused.collect()) == ["repeated", "torn", "unknown"]


def test_costs_and_limits(spark):
    c = F.col
    df = spark.createDataFrame([(60, 0.1, 7.0), (60, 0.1, 5.0), (60, 0.0, 5.0)], "minutes int, price double, budget double")
    assert [r[0] for r in df.select(incremental.cost_cap(c("minutes"), c("price"), c("budget"))[1]).collect()] == [True, False, False]
    df = spark.createDataFrame([(0, 10, 100), (0, None, 100), (3, 10, 100), (0, 600, 300)], "i int, gained int, approved int")
    assert [r[0] for r in df.select(incremental.look_ahead(c("i"), 3, c("approved"), c("gained"), F.lit(1000))).collect()] == [True, False, False, False]
    df = spark.createDataFrame([(100, None), (5000, 1.0), (90000, 1.0), (0, 1.0)], "n int, s double")
    assert [r[0] for r in df.select(incremental.segment_seconds(c("n"), c("s"))).collect()] == [1800, 7500, 12600, None]


def test_grid_and_budget(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "c string")
    done = spark.createDataFrame([("a", 0)], "c string, slot int")
    assert incremental.missing_slots(cases, done, "c", 2).count() == 3
    log = spark.createDataFrame([(1, 3.0), (2, 3.0)], "t int, x double")
    assert [r["over_limit"] for r in incremental.running_budget(log, [], ["t"], "x", 5).orderBy("t").collect()] == [False, True]
    got = spark.range(1).select(incremental.settled(F.lit(10 + 1 / 60), F.lit(0.05), F.lit(5.0)).alias("s")).first()["s"]
    assert round(got, 9) == 0.65
