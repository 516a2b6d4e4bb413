"""Sinks: what is written, what stays, and what a failed run leaves."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gleanery.sources import sinks


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, text string").repartition(5)


def files(path):
    """Time and size of each data file by its shard."""
    out = {}
    for d in sorted(os.listdir(path)):
        if d.startswith("shard="):
            (name,) = [n for n in os.listdir(f"{path}/{d}") if n.endswith(".json")]
            out[int(d[6:])] = (name, os.stat(f"{path}/{d}/{name}").st_mtime_ns)
    return out


def content(path):
    return {n: [json.loads(x)["id"] for x in open(f"{path}/shard={n}/{name}")] for n, (name, _) in files(path).items()}


def test_only_changed_shards_are_written(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = [(i, None if i == 3 else f"t{i}") for i in range(47)]
    assert sinks.write_changed(frame(spark, rows), path, "id", rows=10) == {"added": 5, "changed": 0, "stale": 0, "same": 0}
    assert content(path) == {k: list(range(10 * k, min(10 * k + 10, 47))) for k in range(5)}
    first = files(path)
    assert sinks.write_changed(frame(spark, rows), path, "id", rows=10)["same"] == 5
    assert files(path) == first
    rows[25] = (25, "other")
    assert sinks.write_changed(frame(spark, rows), path, "id", rows=10) == {"added": 0, "changed": 1, "stale": 0, "same": 4}
    second = files(path)
    assert {k for k in first if first[k] != second[k]} == {2}
    assert sinks.write_changed(frame(spark, rows + [(i, "new") for i in range(47, 61)]), path, "id", rows=10) == {"added": 2, "changed": 1, "stale": 0, "same": 4}
    assert sinks.write_changed(frame(spark, rows[:12]), path, "id", rows=10) == {"added": 0, "changed": 1, "stale": 5, "same": 1}
    assert content(path) == {0: list(range(10)), 1: [10, 11]} and files(path)[0] == first[0]
    assert spark.read.json(path).count() == 12
    assert sinks.write_changed(frame(spark, rows).limit(0), path, "id", rows=10)["stale"] == 2
    assert files(path) == {}


def broken(at):
    @F.udf("string")
    def text(x):
        if x == at:
            raise ValueError("a task fails")
        return x

    return text("text")


def test_a_failed_run_leaves_what_was_there(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "shards")
    rows = [(i, f"t{i}") for i in range(30)]
    sinks.write_changed(frame(spark, rows), path, "id", rows=10)
    before = files(path)
    with pytest.raises(Exception, match="a task fails"):
        sinks.write_changed(frame(spark, [(i, f"u{i}") for i in range(30)]).withColumn("text", broken("u17")), path, "id", rows=10)
    assert files(path) == before
    # a run that breaks off between the shards and their digests: the next one does not trust them, whatever it is to write
    record, calls = sinks._record, []

    def stops(df, path, version):
        calls.append(version)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        record(df, path, version)

    monkeypatch.setattr(sinks, "_record", stops)
    with pytest.raises(RuntimeError):
        sinks.write_changed(frame(spark, [(i, "x") for i in range(40)]), path, "id", rows=10)
    monkeypatch.undo()
    assert sinks.write_changed(frame(spark, rows), path, "id", rows=10)["same"] == 0
    assert content(path) == {k: list(range(10 * k, 10 * k + 10)) for k in range(3)}
    assert sorted(r["text"] for r in spark.read.json(path).collect()) == sorted(t for _, t in rows)


def test_records_have_files_of_their_own(spark, tmp_path):
    path, schema = str(tmp_path / "traces"), "id string, n int, note string"
    df = spark.createDataFrame([("a", 1, None), ("b-2", 2, "x"), ("c.3", 3, "y\nz"), ("c.3", 3, "y\nz")], schema)
    assert sinks.read_records(spark, path, schema).count() == 0
    sinks.put_records(df, path, "id")
    assert sorted(n for n in os.listdir(path) if n.startswith("record=")) == ["record=a", "record=b-2", "record=c.3"]
    sinks.put_records(spark.createDataFrame([("a", 9, "new")], schema), path, "id")
    assert sorted(map(tuple, sinks.read_records(spark, path, schema).collect())) == [("a", 9, "new"), ("b-2", 2, "x"), ("c.3", 3, "y\nz")]
    with pytest.raises(Exception, match="a task fails"):
        sinks.put_records(spark.createDataFrame([("a", "1"), ("d", "bad")], "id string, text string").withColumn("text", broken("bad")), path, "id")
    assert not os.path.exists(f"{path}/record=d") and sinks.read_records(spark, path, schema).where("id = 'a'").first()["n"] == 9
    for bad in ("../x", "", None, "a/b"):
        with pytest.raises(ValueError):
            sinks.put_records(spark.createDataFrame([(bad, 1, "")], schema), path, "id")
    keys = spark.createDataFrame([("a",), ("a",), ("zz",), (None,)], "id string")
    assert sinks.delete_records(keys, path, "id") == 1
    assert sorted(r["id"] for r in sinks.read_records(spark, path, schema).collect()) == ["b-2", "c.3"]


def test_a_state_is_replaced_whole(spark, tmp_path):
    path, schema = str(tmp_path / "state"), "id int, text string"
    assert sinks.read_state(spark, path, schema).count() == 0
    sinks.write_state(frame(spark, [(2, "b"), (1, None)]), path, "id")
    first = sinks.read_state(spark, path, schema)
    assert sorted(map(tuple, first.collect())) == [(1, None), (2, "b")]
    with pytest.raises(Exception, match="a task fails"):
        sinks.write_state(frame(spark, [(1, "x"), (2, "y")]).withColumn("text", broken("y")), path, "id")
    assert sinks.read_state(spark, path, schema).count() == 2
    sinks.write_state(sinks.read_state(spark, path, schema).where("id = 2"), path, "id")
    assert [tuple(r) for r in sinks.read_state(spark, path, schema).collect()] == [(2, "b")]
    assert first.count() == 2  # a reader of the state before


def test_contents_have_sidecars(spark, tmp_path):
    path = str(tmp_path / "raw")
    df = spark.createDataFrame([(b"one", "u1"), (b"one", "u2"), (b"two", "u3"), (None, "u4")], "body binary, url string")
    assert sinks.write_with_sidecars(df.where("body is not null"), path, "body", "url").count() == 2
    assert sinks.write_with_sidecars(df.where("url = 'u3'").unionByName(spark.createDataFrame([(b"three", "u5")], "body binary, url string")), path, "body", "url").count() == 1
    meta = sinks.read_records(spark, f"{path}/meta", "sha string, bytes int, url string").collect()
    assert sorted((r["bytes"], r["url"]) for r in meta) == [(3, "u2"), (3, "u3"), (5, "u5")]
