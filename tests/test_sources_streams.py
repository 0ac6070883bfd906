"""File sources, sinks and streams on temporary folders; the driver's contract."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.operators import incremental
from tessera.sources import files
from tessera.streaming import state

DATA = "/root/testdata/sf0.001"


def test_walk_and_validation(spark, tmp_path):
    for name, body in {"src/a.ts": "let a = 1;", "src/b.py": "x = 1", "node_modules/c.ts": "no", "big.ts": "x" * 5000}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = files.as_text(files.walk(spark, str(tmp_path), max_size=1000, extensions=files.EXTENSIONS)).collect()
    assert {(r.path.rsplit("/", 1)[1], r.language) for r in got} == {("a.ts", "typescript"), ("b.py", "python")}
    assert files.apply_ignore_rules(files.walk(spark, str(tmp_path)), ["# c", "", "src/"]).count() == 1
    good, bad = files.split_valid(files.payload(spark, [("a", "x", "t"), ("../a", "x", "t"), ("b", "", "t")]))
    assert [r.path for r in good.collect()] == ["a"] and {r.reason for r in bad.collect()} == {"invalid path", "empty content"}
    with pytest.raises(ValueError):
        files.payload(spark, [("a", "x", "t")] * 101)


def test_json_backup_restore(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    files.write_json(df, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j"), "id long, v string", multi_line=False).count() == 3
    n = files.process_json(spark, str(tmp_path / "j"), str(tmp_path / "k"), "id long, v string", F.col("id") > 1, [F.col("id")])
    assert n == 2
    files.backup(df, str(tmp_path / "b"), "1")
    with pytest.raises(Exception, match="exists"):
        files.backup(df, str(tmp_path / "b"), "1")
    assert files.restore(spark, str(tmp_path / "b"), "1", df, "safety").count() == 3
    files.export(df, str(tmp_path / "e"), "orc")
    assert files.load_export(spark, str(tmp_path / "e"), "orc").count() == 3


def events(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    return state.read_folder(spark, str(tmp_path / "in"), schema)


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_stream_windows(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=m), "view", 1.0, 7) for m in (0, 5, 61, 400)]
    s = events(spark, tmp_path, rows, "ts timestamp, event_type string, value double, user_id long")
    drained(state.usage_windows(s), "usage_windows", "complete")
    assert sorted(r.n for r in spark.table("usage_windows").collect()) == [1, 1, 2]


def test_stream_budget_and_cache(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [(i, t + dt.timedelta(minutes=i), 600_000) for i in range(4)] + [(9, t + dt.timedelta(days=1), 600_000)]
    drained(state.budget_gate(events(spark, tmp_path / "a", rows, "id long, ts timestamp, tokens long")), "budget")
    assert {r.id: r.affordable for r in spark.table("budget").collect()} == {0: True, 1: True, 2: False, 3: False, 9: True}
    keys = [("a", 0), ("b", 1), ("a", 2), ("c", 3), ("b", 4), ("a", 5), ("a", 100)]
    s = events(spark, tmp_path / "b", [(k, t + dt.timedelta(seconds=x)) for k, x in keys], "key string, ts timestamp")
    drained(state.cache_hits(s, 2, 60), "cache")
    assert [r.hit for r in spark.table("cache").orderBy("ts").collect()] == [False, False, True, False, False, False, False]


def test_stream_upsert(spark, tmp_path):
    s = events(spark, tmp_path, [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id long, version long, v string")
    held = {}

    def merge(batch, _):
        old = spark.createDataFrame(list(held.values()), batch.schema) if held else batch.limit(0)
        for r in incremental.upsert(old, batch, ["id"], "version").collect():
            held[r.id] = tuple(r)

    state.upsert_sink(s, merge, str(tmp_path / "cp")).awaitTermination(120)
    assert held == {1: (1, 2, "b"), 2: (2, 1, "c")}


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() == 10
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
