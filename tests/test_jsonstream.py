"""JSON values in byte ranges against one parse of the whole."""

import json
import os
import pickle
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import jsonstream


def value(rnd, depth=0):
    kind = rnd.randint(0, 5 if depth < 3 else 3)
    if kind == 4:
        return [value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    if kind == 5:
        return {rnd.choice(['a"', "b\\", "{", "é]"]) + str(i): value(rnd, depth + 1) for i in range(rnd.randint(0, 3))}
    return rnd.choice(["", '"', "\\", '\\"', "}{", "][", "\n\t", "😀", "x" * 30, 1.5, None, True])


def test_ranges_equal_one_parse(spark, tmp_path):
    rnd = random.Random(3)
    want = []
    for name in ("a", "b"):
        objects = [rnd.choice([dict, list])(rnd.choice([[], [("k", value(rnd))], [("v", value(rnd)), ("w", value(rnd))]])) for _ in range(40)]
        objects = [list(map(list, o)) if isinstance(o, list) else o for o in objects]
        text = "".join(json.dumps(o, indent=rnd.choice([None, 2]), ensure_ascii=rnd.random() < 0.5) + rnd.choice(["", " ", "\n", ' 12 "}" ']) for o in objects)
        (tmp_path / f"{name}.json").write_bytes(text.encode())
        want += objects
    for size in (7, 64, 1 << 20):
        rows = jsonstream.read(spark, str(tmp_path), size).orderBy("path", "offset").collect()
        assert [json.loads(r.value) for r in rows] == want and not any(r.error for r in rows)


def test_sums_chain():
    rnd = random.Random(4)
    for _ in range(300):
        data = "".join(rnd.choices('{}[]"\\a', k=rnd.randint(0, 24))).encode()
        for state in (0, 1, 2):
            s, d = state, 0
            for x in data:
                c = chr(x)
                if s == jsonstream.ESCAPED:
                    s = jsonstream.INSIDE
                elif s == jsonstream.INSIDE:
                    s = jsonstream.OUTSIDE if c == '"' else jsonstream.ESCAPED if c == "\\" else s
                else:
                    s = jsonstream.INSIDE if c == '"' else s
                    d += (c in "{[") - (c in "}]")
            assert jsonstream.summed(data, state) == (s, d), (data, state)


def test_arrays_tails_and_errors(spark, tmp_path):
    def rows(text, size=5, level=0):
        p = tmp_path / "x.json"
        p.write_text(text)
        return [(r.offset, r.value, r.error) for r in jsonstream.read(spark, str(p), size, level).orderBy("offset").collect()]

    assert rows('[{"a": "]"}, [1], {"b": {}}]', level=1) == [(1, '{"a": "]"}', None), (13, "[1]", None), (18, '{"b": {}}', None)]
    assert rows('{"a": 1}{"b": [1, 2') == [(0, '{"a": 1}', None), (8, None, "does not end")]
    assert rows('{"a": 1} {"b": "open') == [(0, '{"a": 1}', None), (9, None, "does not end")]
    assert rows('{"a": [1}') == [(0, None, "} at 8 closes [")]
    assert ("]", "closes nothing") == (rows('{} ] {"a": 1}', 100)[1][2].split()[0], "closes nothing")
    assert rows("") == [] and rows(' 1 "text" ') == []


def test_writer_commits_once(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(50).select(F.to_json(F.struct("id", F.lit('} "').alias("s"))).alias("value")).repartition(4)
    jsonstream.write(df, out)
    assert "_SUCCESS" in os.listdir(out) and not any(x.startswith("_temporary") for x in os.listdir(out))
    back = jsonstream.read(spark, out, 100).select(F.from_json("value", "id long, s string").alias("v")).select("v.id", "v.s")
    assert sorted(r.id for r in back.collect()) == list(range(50)) and back.filter("s <> '} \"'").count() == 0
    jsonstream.write(df.limit(3), out, "overwrite")
    assert jsonstream.read(spark, out).count() == 3
    fails = df.withColumn("value", F.when(F.crc32("value") % 7 == 0, F.raise_error(F.lit("stop"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stop"):
        jsonstream.write(fails, out)
    assert jsonstream.read(spark, out).count() == 3 and not any(x.startswith("_temporary") for x in os.listdir(out))


def test_tasks_hold_many_ranges(spark, tmp_path):
    """ranges of 64 bytes are read in as many tasks as there are cores, and a task is sent its own alone."""
    want = ["é" * (i % 90) + "{" for i in range(3000)]
    (tmp_path / "x.json").write_text("".join(json.dumps({"i": i, "s": s}) for i, s in enumerate(want)))
    df = jsonstream.read(spark, str(tmp_path), 64)
    assert df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got = {v["i"]: v["s"] for v in (json.loads(r.value) for r in df.collect())}
    assert got == dict(enumerate(want))
    ranges = jsonstream.plan(spark, [str(tmp_path / "x.json")], 64)
    assert [r for t in jsonstream.tasks(ranges, 7) for r in t] == ranges and len(jsonstream.tasks(ranges, 7)) == 7
    small, large = (len(pickle.dumps(jsonstream._Reader(r, 0, 7))) for r in (ranges[:1], ranges))
    assert small == large
