"""Each eviction policy over several micro-batches against a sequential restatement."""

import datetime
import random

import pytest

from tessera.streaming import caches

START = datetime.datetime(2024, 1, 1)


def restated(requests, policy, capacity, ttl):
    """Plain dictionaries: write times, last uses, and a scan for what goes."""
    made, used, out, clock = {}, {}, [], 0
    for ts, key in sorted(requests):
        at, clock = (ts - START).total_seconds(), clock + 1
        hit = key in made and (ttl is None or at - made[key] < ttl)
        gone = 0
        if hit and policy != "oldest":
            used[key] = clock
        if not hit:
            if policy == "recent":
                made.pop(key, None)
            n = len(made)
            if n >= capacity:
                want = {"oldest": capacity // 10, "recent": n - capacity + caches.SLACK, "bounded": 1}[policy]
                for k in sorted(made, key=lambda k: used[k])[:want]:
                    del made[k]
                    gone += 1
            made[key], used[key] = at, clock
        out.append((key, ts, hit, len(made), gone))
    return sorted(out)


@pytest.mark.parametrize(("policy", "capacity", "ttl"), [("oldest", 20, 300), ("recent", 130, 900), ("bounded", 12, None)])
def test_policy(spark, tmp_path, policy, capacity, ttl):
    rnd = random.Random(policy)
    requests, at = [], 0.0
    for _ in range(900):
        at += rnd.choice([0, 1, 1, 2, 5])
        requests.append((START + datetime.timedelta(seconds=at), f"k{min(int(rnd.paretovariate(0.6)), 400)}" if rnd.random() < 0.6 else f"u{rnd.randrange(300)}"))
    for i in range(3):
        part = requests[i * 300 : (i + 1) * 300]
        spark.createDataFrame(part, "ts timestamp, key string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema("ts timestamp, key string").parquet(f"{tmp_path}/in/*")
        q = caches.cached(stream, policy, capacity, ttl, late="1 day").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
    out = spark.read.parquet(f"{tmp_path}/out")
    got = sorted((r.key, r.ts, r.hit, r["size"], r.evicted) for r in out.collect())
    want = restated(requests, policy, capacity, ttl)
    assert got == want and sum(w[4] for w in want) > 10
    rate = caches.hit_rate(out).first()
    assert (rate.requests, rate.hits) == (900, sum(w[2] for w in want))


def test_a_timer_ends_an_idle_shard(spark, tmp_path):
    names = spark.range(40).selectExpr("concat('k', id) AS key", "pmod(xxhash64(concat('k', id)), 2) AS shard").collect()
    idle, busy = ([r.key for r in names if r.shard == i] for i in (0, 1))
    for i, (seconds, keys) in enumerate([(0, idle[:2]), (4000, busy[:1]), (8000, busy[:1]), (8001, idle[:1])]):
        spark.createDataFrame([(START + datetime.timedelta(seconds=seconds), k) for k in keys], "ts timestamp, key string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema("ts timestamp, key string").parquet(f"{tmp_path}/in/*")
        q = caches.cached(stream, "oldest", 20, 60, shards=2, late="1 second").writeStream.format("parquet").option("path", f"{tmp_path}/out/").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
    last = spark.read.parquet(f"{tmp_path}/out").filter("ts > '2024-01-01 02:13:20'").collect()
    assert [(r.key, r.hit, r["size"]) for r in last] == [(idle[0], False, 1)], "both entries had gone"


def test_a_batch_is_one_run(spark):
    rnd = random.Random(1)
    requests = [(START + datetime.timedelta(seconds=i), f"k{rnd.randrange(40)}") for i in range(500)]
    df = spark.createDataFrame(requests, "ts timestamp, key string").repartition(3)
    for policy, ttl in (("oldest", 60), ("bounded", None)):
        got = sorted((r.key, r.ts, r.hit, r["size"], r.evicted) for r in caches.cached(df, policy, 20, ttl).collect())
        assert got == restated(requests, policy, 20, ttl)
