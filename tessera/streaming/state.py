"""Streams: windowed usage, budgets by day, bounded caches with time to live, upserting sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import routing


def read_folder(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """Files that appear in a folder."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).parquet(path)


def usage_windows(events: DataFrame, size: str = "1 hour", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and sums by window; events later than ``late`` are left out.  (Extension.)"""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """Sessions that end after ``gap`` without events.  (Extension.)"""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), by, "n")


BUDGET_OUT = "id long, day date, units double, remaining double, affordable boolean"


def budget_gate(requests: DataFrame, limit: float = routing.DAILY_UNITS, shards: int = 1) -> DataFrame:
    """id, units, affordable for requests (id, ts, tokens), by UTC day.

    Only affordable requests are billed.  With more shards each has its part of the limit, so
    that one day's state is not one task.
    """

    def gate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0.0
        rows = []
        for r in pd.concat(list(batches)).sort_values(["ts", "id"]).itertuples():
            cost = routing.UNITS_PER_MILLION * r.tokens / 1_000_000
            left = max(0.0, limit / shards - used)
            fits = cost <= left
            used += cost if fits else 0.0
            rows.append((r.id, key[0], cost, left, fits))
        state.update((used,))
        yield pd.DataFrame(rows, columns=["id", "day", "units", "remaining", "affordable"])

    keyed = requests.withColumn("day", F.to_date("ts")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return keyed.groupBy("day", "shard").applyInPandasWithState(gate, BUDGET_OUT, "used double", "append", GroupStateTimeout.NoTimeout)


CACHE_OUT = "key string, ts timestamp, hit boolean, size long"


def cache_hits(requests: DataFrame, capacity: int, ttl_seconds: float, shards: int = 1) -> DataFrame:
    """Whether each request (key, ts) hits a cache of ``capacity`` entries with time to live.

    Hits renew an entry's last access; beyond capacity the least recently accessed goes.  The
    cache is split by key hash into shards of equal capacity.
    """

    def lookup(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, list[float]] = {k: [c, a] for k, c, a in zip(*state.get)} if state.exists else {}
        rows = []
        for r in pd.concat(list(batches)).sort_values(["ts", "key"]).itertuples():
            at = r.ts.timestamp()
            hit = r.key in held and at - held[r.key][0] < ttl_seconds
            if hit:
                held[r.key][1] = at
            else:
                held[r.key] = [at, at]
                while len(held) > max(1, capacity // shards):
                    del held[min(held, key=lambda k: (held[k][1], k))]
            rows.append((r.key, r.ts, hit, len(held)))
        state.update((list(held), [v[0] for v in held.values()], [v[1] for v in held.values()]))
        yield pd.DataFrame(rows, columns=["key", "ts", "hit", "size"])

    keyed = requests.select("key", "ts", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    return keyed.groupBy("shard").applyInPandasWithState(lookup, CACHE_OUT, "keys array<string>, created array<double>, accessed array<double>", "append", GroupStateTimeout.NoTimeout)


def evict(entries: DataFrame, capacity: int, slack: int = 100) -> DataFrame:
    """Entries to drop from a batch cache: past capacity, the least recently accessed and ``slack`` more."""
    over = max(0, entries.count() - capacity)
    return entries.orderBy("accessed", "key").limit(over + slack if over else 0)


def rate_limited(requests: DataFrame, most: int, hours: int = 24) -> DataFrame:
    """Whether a request is within ``most`` of its user in the hours before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-hours * 3600, 0)
    return requests.withColumn("in_window", F.count("*").over(w)).withColumn("allowed", F.col("in_window") <= most)


def upsert_sink(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``merge`` on each micro-batch once its input is complete."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
