"""Three eviction policies as stateful operators over a stream of requests.

A request (key, ts) looks its key up and, at a miss, puts it in.  ``oldest`` keeps entries for
their time to live and, when full, drops the tenth that was written first; hits change
nothing.  ``recent`` also has a time to live and drops the least recently used ones, ``slack``
more than it must, so that it does so rarely.  ``bounded`` has no time to live and drops the
least recently used one.

Keys are dealt to shards of equal capacity by hash; a shard's entries are a map state in
RocksDB, of which a micro-batch writes back only what it changed.  In a batch they are an
ordered list: a hit moves its entry to the end, what goes is taken from the front.  A timer
at the end of the last entry's life drops a shard's entries once the watermark has passed it.
Requests of a shard are taken in order of time, then key; those later than ``late`` are left
out by the watermark.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, ts timestamp, hit boolean, size long, evicted long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Policy:
    """moves: a hit makes its entry the latest; purges: an expired entry goes before room is made; dropped: how many go at (size, capacity)."""

    moves: bool
    purges: bool
    dropped: Callable[[int, int], int]


SLACK = 100
POLICIES = {
    "oldest": Policy(False, False, lambda size, capacity: capacity // 10 if size >= capacity else 0),
    "recent": Policy(True, True, lambda size, capacity: size - capacity + SLACK if size >= capacity else 0),
    "bounded": Policy(True, False, lambda size, capacity: 1 if size >= capacity else 0),
}


class Cache(StatefulProcessor):
    """One shard."""

    def __init__(self, policy: str, capacity: int, ttl_ms: int | None):
        self.policy, self.capacity, self.ttl = policy, capacity, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "created long, rank long")
        self.ranks = handle.getValueState("ranks", "next long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["ts", "key"], kind="stable")
        policy, ends = POLICIES[self.policy], self.ttl or 1 << 62
        before = {k[0]: tuple(v) for k, v in self.entries.iterator()} if self.entries.exists() else {}
        held = OrderedDict(sorted(before.items(), key=lambda e: e[1][1]))
        rank = self.ranks.get()[0] if self.ranks.exists() else 0
        out = []
        for name, ts in zip(asked["key"], asked["ts"]):
            at, gone = int(ts.value // 1_000_000), 0
            entry = held.get(name)
            hit = entry is not None and at - entry[0] < ends
            rank += 1
            if hit and policy.moves:
                held[name] = (entry[0], rank)
                held.move_to_end(name)
            elif not hit:
                if entry is not None and policy.purges:
                    del held[name]
                gone = min(len(held), policy.dropped(len(held), self.capacity))
                for _ in range(gone):
                    held.popitem(last=False)
                held[name] = (at, rank)
                held.move_to_end(name)
            out.append((name, ts, hit, len(held), gone))
        for name in before.keys() - held.keys():
            self.entries.removeKey((name,))
        for name, entry in held.items():
            if before.get(name) != entry:
                self.entries.updateValue((name,), entry)
        self.ranks.update((rank,))
        if self.ttl and held:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(e[0] for e in held.values()) + self.ttl)
        yield pd.DataFrame(out, columns=["key", "ts", "hit", "size", "evicted"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.entries.clear()
        yield from ()

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """The state store that these operators need, for streams started from now on, and its coordinator, which a batch does not start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.streams.active  # noqa: B018


def cached(requests: DataFrame, policy: str, capacity: int, ttl_seconds: float | None = None, shards: int = 1, late: str = "1 hour") -> DataFrame:
    """key, ts, hit, size after it, and how many entries it made go, for each request (key, ts)."""
    prepare(requests.sparkSession)
    ttl = None if policy == "bounded" or ttl_seconds is None else int(ttl_seconds * 1000)
    keyed = requests.select("key", F.col("ts").cast("timestamp").alias("ts"), F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    keyed = keyed.withWatermark("ts", late) if ttl else keyed
    return keyed.groupBy("shard").transformWithStateInPandas(Cache(policy, max(1, capacity // shards), ttl), OUT, "Append", "EventTime" if ttl else "None")


def hit_rate(results: DataFrame) -> DataFrame:
    """Requests, hits, their share and evictions so far."""
    return results.agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"), (F.count_if("hit") / F.count("*")).alias("hit_rate"), F.sum("evicted").alias("evicted"))
