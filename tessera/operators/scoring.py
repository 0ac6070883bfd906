"""Relevance features, their weighted sums, and the registry of user scorers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import paths, text, vectors

WEIGHTS = {"semantic": 0.40, "proximity": 0.20, "symbol": 0.25, "recency": 0.10, "frequency": 0.05}
STORE_WEIGHTS = {"semantic": 0.40, "proximity": 0.25, "symbol": 0.20, "recency": 0.10, "frequency": 0.05}
PREFERRED = ("/src/", "/lib/", "/components/", "/utils/", "/services/")


def usage_stats(usage: DataFrame) -> DataFrame:
    """chunk_id, total, helpful, helpful_ratio, boost, frequency: one aggregation, joined later."""
    g = usage.groupBy("chunk_id").agg(F.count("*").alias("total"), F.count_if(F.col("helpful")).alias("helpful"))
    ratio, boost = F.col("helpful") / F.col("total"), F.least(F.lit(1.0), F.col("total") / 10)
    return g.select("chunk_id", "total", "helpful", ratio.alias("helpful_ratio"), boost.alias("boost"), (ratio * boost).alias("frequency"))


def recent_usage(usage: DataFrame, now: Column, days: int = 90, until: Column | None = None) -> DataFrame:
    """Usage from ``days`` before ``now`` on, up to ``until`` if given, both bounds included."""
    recent = usage.filter(F.col("ts") >= now - F.expr(f"interval {days} days"))
    return recent if until is None else recent.filter(F.col("ts") <= until)


def add_usage(usage: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """The usage history with further entries (chunk_id, helpful), used now unless they say when."""
    when = F.coalesce("ts", now) if "ts" in entries.columns else now
    return usage.unionByName(entries.select("chunk_id", when.alias("ts"), "helpful"))


def normalized_breakdown(df: DataFrame, names: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """Feature columns clamped to 0..1; null and not-a-number count as 0."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))))
    return df.withColumns({n: clamp(F.col(n)) for n in names})


def symbol_match(name: Column, entities: Column) -> Column:
    """Best match of a name over symbol and keyword entities; 0 without any."""
    wanted = F.filter(entities, lambda e: e["type"].isin("symbol", "keyword"))
    return F.coalesce(F.array_max(F.transform(wanted, lambda e: text.symbol_score(name, e["value"]))), F.lit(0.0))


def features(chunks: DataFrame, query_vector: Column, current_file: Column, entities: Column, now: Column, usage: DataFrame) -> DataFrame:
    """Five features a chunk.  Proximity is computed once a file, usage joined as an aggregate."""
    f = chunks.join(usage_stats(usage).select("chunk_id", "frequency"), "chunk_id", "left")
    return f.select(
        "*", vectors.similarity(F.col("embedding"), query_vector).alias("semantic"), paths.proximity(F.col("path"), current_file).alias("proximity"),
        symbol_match(F.col("name"), entities).alias("symbol"), text.recency(F.col("modified"), now).alias("recency"),
    ).withColumn("frequency", F.coalesce("frequency", F.lit(0.0)))


def weighted(weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum of feature columns, each within 0..1."""
    if abs(sum(weights.values()) - 1) > 0.01:
        raise ValueError("weights must sum to 1")
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.lit(w) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(name)))
    return out


def memory_store_score(semantic: Column, path: Column, age: Column, accesses: Column) -> Column:
    """The in-memory store's blend: folder, e^(-0.1 days), accesses up to 100."""
    near = F.when(F.contains(path, F.lit("/src/")), 1.0).when(F.contains(path, F.lit("/lib/")), 0.8).otherwise(0.5)
    return 0.40 * semantic + 0.25 * near + 0.10 * F.exp(-0.1 * age) + 0.05 * F.least(accesses / 100, F.lit(1.0))


def table_store_score(semantic: Column, path: Column, n_symbols: Column, age: Column) -> Column:
    """The table store's blend: folder kind, symbols present, 0.9 ^ (days / 30) from 0.1."""
    preferred = F.lit(False)
    for p in PREFERRED:
        preferred = preferred | F.contains(path, F.lit(p))
    near = F.when(preferred, 1.0).when(F.contains(path, F.lit("/test/")) | F.contains(path, F.lit("/tests/")), 0.7).when(F.contains(path, F.lit("/config/")) | F.contains(path, F.lit(".config.")), 0.6).otherwise(0.8)
    return 0.40 * semantic + 0.25 * near + 0.20 * F.when(n_symbols > 0, 1.0).otherwise(0.5) + 0.10 * F.greatest(F.lit(0.1), F.pow(F.lit(0.9), age / 30)) + 0.05 * 0.5


@dataclass
class ScorerRegistry:
    """User scorers, each a function from the query to a column, and their weights."""

    scorers: dict[str, tuple[Callable[..., Column], float]] = field(default_factory=dict)

    def register(self, name: str, scorer: Callable[..., Column], weight: float = 1.0) -> None:
        if weight <= 0:
            raise ValueError("a weight must be positive")
        self.scorers[name] = (scorer, weight)

    def unregister(self, name: str) -> bool:
        return self.scorers.pop(name, None) is not None

    def score(self, df: DataFrame, *query, out: str = "score") -> DataFrame:
        """Weighted mean over registered scorers; each score stays as a column of its own."""
        if not self.scorers:
            return df.withColumn(out, F.lit(0.0))
        for name, (scorer, _) in self.scorers.items():
            df = df.withColumn(f"score_{name}", scorer(*query))
        total = sum(w for _, w in self.scorers.values())
        mean = F.lit(0.0)
        for name, (_, w) in self.scorers.items():
            mean = mean + F.col(f"score_{name}") * w
        return df.withColumn(out, mean / total)
