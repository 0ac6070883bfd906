"""Suggestions from a kept table: the best queries of each prefix, updated by small deltas.

``counts`` has each query's uses and ``index`` the best ``top`` queries of each prefix of up to
``LONGEST`` characters.  Counts only grow, so what is best after an update was best before or
has just grown: an update reads and writes only prefixes of the queries in the delta.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

LONGEST, TOP = 20, 10


def counts(history: DataFrame, query: str = "query") -> DataFrame:
    """query, n: lower-case queries and their uses."""
    q = F.lower(F.col(query))
    return history.filter(F.length(q) > 0).groupBy(q.alias("query")).agg(F.count("*").alias("n"))


def _prefixes(counted: DataFrame) -> DataFrame:
    reach = F.sequence(F.lit(1), F.least(F.length("query"), F.lit(LONGEST)))
    return counted.select(F.explode(F.transform(reach, lambda k: F.substr("query", F.lit(1), k))).alias("prefix"), "query", "n")


def _best(rows: DataFrame, top: int) -> DataFrame:
    # A window of row numbers under a limit is cut down before its shuffle, so short prefixes stay small.
    nth = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("n"), "query"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= top)


def build(counted: DataFrame, top: int = TOP) -> DataFrame:
    """prefix, query, n, nth."""
    return _best(_prefixes(counted), top)


def update(index: DataFrame, counted: DataFrame, history: DataFrame, top: int = TOP, query: str = "query") -> tuple[DataFrame, DataFrame]:
    """The index and the counts after further uses."""
    delta = counts(history, query)
    grown = delta.withColumnRenamed("n", "more").join(counted, "query", "left").select("query", (F.col("more") + F.coalesce("n", F.lit(0))).alias("n"))
    touched = _prefixes(grown)
    names = touched.select("prefix").distinct()
    rest = index.join(names, "prefix", "left_semi").join(touched.select("prefix", "query"), ["prefix", "query"], "left_anti").select("prefix", "query", "n")
    fresh = _best(rest.unionByName(touched), top)
    merged = index.join(names, "prefix", "left_anti").select("prefix", "query", "n", "nth").unionByName(fresh)
    return merged, counted.join(delta, "query", "left_anti").unionByName(grown)


def suggest(index: DataFrame, prefix: str, limit: int = TOP) -> DataFrame:
    """query, n of the best queries with a prefix, from its rows of the index; longer prefixes than are kept are filtered."""
    p = prefix.lower()
    hits = index.filter(F.col("prefix") == p[:LONGEST])
    return hits.filter(F.startswith("query", F.lit(p))).select("query", "n").orderBy(F.desc("n"), "query").limit(limit)
