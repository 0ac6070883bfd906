"""Vector search: exact by default, by signed-projection buckets on request."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import paths, vectors

PRESETS = {"fast": (4, 8), "default": (8, 8), "accurate": (16, 6)}  # tables, bits


def with_norm(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Precompute the norm, so that each search only multiplies once."""
    return df.withColumn("norm", vectors.magnitude(F.col(vector)))


def literal(v: list[float]) -> Column:
    """A query vector as a constant of the plan: no join is needed to compare with it."""
    return F.array(*[F.lit(float(x)) for x in v])


def filters(df: DataFrame, language: str | list[str] | None = None, prefix: str | None = None, pattern: str | None = None, created_after: Column | None = None, created_before: Column | None = None) -> DataFrame:
    """Live rows by language (or a list of those allowed), path prefix, path substring without its first star, and time."""
    if "deleted_at" in df.columns:
        df = df.filter("deleted_at is null")
    if language is not None:
        df = df.filter(F.col("language").isin(language))
    if prefix is not None:
        df = df.filter(F.startswith("path", F.lit(prefix)))
    if pattern is not None:
        df = df.filter(F.contains("path", F.lit(paths.first_star_removed(pattern))))
    if created_after is not None:
        df = df.filter(F.col("created_at") >= created_after)
    if created_before is not None:
        df = df.filter(F.col("created_at") <= created_before)
    return df


def clamp(limit: int | None, min_score: float = 0.0) -> tuple[int, float]:
    return max(1, min(limit or 10, 100)), max(0.0, min(1.0, min_score))


def top_k(df: DataFrame, query: list[float], k: int = 10, min_score: float = 0.0, vector: str = "embedding", key: str = "id", digits: int | None = None) -> DataFrame:
    """Best ``k`` by cosine, ties by key; filters belong before, so they prune the scan."""
    score = vectors.cosine(F.col(vector), literal(query), norm_a=F.col("norm") if "norm" in df.columns else None, norm_b=F.lit(float(np.linalg.norm(query))))
    score = score if digits is None else F.round(score, digits)
    return df.withColumn("score", score).filter(F.col("score") >= min_score).orderBy(F.desc("score"), key).limit(k)


def prefetched(df: DataFrame, query: list[float], k: int, keep: Column, key: str = "id", **options) -> DataFrame:
    """Best ``2 k``, then the filter, then ``k``: may give fewer than ``k``."""
    return top_k(df, query, 2 * k, key=key, **options).filter(keep).orderBy(F.desc("score"), key).limit(k)


def ranked(df: DataFrame, key: str = "id") -> DataFrame:
    """Rank of a top-k result (bounded by k) and distance 1 - score."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key))).withColumn("distance", 1 - F.col("score"))


def by_example(df: DataFrame, example_id: int, k: int = 10, vector: str = "embedding", key: str = "id") -> DataFrame:
    """Rows most similar to one row, itself left out.  The example is one row, broadcast."""
    q = df.filter(F.col(key) == example_id).select(F.col(vector).alias("q")).limit(1)
    return df.filter(F.col(key) != example_id).crossJoin(F.broadcast(q)).withColumn("score", vectors.cosine(F.col(vector), F.col("q"))).drop("q").orderBy(F.desc("score"), key).limit(k)


def centroids(df: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Element-wise mean a group; partial sums before the shuffle."""
    flat = df.select(by, F.posexplode(vectors.doubles(F.col(vector))).alias("pos", "x"))
    means = flat.groupBy(by, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("centroid"))


def buckets(df: DataFrame, dim: int, preset: str = "default", vector: str = "embedding", seed: int = 11) -> DataFrame:
    """One row a table: the bucket of a vector's signs under random projections."""
    tables, bits = PRESETS[preset]
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dim))

    def code(t: int) -> Column:
        out = F.lit(0)
        for b in range(bits):
            out = out + F.when(vectors.dot(F.col(vector), literal(planes[t, b].tolist())) > 0, 1 << b).otherwise(0)
        return F.struct(F.lit(t).alias("tbl"), out.alias("bucket"))

    return df.withColumn("b", F.explode(F.array(*[code(t) for t in range(tables)]))).select("*", "b.tbl", "b.bucket").drop("b")


def approximate(df: DataFrame, query: list[float], k: int = 10, preset: str = "default", vector: str = "embedding", key: str = "id") -> DataFrame:
    """Best ``k`` among rows that share a bucket with the query, scored exactly."""
    dim = len(query)
    one = df.sparkSession.range(1).select(literal(query).alias(vector))
    wanted = buckets(one, dim, preset, vector).select("tbl", "bucket")
    near = buckets(df, dim, preset, vector).join(F.broadcast(wanted), ["tbl", "bucket"]).drop("tbl", "bucket").dropDuplicates([key])
    return top_k(near, query, k, vector=vector, key=key)


def add(index: DataFrame, rows: DataFrame, dim: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The index with further rows.  A vector of another length, a missing one, or an id that is there already raises."""
    length = F.coalesce(F.size(vector), F.lit(-1))
    fitting = rows.withColumn(vector, F.when(length == dim, F.col(vector)).otherwise(F.raise_error(F.concat(F.lit(f"vector of {dim} dimensions expected, got "), length.cast("string")))))
    both = index.select(key, vector, F.lit(0).alias("_new")).unionByName(fitting.select(key, vector, F.lit(1).alias("_new")))
    merged = both.groupBy(key).agg(F.first(vector).alias(vector), F.count("*").alias("_n"))
    return merged.select(F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("duplicate id "), F.col(key).cast("string")))).alias(key), vector)


def save_index(df: DataFrame, path: str, dim: int, preset: str = "default", vector: str = "embedding") -> None:
    """Store a table with its buckets: a search then reads the files of its own buckets alone."""
    b = buckets(df, dim, preset, vector)
    b.repartition("tbl", "bucket").write.mode("overwrite").partitionBy("tbl", "bucket").parquet(path)


def search_index(spark, path: str, query: list[float], k: int = 10, preset: str = "default", vector: str = "embedding", key: str = "id") -> DataFrame:
    """Best ``k`` of a stored index among rows that share a bucket with the query, scored exactly."""
    one = spark.range(1).select(literal(query).alias(vector))
    wanted = [(r.tbl, r.bucket) for r in buckets(one, len(query), preset, vector).select("tbl", "bucket").collect()]  # one a table
    probe = F.lit(False)
    for t, b in wanted:
        probe = probe | ((F.col("tbl") == t) & (F.col("bucket") == b))
    near = spark.read.parquet(path).filter(probe).drop("tbl", "bucket").dropDuplicates([key])
    return top_k(near, query, k, vector=vector, key=key)


def get_batch(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def raw(df: DataFrame, limit: int = 10) -> DataFrame:
    """A glance: content prefix of 100 characters, first five dimensions."""
    return df.orderBy("id").limit(limit).select("id", F.substring("content", 1, 100).alias("content"), F.slice("embedding", 1, 5).alias("embedding"))
