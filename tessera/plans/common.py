"""What queries share: tables as the engine's inputs, their SQL, fixed times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.sources.tables import files, prompts, table, usage

__all__ = ["FILES", "NOW", "NOW_SQL", "CHUNKS", "chunks", "files", "history", "now", "prompts", "r6", "table", "usage", "vector_rows"]

NOW = "2024-02-01 00:00:00"
NOW_SQL = "TIMESTAMP '2024-02-01 00:00:00'"
FILES = "files AS (SELECT doc_id, '/repo/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content, lang AS language FROM documents)"
CHUNKS = FILES + ", chunks AS (SELECT doc_id AS chunk_id, path, content, language, embedding, label FROM files JOIN embeddings ON vec_id = doc_id)"


def now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a vector: one equi-join."""
    f = files(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    return f.join(e, f.doc_id == e.vec_id).select(F.col("doc_id").alias("chunk_id"), "path", "content", "language", "embedding", "label")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, user_id, ts: what users searched for, from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat_ws(" ", "event_type", (F.col("user_id") % 20).cast("string")).alias("query"), "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
