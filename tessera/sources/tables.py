"""Readers of the tables and the collection they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, language: documents as files of a project."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", F.lit("/repo"), "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("text").alias("content"), F.col("lang").alias("language"), "doc_id")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, prompt: user turns."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("prompt"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, ts, helpful: events as usage history."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 50).alias("chunk_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").isin("click", "purchase").alias("helpful"))
