"""Change detection, upserts, soft deletes and tombstones, as joins over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def changes(files: DataFrame, index: DataFrame, mode: str = "mtime_then_checksum") -> DataFrame:
    """path, action: ``new``, ``changed``, ``refresh`` (only the time is newer) or ``unchanged``.

    files and index: path, mtime, checksum.  ``checksum`` and ``mtime`` judge by one of them.
    """
    i = index.select("path", F.col("mtime").alias("old_mtime"), F.col("checksum").alias("old_checksum"))
    j = files.join(i, "path", "left")
    same_sum, older = F.col("checksum").eqNullSafe(F.col("old_checksum")), F.col("mtime") <= F.col("old_mtime")
    new = F.col("old_checksum").isNull() & F.col("old_mtime").isNull()
    by = {
        "mtime_then_checksum": F.when(older, "unchanged").when(~same_sum, "changed").otherwise("refresh"),
        "checksum": F.when(same_sum, "unchanged").otherwise("changed"),
        "mtime": F.when(older, "unchanged").otherwise("changed"),
    }[mode]
    return j.withColumn("action", F.when(new, "new").otherwise(by)).select(*files.columns, "action")


def deleted(files: DataFrame, index: DataFrame) -> DataFrame:
    """Tracked paths that are there no more."""
    return index.join(files.select("path"), "path", "left_anti")


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], version: str) -> DataFrame:
    """Latest row a key.  ``max_by`` sums up before the shuffle, so hot keys stay small."""
    both = current.withColumn("_gen", F.lit(0)).unionByName(incoming.withColumn("_gen", F.lit(1)))
    rest = [c for c in current.columns if c not in key]
    latest = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, "_gen")).alias("row"))
    return latest.select(*key, "row.*").select(current.columns)


def soft_delete(df: DataFrame, gone: DataFrame, key: str, now: Column) -> DataFrame:
    """Set ``deleted_at`` of live rows that are named."""
    marked = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    j = df.join(marked, key, "left")
    return j.withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).select(df.columns)


def live(df: DataFrame) -> DataFrame:
    return df.filter("deleted_at is null")


def tombstones(files: DataFrame, index: DataFrame, now: Column) -> DataFrame:
    return deleted(files, index).select("path", now.alias("deleted_at"), F.lit(False).alias("cleaned_up"))


def clean_up(chunks: DataFrame, stones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks without those of deleted files, and the tombstones marked as done."""
    gone = stones.filter("not cleaned_up").select("path").distinct()
    return chunks.join(gone, "path", "left_anti"), stones.withColumn("cleaned_up", F.lit(True))


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key).distinct(), key, "left_semi")


def chunk_counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files with the number of their chunks, derived rather than kept by triggers."""
    n = chunks.groupBy("path").agg(F.count("*").alias("chunk_count"))
    return files.drop("chunk_count").join(n, "path", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def index_run(files: DataFrame, index: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an incremental run has to do: files to index, index rows afterwards, tombstones."""
    judged = changes(files, index)
    todo = judged.filter("action in ('new', 'changed')")
    after = upsert(index.join(files.select("path"), "path", "left_semi"), files.select(index.columns), ["path"], "mtime")
    return todo, after, tombstones(files, index, now)


def snapshots_diff(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each snapshot beside the one before of the same key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("changed", ~F.col(value).eqNullSafe(F.col("previous")))


def reembed(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks that have a vector, to be given new ones, matched by id and never by position."""
    return chunks.join(vectors.select("chunk_id", F.col("embedding").alias("new_embedding")), "chunk_id", "left")
