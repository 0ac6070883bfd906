"""Checksums of large texts by blocks, joined as a tree, so that a change costs its blocks alone.

A text is cut into blocks of ``BLOCK`` bytes, a row each; ``FAN`` hashes in a row are joined
and hashed again until one is left, which is hashed once more even if it was alone.  A large
text is thus many rows, and its digest does not depend on how they are dealt.  ``update``
compares a cheap hash of each block first and computes the long one only where that differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK, FAN = 4096, 64


def _cut(files: DataFrame, size: int) -> DataFrame:
    """path, block, data: the bytes of each block; an empty or missing text has one empty block."""
    data = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(data, i * size + 1, F.lit(size)))
    return files.select("path", F.posexplode(cut).alias("block", "data"))


def blocks(files: DataFrame, size: int = BLOCK) -> DataFrame:
    """path, block, quick, hash of (path, content)."""
    return _cut(files, size).select("path", F.col("block").cast("long").alias("block"), F.xxhash64("data").alias("quick"), F.sha2("data", 256).alias("hash"))


def _joined(level: DataFrame, fan: int) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("block", "hash")))
    up = level.groupBy("path", F.floor(F.col("block") / fan).cast("long").alias("up")).agg(ordered.alias("parts"))
    return up.select("path", F.col("up").alias("block"), F.sha2(F.array_join(F.transform("parts", lambda p: p["hash"]), ""), 256).alias("hash"))


def digests(hashes: DataFrame, fan: int = FAN) -> DataFrame:
    """path, blocks, digest.  The number of levels follows the largest text: one number on the driver."""
    counts = hashes.groupBy("path").agg((F.max("block") + 1).alias("blocks"))
    most = counts.agg(F.max("blocks")).first()[0] or 1
    level = hashes.select("path", "block", "hash")
    while True:
        level = _joined(level, fan)
        most = -(-most // fan)
        if most <= 1:
            break
    return level.join(counts, "path").select("path", "blocks", F.col("hash").alias("digest"))


def update(stored: DataFrame, files: DataFrame, size: int = BLOCK) -> DataFrame:
    """path, block, quick, hash, changed: blocks of the files now, with the stored hash where a block is as it was."""
    old = stored.select("path", "block", F.col("quick").alias("was"), F.col("hash").alias("known"))
    now = _cut(files, size).select("path", F.col("block").cast("long").alias("block"), F.xxhash64("data").alias("quick"), "data").join(old, ["path", "block"], "left")
    same = F.coalesce(F.col("quick") == F.col("was"), F.lit(False))
    return now.select("path", "block", "quick", F.when(same, F.col("known")).otherwise(F.sha2("data", 256)).alias("hash"), (~same).alias("changed"))


def changes(stored: DataFrame, updated: DataFrame) -> DataFrame:
    """path, block, change: blocks of known files that are new, changed or gone."""
    known = stored.select("path").distinct()
    was, now = stored.select("path", "block", F.lit(True).alias("was")), updated.select("path", "block", "changed")
    both = was.join(now, ["path", "block"], "full").join(known, "path", "left_semi").join(updated.select("path").distinct(), "path", "left_semi")
    kind: Column = F.when(F.col("was").isNull(), "new").when(F.col("changed").isNull(), "gone").when(F.col("changed"), "changed")
    return both.select("path", "block", kind.alias("change")).filter("change IS NOT NULL")
