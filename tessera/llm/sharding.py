"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that must stay together.  Groups, largest first, go to
the least-loaded shard, which a heap gives.  The heap runs on the driver over a bounded
number of units: every group above 1/65,536 of all bytes is a unit of its own (fewer than
65,536 can exist), the smaller groups are bundled by a hash into 16,384 units.  Both bounds
hold at any input size, so the table of units and its broadcast are bounded too.  What
bundling costs is bounded: a longest-first schedule ends within its last unit of the mean,
and a bundle is about 1/16,384 of what is bundled, or a thousandth of one of 16 shards.

Texts never move: one narrow scan stages id, size, checksum and group; groups are summed
with map-side partial sums, so a group with a third of all rows is a row per map task.

Cases: null and empty texts have size 1 and are one group; a null id is a valid id; repeated
rows each keep a slot of their own; an empty table gives an empty table.  Only the columns
named in the result are read, so clashing extra columns do no harm.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.staging import Stage

HEAVY = 65_536
BUNDLES = 16_384
CELLS = 512


def lpt(sizes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(kind, key, size) units to (kind, key, shard): largest first onto the least load."""
    loads = [(0, s) for s in range(shards)]
    out = []
    for kind, key, size in sorted(sizes, key=lambda u: (-u[2], u[0], u[1])):
        load, s = heapq.heappop(loads)
        out.append((kind, key, s))
        heapq.heappush(loads, (load + size, s))
    return out


def shard_documents(df: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", heavy_share: int = HEAVY, bundles: int = BUNDLES) -> DataFrame:
    """Rows of ``df`` as doc_id, size, text_crc32, shard and a gapless slot in the shard."""
    spark = df.sparkSession
    stage = Stage(spark, "sharding")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stage.put("rows", df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("grp")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    heavy = F.col("bytes") * heavy_share > total
    bundle = F.pmod("grp", F.lit(bundles))
    units = groups.groupBy(heavy.cast("int").alias("kind"), F.when(heavy, F.col("grp")).otherwise(bundle).alias("key")).agg(F.sum("bytes").alias("bytes"))
    placed = lpt([tuple(u) for u in units.collect()], shards)
    at = spark.createDataFrame(placed or [(0, 0, 0)], "kind int, key long, shard int")
    own = F.broadcast(at.filter("kind = 1").select(F.col("key").alias("grp"), F.col("shard").alias("own_shard")))
    shared = F.broadcast(at.filter("kind = 0").select(F.col("key").alias("bundle"), F.col("shard").alias("bundle_shard")))
    there = (
        rows.join(own, "grp", "left").withColumn("bundle", bundle).join(shared, "bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "bundle_shard").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int").alias("cell"))
    )
    # Slots: cells of a shard are numbered apart and shifted by the rows of the cells before.
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = there.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        there.withColumn("nth", F.row_number().over(within)).join(F.broadcast(shift), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("shift") + F.col("nth") - 1).cast("long").alias("slot"))
    )


def write_shards(df: DataFrame, placed: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write ``df`` as one folder a shard; slots order the rows of a shard.

    Rows of one id and text are alike, so they are numbered on both sides and each takes one place.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keys = lambda *c: Window.partitionBy(*c)
    rows = df.withColumn("_crc", F.crc32(body.cast("binary"))).withColumn("_size", (F.octet_length(body) + 1).cast("long"))
    rows = rows.withColumn("_nth", F.row_number().over(keys(F.col(doc_id), "_crc", "_size").orderBy(F.lit(0))))
    there = placed.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_c"), F.col("size").alias("_s"), "shard", "slot")
    there = there.withColumn("_n", F.row_number().over(keys("_id", "_c", "_s").orderBy("shard", "slot")))
    joined = rows.join(there, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_crc") == F.col("_c")) & (F.col("_size") == F.col("_s")) & (F.col("_nth") == F.col("_n")))
    out = joined.select(*(F.col(c) for c in df.columns), "shard", "slot")
    out.repartition("shard", F.pmod(F.col("slot"), F.lit(64))).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
