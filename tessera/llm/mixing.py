r"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are words.  Targets share ``share`` of all words by weight; none goes above
``most`` times its source's size, and what it leaves is shared by weight among the others
(one pass over sources ordered by cap / weight finds the level at which none is above).
The mix consists of ``BLOCKS`` equal-token blocks.  Seats are given to sources by highest
quotients target / (2k + 1); every ``1 / SHARDS`` of the successive seats is one output
shard, which is house-monotone, so each shard has integer quotas and all shards together
have the quotas of the whole mix.  A source's documents in seeded order form a stream cut
into blocks; its seats take blocks in seeded order, each block once before any twice.

A block is a share of all words, so seats alone give a source of few blocks too much, too
little or nothing.  Each source that its seats leave more than ``SLACK`` of its target away
is settled by words instead: its stream is taken whole as often as it fits into the target,
and its first words once more; its documents are dealt to shards by hash.

Each range of words that is taken carries the shards of its seats, one for each time;
``quotas`` gives the seats of each source in each shard.

Scale: one narrow scan stages id, source and size; the rest moves those rows only.  A
source's running sum is built from 4,096 seeded cells, so a source with a third of all rows
is spread over as many window groups.  Seats and blocks are bounded by ``BLOCKS``; the seat
ranking and the broadcast of chosen blocks hold at any input size.

Cases: null text has size 0; null sources are one source, last; a null id is valid; repeated
rows are separate documents; empty tables give empty tables; sources without words have
target 0.  Rows of size 0 are never taken.  Further columns are not read by ``mix`` and kept
by ``take_pieces``, where rows of equal id and text share those of one of them; its own names
(``mix_``...) in the input raise ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.staging import Stage

BLOCKS, SHARDS = 16_384, 64
SLACK = 0.01
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size -> with idx (code point order, null last), target and total."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("idx", F.row_number().over(by_name) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights)).cast("int") + 1).cast("double"))
    w = w.withColumn("cap", most * F.col("source_size")).withColumn("total", F.sum("source_size").over(everything))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    w = w.withColumn("cap_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("weight_from", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("level", (share * F.col("total") - F.col("cap_before")) / F.col("weight_from"))
    ratio = F.col("cap") / F.col("weight")
    level = F.min(F.when(ratio > F.col("level"), F.struct(ratio, "idx", "level"))).over(everything)["level"]
    return w.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "source_size", "idx", "target", "total")


def mix(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, taken, and the word ranges taken, how often and in which shards."""
    stage = Stage(df.sparkSession, "mixing")
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    rows = stage.put("rows", df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), h.alias("h"), F.xxhash64(text).alias("txt")))
    goal = stage.put("targets", targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    block = F.greatest(F.ceil(share * F.col("total") / BLOCKS), F.lit(1)).cast("long")
    goal = goal.withColumn("block", block)

    # Seats: the highest quotients, as many as blocks.  Rounding target / divisor up from a half
    # loses at most half a seat a source, so the divisor of n sources and S seats is at least
    # all targets / (S + n / 2), and no source has a seat beyond its share by that divisor.
    asked = goal.filter("target > 0").withColumn("seats", F.round(share * F.col("total") / F.col("block")))
    wide = asked.agg(F.sum("target").alias("targets"), F.count("*").alias("sources"))
    most_seats = F.ceil(F.col("target") * (F.col("seats") + F.col("sources") / 2) / F.col("targets")).cast("int")
    seats = asked.join(F.broadcast(wide)).select("idx", "block", "target", "seats", F.explode(F.sequence(F.lit(0), most_seats)).alias("k"))
    rank = Window.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "idx", "k")
    seats = seats.withColumn("seat", F.row_number().over(rank) - 1).filter(F.col("seat") < F.col("seats"))
    seats = seats.select("idx", "k", F.floor(F.col("seat") * SHARDS / F.col("seats")).cast("int").alias("shard"))

    # Blocks of a source in seeded order, first pass before second.
    n = F.ceil(F.col("source_size") / F.col("block")).cast("long")
    passes = int(-(-most // 1))
    blocks = goal.filter("source_size > 0").select("idx", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("blk"))
    seeded = F.md5(F.concat_ws(":", F.lit(seed), "idx", "blk"))
    blocks = blocks.withColumn("j", F.row_number().over(Window.partitionBy("idx").orderBy(seeded, "blk")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("idx")))
    slots = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("k", (F.col("pass") * F.col("n") + F.col("j")).cast("int"))
    chosen = stage.put("chosen", slots.join(seats, ["idx", "k"]).groupBy("idx", "blk").agg(F.count("*").alias("times"), F.sort_array(F.collect_list("shard")).alias("shards")))

    # Sources that seats leave away from their target: whole passes and the words of one more.
    length = F.least((F.col("blk") + 1) * F.col("block"), "source_size") - F.col("blk") * F.col("block")
    seated = chosen.join(goal.select("idx", "block", "source_size"), "idx").groupBy("idx").agg(F.sum(F.col("times") * length).alias("seated"))
    away = (F.col("target") > 0) & (F.abs(F.coalesce("seated", F.lit(0)) - F.col("target")) > SLACK * F.col("target"))
    words = F.round("target").cast("long")
    goal = goal.join(seated, "idx", "left").withColumn("full", F.when(away, F.floor(words / F.col("source_size")).cast("long")))
    goal = stage.put("settled", goal.withColumn("rest", words - F.col("full") * F.col("source_size")).drop("seated"))

    # Where each document lies in its source's stream.
    rows = rows.withColumn("cell", F.substring("h", 1, 3))
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).join(F.broadcast(goal.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s", "words")
    inside = Window.partitionBy("source", "cell").orderBy("h", "doc_id", "size", "txt").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("r").join(cells.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.cell") == F.col("c.cell")))
    placed = placed.select("doc_id", "txt", "r.source", "size", "source_size", "target", "idx", "block", "full", "rest", (F.col("base") + F.col("inner")).alias("start"))
    # A settled source has two blocks: the words of the further pass, and the others.
    settled, unit = F.col("full").isNotNull(), F.coalesce("rest", "block")
    place = lambda at: F.when(settled, F.when(at < F.col("rest"), 0).otherwise(1).cast("long")).otherwise(F.floor(at / F.col("block")))
    first, last = place(F.col("start")), place(F.col("start") + F.col("size") - 1)
    cut = placed.withColumn("blk", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))))
    low = F.greatest(F.col("start"), F.col("blk") * unit) - F.col("start")
    high = F.least(F.col("start") + F.col("size"), F.when(settled & (F.col("blk") == 1), F.col("source_size")).otherwise((F.col("blk") + 1) * unit)) - F.col("start")
    times = F.when(settled & (F.col("size") > 0), F.col("full") + F.when(F.col("blk") == 0, 1).otherwise(0)).otherwise(F.coalesce("times", F.lit(0)))
    got = cut.join(F.broadcast(chosen), ["idx", "blk"], "left").withColumn("times", times).withColumn("shards", F.coalesce("shards", F.array_repeat(F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int"), F.col("times").cast("int")))).withColumn("span", F.struct(low.alias("low"), high.alias("high"), F.col("times").alias("times"), F.col("shards").alias("shards"))).withColumn("words", F.when(F.col("times") > 0, F.col("times") * (high - low)).otherwise(F.lit(0)))
    whole = got.filter((F.col("blk") == first) & (F.col("blk") == last) | (F.col("size") == 0)).select("doc_id", "txt", "source", "size", "source_size", "target", F.col("words").alias("taken"), F.array("span").alias("spans"))
    split = got.filter((F.col("blk") >= 0) & (first < last)).groupBy("doc_id", "txt", "source", "size", "source_size", "target", "start", "idx").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list("span")).alias("spans"))
    return whole.unionByName(split.select(whole.columns))


def quotas(mixed: DataFrame) -> DataFrame:
    """shard, source, words of a mix: what each shard holds of each source."""
    spans = mixed.filter("taken > 0").select("source", F.explode("spans").alias("s")).select("source", (F.col("s.high") - F.col("s.low")).alias("words"), F.explode("s.shards").alias("shard"))
    return spans.groupBy("shard", "source").agg(F.sum("words").alias("words"))


def take_pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``df`` with the taken part of their text, once a pass.

    A document taken whole keeps its text; of others the taken words stay, joined by blanks.
    """
    if any(c.lower().startswith("mix_") for c in df.columns):
        raise ValueError("input columns may not begin with mix_")
    placed = mix(df, doc_id=doc_id, text=text, source=source, **options).filter("taken > 0").select(F.col("doc_id").alias("mix_id"), F.col("txt").alias("mix_txt"), F.col("size").alias("mix_size"), F.col("spans").alias("mix_spans"))
    rows = df.withColumn("mix_txt", F.xxhash64(text)).dropDuplicates([doc_id, "mix_txt"])
    got = rows.join(placed, rows[doc_id].eqNullSafe(placed.mix_id) & (rows.mix_txt == placed.mix_txt)).drop("mix_txt", "mix_id")
    most = F.array_max(F.transform("mix_spans", lambda s: s["times"])).cast("int")
    got = got.withColumn("mix_pass", F.explode(F.sequence(F.lit(1), most)))
    cover = F.filter("mix_spans", lambda s: s["times"] >= F.col("mix_pass"))
    words = F.aggregate(cover, F.lit(0).cast("long"), lambda acc, s: acc + s["high"] - s["low"])
    part = F.array_join(F.flatten(F.transform(cover, lambda s: F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), (s["low"] + 1).cast("int"), (s["high"] - s["low"]).cast("int")))), " ")
    return got.withColumn(text, F.when(words == F.col("mix_size"), F.col(text)).otherwise(part)).select(df.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), g0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), g1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM g0
), g2 AS (SELECT *, CAST([5, 2, 1][idx % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM g1
), g3 AS (
  SELECT *, (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM g2
), g4 AS (SELECT first(lvl ORDER BY cap / weight, idx) AS lvl FROM g3 WHERE cap / weight > lvl
), g AS (
  SELECT source, source_size, idx, total, least(cap, coalesce(g4.lvl * weight, cap)) AS target, CAST(greatest(ceil(1.5::DOUBLE * total / 16384), 1) AS BIGINT) AS block FROM g3 LEFT JOIN g4 ON true
), s0 AS (SELECT idx, block, target, total, unnest(range(0, CAST(ceil(target / block) AS BIGINT) + 2)) AS k FROM g WHERE target > 0
), s AS (SELECT idx, k, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, idx, k) - 1 AS seat, total, block FROM s0 QUALIFY seat < round(1.5::DOUBLE * total / block)
), b0 AS (SELECT idx, unnest(range(0, CAST(ceil(source_size / block::DOUBLE) AS BIGINT))) AS blk, CAST(ceil(source_size / block::DOUBLE) AS BIGINT) AS n FROM g WHERE source_size > 0
), b AS (SELECT idx, blk, n, row_number() OVER (PARTITION BY idx ORDER BY md5('mix:' || idx || ':' || blk), blk) - 1 AS j FROM b0
), c AS (SELECT b.idx, b.blk, count(*) AS times FROM b CROSS JOIN (SELECT unnest([0, 1]) AS pass) p JOIN s ON s.idx = b.idx AND s.k = p.pass * b.n + b.j GROUP BY b.idx, b.blk
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.idx, g.block, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS st FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), t AS (
  SELECT r.doc_id, r.st, r.idx, sum(c.times * (least(st + size, (c.blk + 1) * block) - greatest(st, c.blk * block))) AS taken FROM r JOIN c ON c.idx = r.idx AND c.blk * block < st + size AND (c.blk + 1) * block > st WHERE size > 0 GROUP BY 1, 2, 3
)
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, r.source_size, r.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken FROM r LEFT JOIN t ON t.doc_id IS NOT DISTINCT FROM r.doc_id AND t.st = r.st AND t.idx = r.idx AND r.size > 0
"""
