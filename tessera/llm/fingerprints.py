r"""Document fingerprints by consistent weighted sampling.

Terms are a text's distinct words with weight w = 1 + ln(how often they occur).  For each of
``SAMPLES`` samples every weighted term draws, from hashes of the word, r and c from
Gamma(2, 1) and b uniform; t = floor(ln w / r + b) and a = c exp(-r (t - b + 1)).  The term
of least a is the sample, and (term, t) stands in the signature.  Two texts have the same
(term, t) with a probability of their generalised Jaccard similarity.

The pair (r, b) is drawn as r b = -ln u and r (1 - b) = -ln v with u and v uniform, which is
the same law: a Gamma(2, 1) variable is cut by a uniform one into two independent
exponentials.  Then t = 0 exactly where w v < 1, and there a = c v.

Built-in expressions alone.  A text's terms are counted inside its row, exploded, and drawn
for in one hash aggregate that keeps the least a of each sample.  Another term, or the same
with another t, has another a, so a stands for its (term, t); 24 bits of its hash are shown.
Rows of one text are neighbours in one task, and the aggregate follows the partitioning its
input has.

For the document that follows, texts move once: ids are dealt to at most ``RANGES`` ranges
of like numbers of rows (approximate quantiles, so outlying ids do no harm), each range is
sorted by itself and gets a copy of the first row of the range behind it.  Bounds and first
ids are the only data on the driver and in broadcasts, and bounded by ``RANGES``.

Cases: null and empty texts, or texts without words, have an empty fingerprint, alike only
to another empty one (1.0); texts are read whole; a null id comes last; rows of equal id are
ordered by their text and lie in one range; any long is a valid id; an empty table gives an
empty table; further columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.exprs import let

SAMPLES = 64
RANGES, RANGE_ROWS = 65_536, 256
TRIES = 4


def salts(k: int) -> tuple[int, int, int]:
    """The constants that sample ``k`` mixes into a term's hash, as signed longs."""
    odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    return tuple((x := (2 * k + 1) * m % (1 << 64)) - (x >> 63 << 64) for m in odd)


def draw(k: int, h: str = "h", w: str = "w") -> Column:
    """One term's a for sample ``k``; null where ``w`` is.

    With r b = -ln u and r (1 - b) = -ln v, t is the least number for which w u**t v**(t + 1)
    is below 1, and a = c u**t v**(t + 1).  The first t are tried by products, so that hardly
    a draw takes a logarithm beside that of c = -ln(u1 u2).
    """
    x, y, z = (f"xxhash64({h} ^ ({s}L))" for s in salts(k))
    half = f"{0.5**31!r}D"
    high, low = (lambda q: f"((shiftrightunsigned({q}, 33) + 0.5D) * {half})"), (lambda q: f"((({q} & 2147483647L) + 0.5D) * {half})")
    v, u = high(x), low(z)
    tries = " ".join(f"WHEN {w} * {p} < 1D THEN {p}" for p in (" * ".join([v] + [f"({u} * {v})"] * t) for t in range(TRIES)))
    least_t = f"ceil((ln({w}) + ln({v})) / -ln({u} * {v}))"
    return F.expr(f"-ln({high(y)} * {low(y)}) * (CASE {tries} WHEN {w} IS NOT NULL THEN {v} * pow({u} * {v}, {least_t}) END)")


def terms(text: Column, side: int = 0) -> Column:
    """A text's distinct words as array of (side, h, n): hash and count; last comes (side, null, 0)."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))
    one = lambda h, n: F.struct(F.lit(side).alias("side"), h.alias("h"), n.cast("int").alias("n"))

    def runs(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i - 1) != F.get(s, i)))
        return let(ends, lambda e: F.transform(e, lambda i, j: one(F.get(s, i - 1), i - F.coalesce(F.get(e, j - 1), F.lit(0)))))

    none = F.array(one(F.lit(None).cast("long"), F.lit(0)))
    return let(hashes, lambda s: F.when(F.size(s) > 0, F.concat(runs(s), none)).otherwise(none))


def sample(exploded: DataFrame, by: list[str]) -> DataFrame:
    """Rows (``by``, h, n) to ``by`` and ``codes``, the samples; an empty array without terms."""
    weighed = exploded.select(*by, "h", F.when(F.col("n") > 0, 1 + F.ln(F.col("n").cast("double"))).alias("w"))
    least = weighed.groupBy(*by).agg(*[F.min(draw(k)).alias(f"s{k}") for k in range(SAMPLES)])
    codes = F.array(*[F.xxhash64(f"s{k}").bitwiseAND(F.lit(0xFFFFFF)).cast("int") for k in range(SAMPLES)])
    return least.select(*by, F.when(F.col("s0").isNotNull(), codes).otherwise(F.expr("cast(array() as array<int>)")).alias("codes"))


def shown(code: Column) -> Column:
    """A fingerprint as text: six hexadecimal digits a sample."""
    return F.array_join(F.transform(code, lambda c: F.lpad(F.lower(F.hex(c)), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / F.lit(float(SAMPLES)))


def fingerprint(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """``by`` and ``codes``: the samples of ``text``, as one weighted set for each value of ``by``."""
    if {c.lower() for c in by} & {"h", "n", "w", "codes", "side"}:
        raise ValueError("key columns may not be named h, n, w, codes or side")
    return sample(df.select(*by, F.inline(terms(F.col(text)))).drop("side"), by)


def range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``doc_id``: in two steps over square-root many; null ids come last."""
    if not bounds:
        return F.when(doc_id.isNull(), 1).otherwise(0)
    side = math.isqrt(len(bounds) - 1) + 1
    rows = [bounds[a : a + side] for a in range(0, len(bounds), side)]
    table = F.from_json(F.lit(json.dumps(rows)), "array<array<bigint>>")
    heads = F.from_json(F.lit(json.dumps([r[0] for r in rows])), "array<bigint>")
    at_most = lambda a: F.size(F.filter(a, lambda b: b <= doc_id))
    return F.when(doc_id.isNull(), len(bounds) + 1).otherwise(let(at_most(heads), lambda i: F.when(i == 0, 0).otherwise((i - 1) * side + at_most(F.get(table, i - 1)))))


def with_next(df: DataFrame, row_hash: Column) -> DataFrame:
    """Add rng, nth (a row's place in its range) and nxt, the struct of the row that follows by doc_id.

    After the last row comes the first.  Rows of equal id are ordered by ``row_hash``.
    """
    rows = df.count()
    n = min(RANGES, rows // RANGE_ROWS)
    asked = F.from_json(F.lit(json.dumps([i / n for i in range(1, n)])), "array<double>") if n > 1 else None
    found = df.agg(F.percentile_approx("doc_id", asked, 10 * n)).first()[0] if n > 1 else None
    ranged = df.withColumn("rng", range_of(F.col("doc_id"), sorted(set(found or []))).cast("int"))
    first = ranged.groupBy("rng").agg(F.min("doc_id").alias("first_id"))
    everything, order = Window.partitionBy(), Window.orderBy("rng")
    edges = first.select("first_id", F.coalesce(F.lag("rng").over(order), F.max("rng").over(everything)).alias("copy_to"))
    doubled = ranged.join(F.broadcast(edges), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    at = lambda r, edge: F.struct(r.alias("rng"), F.lit(edge).alias("edge"))
    doubled = doubled.withColumn("to", F.explode(F.when(F.col("copy_to").isNotNull(), F.array(at(F.col("rng"), 0), at(F.col("copy_to"), 1))).otherwise(F.array(at(F.col("rng"), 0)))))
    doubled = doubled.select(*df.columns, "to.rng", "to.edge")
    by = Window.partitionBy("rng").orderBy("edge", F.col("doc_id").asc_nulls_last(), row_hash)
    return doubled.withColumn("nxt", F.lead(F.struct(*df.columns)).over(by)).withColumn("nth", F.row_number().over(by))


def compare_edited(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next one are."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = with_next(docs, F.xxhash64("text"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.when(F.col("edge") == 0, F.concat(F.substring("text", F.lit(1), n - half), F.substring("nxt.text", F.lit(1), half)))
    d = d.select("rng", "nth", "edge", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    # A copied first row comes behind its range's own rows and has no edited text to sample.
    both = F.when(F.col("edge") == 0, F.concat(terms(F.col("text")), terms(F.col("edited"), 1))).otherwise(terms(F.col("text")))
    keys = ["rng", "nth", "edge", "doc_id", "n_chars", "edited_sha256"]
    sampled = sample(d.select(*keys, F.inline(both)), [*keys, "side"])
    by = Window.partitionBy("rng").orderBy("nth", "side")
    both = sampled.withColumn("edited_codes", F.lead("codes", 1).over(by)).withColumn("next_codes", F.lead("codes", 2).over(by)).filter("edge = 0 and side = 0")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("codes")).alias("fingerprint"), shown(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"), likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )
