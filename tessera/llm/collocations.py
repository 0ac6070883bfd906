"""Phrase collocations, counted in counting quotient filters.

A word's id is a 64-bit hash, told apart by a check over the whole vocabulary (two words of
one id would give a next seed); an n-gram is two or three ids side by side.  One Feistel
round, which is invertible, makes the first id a hash of all of them.  Its upper bits are the
shard and the quotient, the lower bits and the other ids the remainder, kept in full: a
filter is a run length for each quotient, the sorted remainders and a counter of variable
length for each, and counts are exact.  Map tasks fill filters for batches of their texts and
send them by shard; a shard merges its sorted filters.  Shards are dealt by hash, their
number follows the number of words, and an n-gram counts once for each filter, so neither a
frequent phrase nor a language with a third of all rows lies in one task.

Texts are read three times.  Words come first; then pairs of words that are frequent enough
to be in a candidate; then triples whose two pairs are.  What is frequent is told by a bit
array of fixed size (``BITS``), so what is broadcast never grows; bits that stand for more
than one entry only let rare n-grams be counted too, and exact counts decide in the end.

Cases: null text counts as empty, null language as ``und``; texts of any length are read
whole; repeated rows count each time; an empty table, or one without candidates, gives no
rows; only language and text are read, so clashing extra columns do no harm.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.bpe import slices
from tessera.llm.staging import Stage
from tessera.llm.words import mixed

LEAST = 10
TOP = 2000
KEPT_PERCENT = 50
CELLS = 8
BITS = 1 << 26
#: Words of a shard, n-grams and distinct words that a task holds.
SHARD_WORDS = 1 << 20
HELD = 1_000_000
HELD_WORDS = 400_000
_CUT = b"\xff"
_FOLD = bytes.maketrans(bytes([*range(65, 91), *b".,;:!?\n\x0b\x0c\r"]), bytes(range(97, 123)) + _CUT * 10)


def words(texts: list[bytes]) -> list[bytes]:
    """Words of some texts in order, with ``_CUT`` (never in UTF-8) wherever a piece ends."""
    return _CUT.join(texts).translate(_FOLD).replace(_CUT, b" \xff ").split()


# -- filters ---------------------------------------------------------------------------


def spread(ids: list[np.ndarray]) -> list[np.ndarray]:
    """The permutation; it is its own inverse."""
    h = np.zeros(len(ids[0]), dtype=np.uint64)
    for x in ids[1:]:
        h = mixed(h + x)
    return [ids[0] ^ h, *ids[1:]]


class Filter:
    """Permuted n-grams in ascending order with their counts."""

    def __init__(self, grams: list[np.ndarray], counts: np.ndarray):
        self.grams, self.counts = grams, counts

    @classmethod
    def of(cls, grams: list[np.ndarray], counts: np.ndarray) -> Filter:
        """Equal n-grams become one entry.  The first id decides the order, unless two differ behind it."""
        order = np.argsort(grams[0])
        for attempt in range(2):
            g = [x[order] for x in grams]
            same = [x[1:] == x[:-1] for x in g]
            if attempt or (same[0] == np.logical_and.reduce(same)).all():
                break
            order = np.lexsort(grams[::-1])
        begin = np.flatnonzero(np.append(True, ~np.logical_and.reduce(same)))[: len(order)]
        return cls([x[begin] for x in g], np.add.reduceat(counts[order], begin) if len(begin) else counts[:0])

    @classmethod
    def merged(cls, filters: list[Filter]) -> Filter:
        if len(filters) == 1:
            return filters[0]
        return cls.of([np.concatenate(x) for x in zip(*(f.grams for f in filters))], np.concatenate([f.counts for f in filters]))

    def shards(self, bits: int) -> Iterator[tuple[int, bytes]]:
        """(shard, packed part) for each shard with entries; shards are the first ``bits`` bits."""
        shard = (self.grams[0] >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))[: len(shard)]
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)]):
            yield int(shard[a]), Filter([x[a:b] for x in self.grams], self.counts[a:b]).packed(bits)

    def packed(self, bits: int) -> bytes:
        n = len(self.counts)
        q = max(0, min(24, n.bit_length() - 1))
        low = 64 - bits - q
        slots = np.bincount(((self.grams[0] >> np.uint64(low)) & np.uint64((1 << q) - 1)).astype(np.int64), minlength=1 << q)
        wide = np.dtype("<u1") if slots.max() < 256 else np.dtype("<u4")
        rest = self.grams[0].astype("<u8").view(np.uint8).reshape(n, 8)[:, : (low + 7) // 8]
        small = np.minimum(self.counts, 255).astype("<u1")
        return b"".join([struct.pack("<IBBB", n, q, wide.itemsize, len(self.grams)), slots.astype(wide).tobytes(), rest.tobytes(), *(x.astype("<u8").tobytes() for x in self.grams[1:]), small.tobytes(), self.counts[small == 255].astype("<i8").tobytes()])

    @classmethod
    def unpacked(cls, data: bytes, shard: int, bits: int) -> Filter:
        n, q, wide, k = struct.unpack_from("<IBBB", data)
        low, at = 64 - bits - q, 7

        def take(count: int, dtype: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=dtype, count=count, offset=at)
            at += out.nbytes
            return out

        slots = take(1 << q, f"<u{wide}")
        size = (low + 7) // 8
        rest = np.zeros((n, 8), dtype=np.uint8)
        rest[:, :size] = take(n * size, "<u1").reshape(n, size)
        first = rest.reshape(-1).view("<u8") & np.uint64((1 << low) - 1)
        first |= np.repeat(np.arange(1 << q, dtype=np.uint64), slots) << np.uint64(low)
        first |= np.uint64(shard) << np.uint64(64 - bits)
        others = [take(n, "<u8") for _ in range(k - 1)]
        counts = take(n, "<u1").astype(np.int64)
        counts[counts == 255] = take(int((counts == 255).sum()), "<i8")
        return cls([first, *others], counts)


# -- what is frequent ------------------------------------------------------------------


def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))


def _place(ids: list[np.ndarray], salt: np.uint64, bits: int) -> np.ndarray:
    h = np.full(len(ids[0]), salt, dtype=np.uint64)
    for x in ids:
        h = mixed(h ^ x)
    return h & np.uint64(bits - 1)


def bit_array(entries: DataFrame, columns: list[str], bits: int = BITS) -> np.ndarray:
    """``bits`` bits with those of the entries (lang and ids) set; made by tasks, or-ed in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            code = langs.indices.to_numpy()
            ids = [b.column(c).to_numpy().view(np.uint64) for c in columns]
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                at = _place([x[code == i] for x in ids], _salt(lang), bits)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["slot", "word"])

    out = np.zeros(bits >> 6, dtype=np.uint64)
    found = entries.select("lang", *columns).mapInArrow(run, "slot long, word long").groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow()
    out[found.column("slot").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return out


def _is_set(array: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (array[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


# -- passes over the texts -------------------------------------------------------------


class _Ids(dict):
    """Word ids; ``_CUT`` is 0."""

    def __init__(self, seed: int):
        super().__init__({_CUT: 0})
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(word) <= 64:
            self[word] = h
        return h


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, some megabytes at a time."""
    for whole in batches:
        for b in slices(whole, "text"):
            langs, texts = b.column("lang").dictionary_encode(), b.column("text").to_pylist()
            code = langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                yield lang, [texts[j] for j in np.flatnonzero(code == i).tolist()]


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """lang, id, word, f; a null word has the sum of its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                c.pop(_CUT, None)
                names, n = list(c), len(c)
                ids = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in names), dtype=np.uint64, count=n).view(np.int64).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (n + 1)), pa.array([*ids, None], pa.int64()), pa.array([*names, None], pa.binary()), pa.array([*c.values(), c.total()], pa.int64())], names=["lang", "id", "word", "f"])
            counts.clear()

        for lang, texts in _by_lang(batches):
            counts.setdefault(lang, Counter()).update(words(texts))
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield from out()
        yield from out()

    return docs.mapInArrow(run, "lang string, id long, word binary, f long").groupBy("lang", "id", "word").agg(F.sum("f").alias("f"))


def count_grams(docs: DataFrame, n: int, frequent: np.ndarray, seed: int, shard_bits: int, least: int) -> DataFrame:
    """lang, id1 .. idn, f of the n-grams that occur ``least`` times or more.

    ``frequent`` has the words (for pairs) or pairs (for triples) that count.
    """
    held, bits = docs.sparkSession.sparkContext.broadcast(frequent), len(frequent) << 6

    def grams(h: np.ndarray, salt: np.uint64) -> list[np.ndarray]:
        real = h != 0
        if n == 2:
            good = real & _is_set(held.value, _place([h], salt, bits))
            at = good[:-1] & good[1:]
        else:
            pair = real[:-1] & real[1:] & _is_set(held.value, _place([h[:-1], h[1:]], salt, bits))
            at = pair[:-1] & pair[1:]
        return spread([h[i : len(h) - n + 1 + i][at] for i in range(n)])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(seed)
        buffers: dict[str, list[Filter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, filters in buffers.items():
                rows = list(Filter.merged(filters).shards(shard_bits))
                for at in range(0, len(rows), 256):
                    part = rows[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([s for s, _ in part], pa.int64()), pa.array([p for _, p in part], pa.binary())], names=["lang", "shard", "packed"])
            buffers.clear()

        for lang, texts in _by_lang(batches):
            if len(ids) > HELD_WORDS:
                ids = _Ids(seed)
            found = words(texts)
            h = np.fromiter(map(ids.__getitem__, found), dtype=np.uint64, count=len(found))
            if len(h) < n:
                continue
            g = grams(h, _salt(lang))
            if len(g[0]):
                buffers.setdefault(lang, []).append(Filter.of(g, np.ones(len(g[0]), dtype=np.int64)))
            if sum(len(f.counts) for fs in buffers.values() for f in fs) > HELD:
                yield from out()
        yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, filters = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if not filters:
                return
            f = Filter.merged(filters)
            much = f.counts >= least
            ids = spread([x[much] for x in f.grams])
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * int(much.sum()), pa.string()), *(pa.array(x.view(np.int64)) for x in ids), pa.array(f.counts[much])], names=["lang", *(f"id{i + 1}" for i in range(n)), "f"])

        for b in batches:
            for lang, shard, packed in zip(*(c.to_pylist() for c in b.columns)):
                if (lang, shard) != key:
                    yield from out()
                    key, filters = (lang, shard), []
                filters.append(Filter.unpacked(packed, shard, shard_bits))
                if len(filters) > 1 and sum(len(f.counts) for f in filters) > HELD and len(filters[0].counts) < HELD // 2:
                    filters = [Filter.merged(filters)]
        yield from out()

    packed = docs.mapInArrow(fill, "lang string, shard long, packed binary")
    there = packed.repartition("lang", "shard").sortWithinPartitions("lang", "shard")
    return there.mapInArrow(merge, ", ".join(["lang string", *(f"id{i + 1} long" for i in range(n)), "f long"]))


# -- phrases ---------------------------------------------------------------------------


def _score(l: str, r: str) -> Column:  # noqa: E741
    """floor(1,000,000 a a / (l r)), exact: products are decimals of up to 38 digits."""
    big = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * ({big('a')} * {big('a')})) DIV ({big(l)} * {big(r)})")


def mine(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    stage = Stage(df.sparkSession, "collocations")
    docs = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    seed = 0
    while True:
        every = stage.put(f"words-{seed}", count_words(docs, seed))
        clash = every.filter("id IS NOT NULL").groupBy("lang", "id").count().filter("count > 1 OR id = 0")
        if clash.isEmpty():
            break
        seed += 1
    totals = stage.put("totals", every.filter("word IS NULL").select("lang", F.col("f").alias("n")))
    total = totals.agg(F.sum("n")).first()[0] or 0
    shard_bits = max(3, (total // SHARD_WORDS).bit_length())
    known = stage.put("known", every.filter("word IS NOT NULL").filter(F.col("f") >= least).withColumn("word", F.col("word").cast("string")))
    stage.drop(f"words-{seed}")
    pairs = stage.put("pairs", count_grams(docs, 2, bit_array(known, ["id"], bits), seed, shard_bits, least))
    triples = stage.put("triples", count_grams(docs, 3, bit_array(pairs, ["id1", "id2"], bits), seed, shard_bits, least))

    def word(at: str, name: str) -> DataFrame:
        return known.select("lang", F.col("id").alias(at), F.col("word").alias(f"w_{at}"), F.col("f").alias(name))

    def pair(a: str, b: str, name: str) -> DataFrame:
        return pairs.select("lang", F.col("id1").alias(a), F.col("id2").alias(b), F.col("f").alias(name))

    inside = F.explode(F.array(F.struct(F.col("id1"), F.col("id2")), F.struct(F.col("id2").alias("id1"), F.col("id3").alias("id2"))))
    longer = triples.select("lang", "f", inside.alias("p")).groupBy("lang", "p.id1", "p.id2").agg(F.max("f").alias("longer"))
    two = (
        pairs.withColumnRenamed("f", "a").join(longer, ["lang", "id1", "id2"], "left").filter(F.coalesce(100 * F.col("longer") < KEPT_PERCENT * F.col("a"), F.lit(True)))
        .join(word("id1", "l"), ["lang", "id1"]).join(word("id2", "r"), ["lang", "id2"])
        .select("lang", F.concat_ws(" ", "w_id1", "w_id2").alias("phrase"), "a", "l", "r", _score("l", "r").alias("score"))
    )
    three = (
        triples.withColumnRenamed("f", "a").join(word("id1", "l1"), ["lang", "id1"]).join(word("id2", "f2"), ["lang", "id2"]).join(word("id3", "r2"), ["lang", "id3"])
        .join(pair("id2", "id3", "r1"), ["lang", "id2", "id3"]).join(pair("id1", "id2", "l2"), ["lang", "id1", "id2"])
        .withColumn("s1", _score("l1", "r1")).withColumn("s2", _score("l2", "r2")).withColumn("late", F.col("s2") < F.col("s1"))
        .select("lang", F.concat_ws(" ", "w_id1", "w_id2", "w_id3").alias("phrase"), "a", F.when(F.col("late"), F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(F.col("late"), F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"))
    )
    order = (F.desc("score"), F.desc("a"), "phrase")
    # A language's phrases are cut down in cells first, so that its last task reads a bounded number.
    cell = F.row_number().over(Window.partitionBy("lang", "cell").orderBy(*order))
    best = two.unionByName(three).withColumn("cell", F.pmod(F.xxhash64("phrase"), F.lit(CELLS))).withColumn("nth", cell).filter(F.col("nth") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = """
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM pieces
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM pieces
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM pieces
), f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT lang, k, phrase, a, 1 AS cut, w[1] AS p, array_to_string(w[2:], ' ') AS q FROM c
  UNION ALL SELECT lang, k, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3
), scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p AND x.k = cut JOIN f y ON y.lang = cuts.lang AND y.phrase = q AND y.k = cuts.k - cut
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, n, score
FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase AND b.k = 2 JOIN totals t ON t.lang = b.lang
WHERE g.a IS NULL OR 100 * g.a < 50 * b.a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) <= 2000
"""
