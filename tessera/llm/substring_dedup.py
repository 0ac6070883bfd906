"""Substring dedup with suffix trees over memory-sized groups of suffixes.

A suffix is a window of ``WINDOW`` words at each position of each text.  It is removed where
the same window starts in a document of smaller id.

1. Suffixes are split into groups by the least-hashed ``GRAM``-word sequence within their
   first ``WINDOW`` words.  Equal windows fall into one group whatever surrounds them, and
   neighbouring suffixes mostly share a group, so they travel as one segment of text; a group
   key that is a plain prefix would ship the whole window for each word of the corpus.
2. Groups whose suffixes all lie in one document cannot repeat and end here: only
   (group, document) pairs are moved to find them.
3. Segments of the other groups are collapsed by content to the smallest document that
   holds them, with map-side partial aggregation: however many copies a passage has, its
   group gets one segment a distinct content.
4. A group of more than ``GROUP_WORDS`` words has its prefix lengthened by ``GRAM`` words, to
   the right of where the prefix first stands in a suffix, or to the left where the suffix ends
   too soon; its segments are cut where the longer prefix changes, collapsed again, and so on
   until the group fits or the prefix is the whole window and so a node by itself.
5. Each group's suffixes are sorted by five blocks of ten words: a suffix tree whose edges
   are blocks.  Its internal nodes of depth ``WINDOW`` are the runs of neighbours with all
   blocks in common; the smallest document of a node keeps its window, the others lose it.
6. Node results go back to the segments, these to the documents, which are read again to
   drop words and join the rest.  Texts move once (by id; both joins use that exchange).

Words are compared by 32-bit hashes, all 50 of them, groups and contents by 64 and 128 bits.

Cases: null and empty texts have no words; texts of any length are read whole; a null id
counts as larger than any; rows of equal id do not remove each other's words; repeated rows
stay repeated; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessera.llm import words as W
from tessera.llm.staging import Stage

WINDOW, GRAM, BLOCK = 50, 10, 10
GROUP_WORDS = 500_000
_SLICE = 256
_LAST = (1 << 63) - 1


def short_hashes(text: str | None) -> np.ndarray:
    """32 bits for each word of a text, as 64-bit integers."""
    return W.hashes(W.split(text)) & np.uint64(0xFFFFFFFF)


def group_of(h: np.ndarray) -> np.ndarray:
    """The group of each window of a text's word hashes."""
    return W.sliding_min(W.grams(h, GRAM), WINDOW - GRAM + 1) if len(h) >= WINDOW else np.empty(0, dtype=np.uint64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            yield whole.slice(at, _SLICE)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _parts(batches):
        found = [np.unique(group_of(short_hashes(t))) for t in b.column(1).to_pylist()]
        keys = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
        docs = np.repeat(b.column(0).to_numpy(), [len(f) for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs)], names=["grp", "doc"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _parts(batches):
        out: list[list] = [[] for _ in range(7)]
        for doc, key, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            h = short_hashes(text)
            g = group_of(h).view(np.int64)
            if not len(g):
                continue
            starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            ends = np.concatenate((starts[1:], [len(g)]))
            pick = np.isin(g[starts], wanted.values.to_numpy())
            short = h.astype(np.uint32)
            for a, e in zip(starts[pick].tolist(), ends[pick].tolist()):
                content = short[a : e + WINDOW - 1].tobytes()
                for column, value in zip(out, (int(g[a]), xxhash.xxh3_128_digest(content), doc, key, a, e - a, content)):
                    column.append(value)
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["grp", "cls", "doc", "txt", "at", "n", "content"])


def repeated(docs: np.ndarray, sizes: np.ndarray, content: np.ndarray) -> np.ndarray:
    """For each suffix of the segments (``sizes`` each) whether a smaller document has its window."""
    before = np.concatenate(([0], np.cumsum(sizes + WINDOW - 1)))[:-1]
    total = int(sizes.sum())
    within = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(before, sizes) + within
    block = W.grams(content.astype(np.uint64), BLOCK)
    keys = [block[at + i] for i in range(0, WINDOW, BLOCK)]
    doc = np.repeat(docs, sizes)
    order = np.lexsort((doc, *keys[::-1]))
    new = np.ones(total, dtype=bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    node = np.cumsum(new) - 1
    least = doc[order][new]
    out = np.zeros(total, dtype=bool)
    out[order] = doc[order] > least[node]
    return out


def runs(flags: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int]]]:
    """Runs of set flags, cut at segment ends, as (from, to) within each segment."""
    first = np.cumsum(sizes) - sizes
    begin = flags.copy()
    begin[1:] &= ~flags[:-1]
    begin[first] = flags[first]
    end = flags.copy()
    end[:-1] &= ~flags[1:]
    end[first + sizes - 1] = flags[first + sizes - 1]
    a, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = np.searchsorted(first, a, side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in sizes]
    for r, x, y in zip(row.tolist(), (a - first[row]).tolist(), (e - first[row]).tolist()):
        out[r].append((x, y))
    return out


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; the last group of a batch waits for the next batch."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        docs, sizes = t.column("least").to_numpy(), t.column("n").to_numpy().astype(np.int64)
        content = np.frombuffer(b"".join(t.column("content").to_pylist()), dtype=np.uint32)
        found = runs(repeated(docs, sizes, content), sizes)
        return pa.RecordBatch.from_arrays([pa.array(t.column("cls").to_pylist(), pa.binary()), pa.array(docs), pa.array([[{"a": a, "b": b} for a, b in f] for f in found], _RUNS)], names=["cls", "least", "runs"])

    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        g = held.column("grp").to_numpy()
        cut = int(np.searchsorted(g, g[-1])) if len(g) else 0
        if cut:
            yield solve(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield solve(held)


_PIECE = "grp long, cls binary, doc long, ref binary, at int, n int, content binary"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
    columns = zip(*found) if found else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["grp", "cls", "doc", "ref", "at", "n", "content"])


def longer(key: int, words: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``words``, all of which hold the gram ``key`` of ``length`` words, a gram of ``GRAM`` more words."""
    n = len(words) - WINDOW + 1
    here = np.flatnonzero(W.grams(words, length) == np.uint64(key))
    at = here[np.searchsorted(here, np.arange(n))]
    more = W.grams(words, length + GRAM)
    return more[np.where(at + length + GRAM <= np.arange(n) + WINDOW, at, at - GRAM)]


def _lengthened(length: int):
    """Segments of large groups, cut into those of longer prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            found = []
            for grp, cls, doc, content in zip(*(b.column(c).to_pylist() for c in ("grp", "cls", "least", "content"))):
                h = np.frombuffer(content, dtype=np.uint32)
                g = longer(grp % (1 << 64), h.astype(np.uint64), length).view(np.int64)
                starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))).tolist()
                for a, e in zip(starts, [*starts[1:], len(g)]):
                    piece = h[a : e + WINDOW - 1].tobytes()
                    found.append((int(g[a]), xxhash.xxh3_128_digest(piece), doc, cls, a, e - a, piece))
            yield _rows(found)

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of large groups to one row a window, the longest prefix: its digest is the node."""
    for b in _parts(batches):
        for cls, doc, n, content in zip(*(b.column(c).to_pylist() for c in ("cls", "least", "n", "content"))):
            for a in range(0, n, 4096):
                digests = [xxhash.xxh3_128_digest(content[4 * i : 4 * (i + WINDOW)]) for i in range(a, min(n, a + 4096))]
                yield _rows([(0, d, doc, cls, a + i, 1, b"") for i, d in enumerate(digests)])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _parts(batches):
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans")):
            w = W.split(text)
            gone = 0
            if spans.is_valid:
                a = spans.values.field("a").to_numpy(zero_copy_only=False)
                e = spans.values.field("b").to_numpy(zero_copy_only=False)
                steps = np.zeros(len(w) + 1, dtype=np.int64)
                np.add.at(steps, a, 1)
                np.add.at(steps, e, -1)
                keep = np.cumsum(steps[:-1]) == 0
                gone = int(len(w) - keep.sum())
                w_kept = [x for x, k in zip(w, keep.tolist()) if k]
            else:
                w_kept = w
            kept = b" ".join(w_kept)
            n_words.append(len(w))
            n_removed.append(gone)
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def lost(seg: DataFrame, stage: Stage, length: int, group_words: int) -> DataFrame:
    """(doc, ref, s): ranges of windows that a smaller document has.  seg: grp, cls, doc, ref, at, n, content."""
    classes = stage.put(f"classes-{length}", seg.groupBy("grp", "cls").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.first("n").alias("n"), F.first("content").alias("content")))
    if length >= WINDOW:  # a class is a node
        found = classes.filter("least < most").select("cls", "least", F.lit(None).cast("array<struct<a:int,b:int>>").alias("runs"))
    else:
        large = classes.groupBy("grp").agg(F.sum(F.col("n") + WINDOW - 1).alias("words")).filter(F.col("words") > group_words).select("grp")
        trees = classes.join(large, "grp", "left_anti").select("grp", "cls", "least", "n", "content").repartition("grp").sortWithinPartitions("grp").mapInArrow(_trees, "cls binary, least long, runs array<struct<a:int,b:int>>")
        nodes = trees.filter(F.size("runs") > 0).select("cls", "runs")
        parts = classes.join(large, "grp", "left_semi").select("grp", "cls", "least", "n", "content")
        # Prefixes up to 40 words can be lengthened within the window whichever side it has room on.
        parts = stage.put(f"parts-{length}", parts.mapInArrow(_lengthened(length) if length + 2 * GRAM <= WINDOW else _windows, _PIECE))
        if not parts.isEmpty():
            deeper = lost(parts, stage, length + GRAM if length + 2 * GRAM <= WINDOW else WINDOW, group_words)
            nodes = nodes.unionByName(deeper.groupBy(F.col("ref").alias("cls")).agg(F.flatten(F.collect_list("s")).alias("runs")))
        found = classes.select("cls", "least", "most").join(nodes, "cls", "left").filter("least < most or runs is not null").select("cls", "least", "runs")
    hit = seg.select("cls", "doc", "ref", "at", "n").join(found, "cls")
    whole = F.array(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("b")))
    moved = F.transform(F.coalesce("runs", F.expr("cast(array() as array<struct<a:int,b:int>>)")), lambda r: F.struct((r["a"] + F.col("at")).alias("a"), (r["b"] + F.col("at")).alias("b")))
    return hit.select("doc", "ref", F.when(F.col("doc") > F.col("least"), whole).otherwise(moved).alias("s")).filter(F.size("s") > 0)


def spans_to_drop(docs: DataFrame, stage: Stage, group_words: int = GROUP_WORDS) -> DataFrame:
    """(doc, txt) with the word ranges to drop.  docs: doc, txt (hash of the text), text."""
    pairs = stage.put("groups", docs.select("doc", "text").mapInArrow(_groups, "grp long, doc long"))
    shared = pairs.groupBy("grp").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("grp")
    wanted = pairs.join(shared, "grp").groupBy("doc").agg(F.collect_list("grp").alias("wanted"))
    found = docs.join(wanted, "doc").select("doc", "txt", "text", "wanted")
    seg = stage.put("segments", found.mapInArrow(_segments, "grp long, cls binary, doc long, txt long, at int, n int, content binary"))
    gone = lost(seg.withColumnRenamed("txt", "ref"), stage, GRAM, group_words)
    in_words = F.transform(F.flatten(F.collect_list("s")), lambda r: F.struct(r["a"].alias("a"), (r["b"] + WINDOW - 1).alias("b")))
    return gone.groupBy("doc", F.col("ref").alias("txt")).agg(in_words.alias("spans"))


def drop_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", group_words: int = GROUP_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept words of each text."""
    stage = Stage(df.sparkSession, "substring")
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id), F.lit(_LAST)).cast("long").alias("doc"), F.xxhash64(text).alias("txt"), F.col(text).alias("text"))
    spans = stage.put("spans", spans_to_drop(docs, stage, group_words))
    stage.keep("spans")
    joined = docs.join(spans, ["doc", "txt"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_rewrite, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 49, 0))) AS p FROM d
), k AS (SELECT doc_id, p, sha256(array_to_string(w[p + 1:p + 50], ' ')) AS k FROM p
), f AS (SELECT k, min(doc_id) AS first_id FROM k GROUP BY k
), x AS (SELECT DISTINCT doc_id, unnest(range(k.p, k.p + 50)) AS i FROM k JOIN f USING (k) WHERE doc_id > first_id
), e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d
), o AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) FILTER (x.i IS NULL) AS kept, count(x.i) AS gone FROM e LEFT JOIN x ON x.doc_id = e.doc_id AND x.i = e.i GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(o.gone, 0) AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256 FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""
