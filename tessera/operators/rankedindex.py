"""Ranked text retrieval on stored postings: blocks with a bound, reads that stop at it, kept results.

A term's postings lie in blocks of ``BLOCK`` files by falling impact (occurrences by length,
times a bonus for size), each with its greatest impact.  Age and language can lower or raise
an impact only within known factors, so a block's impact times the largest of them bounds all
scores in it.  A search first reads the best blocks that hold enough postings for its limit;
the score reached there is a floor, and of the rest only blocks are read whose bound reaches
it.  What comes out is what a full sort gives.

Files of the index are runs of blocks by term, and their pages are small, so both reads open
only the pages of the query's terms.  Each saved index has a version; results are kept in a table by query, limit, language,
day and version, and read from there when asked for again.
"""

from __future__ import annotations

import datetime
import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessera.functions import text
from tessera.operators import textindex

BLOCK = 128
#: Largest factors of age and language.
FRESHEST, SAME_LANGUAGE = 1.0, 1.2
KEPT = 100
META = ("path", "n_chars", "size", "modified", "language")
ROW = ("path", "n", *META[1:])
#: Bytes of postings or of texts that a task makes into blocks at a time; blocks it gives on at a time.
RUN, TEXTS, GIVEN = 64 << 20, 8 << 20, 4096
#: Bytes that are in words, as ``\\w`` is in Java.
WORD = np.array([chr(b).isalnum() and b < 128 or b == ord("_") for b in range(256)])
#: Blocks in a page of a stored file, the least that a search reads of it.
PAGE = 1000


def impact() -> Column:
    return F.try_divide(F.col("n"), F.col("n_chars")) * F.least(F.lit(1.0), F.col("size") / 10000)


def blocks(postings: DataFrame, meta: DataFrame, size: int = BLOCK) -> DataFrame:
    """term, block, bound, filled, rows.  postings: term, path, n; meta: path, n_chars, size, modified, language.

    Blocks are made where the postings of a file lie, in runs of up to ``RUN`` bytes, so
    postings are neither shuffled nor sorted over the whole index, and no term's postings meet
    in one task.  A term has blocks of its own in each run; which blocks a search reads does not
    change what it finds.  ``block`` tells all blocks apart; a block of postings without an
    impact has the bound of minus infinity.
    """
    # Files are fewer than postings, which pass by a table of them unsorted.
    hits = postings.join(meta.hint("shuffle_hash"), "path").select("term", *META, "n", F.coalesce(impact(), F.lit(float("-inf"))).alias("impact"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for t in _runs(((b, b.nbytes) for b in batches if b.num_rows), RUN):
            term = t["term"].combine_chunks().dictionary_encode()
            made = _made(term.dictionary, _places(term.dictionary)[term.indices.to_numpy()], t["impact"].to_numpy(), t, t["n"].combine_chunks(), np.arange(t.num_rows), size, block)
            block += made.num_rows
            yield from _given(made)

    return hits.mapInArrow(run, _schema(hits))


def blocks_of_files(files: DataFrame, meta: DataFrame, size: int = BLOCK) -> DataFrame:
    """The same of texts: what ``blocks`` gives of ``textindex.postings(files)``.

    A file's text is given to a task whole and its words are counted there, where postings would
    pass one by one.  files: path, content.
    """
    texts = textindex.texts(files.filter("path IS NOT NULL")).select("path", F.lower("content").alias("content"))
    hits = texts.join(meta.hint("shuffle_hash"), "path").select("content", *META, F.nullif(F.col("n_chars").cast("double"), F.lit(0.0)).alias("chars"), F.least(F.lit(1.0), F.col("size") / 10000).alias("bonus"), F.lit(0).cast("long").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for t in _runs((x for b in batches for x in _cut(b)), TEXTS):
            words, file = _words(t["content"].combine_chunks())
            term = words.dictionary_encode()
            taken = pc.and_(pc.greater(pc.utf8_length(term.dictionary), 2), pc.invert(pc.is_in(term.dictionary, pa.array(text.STOP_WORDS))))
            term_of = term.indices.to_numpy()
            kept = taken.to_numpy(zero_copy_only=False)[term_of]
            pairs, n = np.unique(_places(term.dictionary)[term_of[kept]] * t.num_rows + file[kept], return_counts=True)
            terms, file = np.divmod(pairs, t.num_rows)
            impacts = n / t["chars"].to_numpy()[file] * t["bonus"].to_numpy()[file]
            made = _made(term.dictionary, terms, np.where(np.isnan(impacts), -np.inf, impacts), t, pa.array(n), file, size, block)
            block += made.num_rows
            yield from _given(made)

    return hits.mapInArrow(run, _schema(hits))


def _words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """What ``split`` by ``\\W+`` leaves of lower-cased texts, but for empty ones, and the place of each word's text."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if at[0] == at[-1]:
        return pa.array([], pa.string()), np.empty(0, dtype=np.int64)
    data, at = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]
    inside = WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    some = at[:-1] < at[1:]  # a word ends with its text
    first[at[:-1][some]] = inside[at[:-1][some]]
    last[at[1:][some] - 1] = inside[at[1:][some] - 1]
    starts = np.flatnonzero(first)
    ends = np.cumsum(np.concatenate(([0], np.flatnonzero(last) - starts + 1))).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[inside])), np.searchsorted(at, starts, "right") - 1


def _schema(hits: DataFrame) -> T.StructType:
    row = T.StructType([hits.schema[c] for c in ROW])
    return T.StructType().add("term", "string").add("block", "long").add("bound", "double").add("filled", "long").add("rows", T.ArrayType(row))


def _cut(files: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Files of up to ``TEXTS`` bytes of text, or one with more, and how many bytes they have."""
    ends, start = np.cumsum(pc.binary_length(files["content"]).to_numpy(), dtype=np.int64), 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + TEXTS, "right")))
        yield files.slice(start, end - start), int(ends[end - 1] - before)
        start = end


def _runs(parts: Iterator[tuple[pa.RecordBatch, int]], most: int) -> Iterator[pa.Table]:
    """Parts put together while they hold ``most`` bytes at most."""
    held, used = [], 0
    for b, n in parts:
        if held and used + n > most:
            yield pa.Table.from_batches(held)
            held, used = [], 0
        held.append(b)
        used += n
    if held:
        yield pa.Table.from_batches(held)


def _places(dictionary: pa.Array) -> np.ndarray:
    """Of each term its place among all in order."""
    out = np.empty(len(dictionary), dtype=np.int64)
    out[pc.sort_indices(dictionary).to_numpy()] = np.arange(len(out))
    return out


def _made(dictionary: pa.Array, terms: np.ndarray, impacts: np.ndarray, files: pa.Table, n: pa.Array, file: np.ndarray, size: int, first: int) -> pa.RecordBatch:
    """Blocks by term and falling impact, of postings given as places of terms, impacts, counts and rows of ``files``."""
    order = np.lexsort((-impacts, terms))
    terms, impacts, file = terms[order], impacts[order], pa.array(file[order])
    new = np.flatnonzero(np.diff(terms, prepend=-1))
    in_term = np.arange(len(terms)) - np.repeat(new, np.diff(new, append=len(terms)))
    starts = np.flatnonzero(in_term % size == 0)
    ends = np.append(starts, len(terms)).astype(np.int32)
    rows = pa.StructArray.from_arrays([n.take(pa.array(order)) if c == "n" else files[c].combine_chunks().take(file) for c in ROW], names=list(ROW))
    named = dictionary.take(pc.sort_indices(dictionary)).take(pa.array(terms[starts]))
    return pa.RecordBatch.from_arrays(
        [named, pa.array(first + np.arange(len(starts))), pa.array(impacts[starts]), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), rows)],
        names=["term", "block", "bound", "filled", "rows"],
    )


def _given(made: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, made.num_rows, GIVEN):
        yield made.slice(i, GIVEN)


@dataclass
class Reads:
    """What a search has read: blocks, of so many of its terms."""

    blocks: int
    of: int


class Index:
    """A stored index in a folder: ``blocks``, ``version`` and ``results``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.hits, self.misses, self.reads = spark, path, 0, 0, Reads(0, 0)

    def _has(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def save(self, postings: DataFrame, meta: DataFrame, size: int = BLOCK) -> Index:
        return self._store(blocks(postings, meta, size))

    def save_files(self, files: DataFrame, meta: DataFrame, size: int = BLOCK) -> Index:
        """The same from texts: path, content."""
        return self._store(blocks_of_files(files, meta, size))

    def _store(self, made: DataFrame) -> Index:
        version = self.version() + 1
        made.write.mode("overwrite").option("parquet.page.row.count.limit", str(PAGE)).parquet(f"{self.path}/blocks")
        self.spark.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{self.path}/version")
        return self

    def version(self) -> int:
        return self.spark.read.parquet(f"{self.path}/version").first()[0] if self._has("version") else 0

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def search(self, query: str, now: datetime.datetime, limit: int = 10, language: str | None = None) -> DataFrame:
        """path, term, n, score, best first: what ``textindex.search`` gives with this limit."""
        terms = textindex.query_terms(query)
        own = self.blocks().filter(F.col("term").isin(*terms))
        scored = lambda b: textindex.scores(b.select("term", F.explode("rows").alias("r")).select("term", "r.*"), F.lit(now), language)
        most = FRESHEST * (SAME_LANGUAGE if language else 1.0)
        order = (F.desc("bound"), "term", "block")
        few = 1
        while True:
            # Twice as many blocks a round, until the next one cannot reach the score of the last result.
            best = [b.bound for b in own.select("term", "block", "bound").orderBy(*order).limit(few + 1).collect()]
            read = own.filter(F.col("bound") >= best[min(few, len(best)) - 1]) if best else own
            found = scored(read).orderBy(F.desc("score"), "path", "term").limit(limit)
            if len(best) <= few:
                break
            floor = found.agg(F.min(F.coalesce("score", F.lit(float("-inf")))), F.count("*")).first()
            if floor[1] == limit and best[few] * most < floor[0]:
                break
            few *= 2
        self.reads = Reads(read.count(), own.count())
        return found

    def cached(self, query: str, now: datetime.datetime, limit: int = 10, language: str | None = None, kept: int = KEPT) -> DataFrame:
        """The same, kept by query, limit, language, day and version; the oldest beyond ``kept`` results go."""
        asked = json.dumps([query, limit, language, now.date().isoformat(), self.version()])
        key = hashlib.sha256(asked.encode()).hexdigest()
        if self._has(f"results/{key}/_SUCCESS"):
            self.hits += 1
        else:
            self.misses += 1
            self.search(query, now, limit, language).withColumn("nth", F.monotonically_increasing_id()).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/results/{key}")
            self._forget(kept)
        return self.spark.read.parquet(f"{self.path}/results/{key}").orderBy("nth").drop("nth")

    def _forget(self, kept: int) -> None:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/results")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        held = sorted(fs.listStatus(root), key=lambda s: (s.getModificationTime(), s.getPath().getName()))
        for s in held[: max(0, len(held) - kept)]:
            fs.delete(s.getPath(), True)
