"""Inverted index over words, pairs and triples; searches on it; suggestions; usages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.functions import text

#: Postings that a task gives on at a time, beside the last file's.
POSTINGS = 20_000


def texts(files: DataFrame) -> DataFrame:
    """path, content: a path that comes twice is one file of all its texts."""
    return files.groupBy("path").agg(F.concat_ws(" ", F.collect_list("content")).alias("content"))


def postings(files: DataFrame) -> DataFrame:
    """term, path, n: how often each index word occurs in a file.

    Texts are shuffled once, by path; a file's words are then counted where it lies, where
    (term, path) rows would be shuffled with a path each.
    """
    w = F.filter(F.split(F.lower(F.coalesce("content", F.lit(""))), r"\W+"), lambda x: (F.length(x) > 2) & ~x.isin(*text.STOP_WORDS))
    words = files.select("path", "content").repartition("path").select("path", F.explode(w).alias("term"))
    return words.groupBy("term", "path").agg(F.count("*").alias("n"))


def postings_with_positions(files: DataFrame) -> DataFrame:
    """term, path, positions (0-based offsets of non-overlapping occurrences, ascending), for all index terms.

    A file's terms are found in one pass over its text by an automaton of them all, in Arrow
    batches: built-in functions would scan the text again for each term.  Needs ``pyahocorasick``
    where it runs.
    """
    t = files.select("path", F.lower("content").alias("content"), F.array_distinct(text.terms(F.col("content"))).alias("terms"))
    out = T.StructType([T.StructField("term", T.StringType()), t.schema["path"], T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        def rows() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = pa.array(np.fromiter((at for x in lists for at in x), dtype=np.int32, count=int(ends[-1])))
            named = pa.array(paths, kind).take(pa.array(np.repeat(np.arange(len(paths)), many)))
            return pa.RecordBatch.from_arrays([pa.array(found_terms, pa.string()), named, pa.ListArray.from_arrays(pa.array(ends), flat)], names=["term", "path", "positions"])

        paths, many, found_terms, lists = [], [], [], []
        for b in batches:
            kind = b.schema.field("path").type
            for i in range(b.num_rows):
                path, content, terms = (c[i].as_py() for c in b.columns)
                if not terms or content is None:
                    continue
                automaton = ahocorasick.Automaton()
                for term in terms:
                    automaton.add_word(term, term)
                automaton.make_automaton()
                found: dict[str, list[int]] = {}
                for end, term in automaton.iter(content):
                    at, mine = end - len(term) + 1, found.setdefault(term, [])
                    if not mine or at >= mine[-1] + len(term):
                        mine.append(at)
                paths.append(path)
                many.append(len(found))
                found_terms += found
                lists += found.values()
                if len(lists) >= POSTINGS:
                    yield rows()
                    paths, many, found_terms, lists = [], [], [], []
        if paths:
            yield rows()

    return t.mapInArrow(run, out)


def save(index: DataFrame, path: str, parts: int | None = None) -> None:
    """Store postings sorted by term, so that the few terms of a query read few row groups."""
    ranged = index.repartitionByRange(parts, "term") if parts else index.repartitionByRange("term")
    ranged.sortWithinPartitions("term", "path").write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    """Stored postings; ``search`` pushes its terms down to the scan."""
    return spark.read.parquet(path)


def update(index: DataFrame, changed: DataFrame) -> DataFrame:
    """The index with the changed files' postings replaced."""
    return remove(index, changed.select("path")).unionByName(postings(changed))


def remove(index: DataFrame, gone: DataFrame) -> DataFrame:
    return index.join(gone.select("path").distinct(), "path", "left_anti").select("term", "path", "n")


def query_terms(query: str, exact: bool = False) -> list[str]:
    if exact:
        return [query.lower()]
    return list(dict.fromkeys(w for w in re.split(r"\W+", query.lower()) if len(w) > 2 and w not in text.STOP_WORDS))


def scores(hits: DataFrame, now: Column, language: str | None = None) -> DataFrame:
    """path, term, n, score of postings with their files: frequency by length x recency x language x size."""
    age = F.datediff(now, F.col("modified"))
    fresh = F.when(F.col("modified").isNull(), 0.5).otherwise(F.greatest(F.lit(0.1), 1 - age / 365))
    same = F.when(F.col("language") == language, 1.2).otherwise(1.0) if language else F.lit(1.0)
    scored = hits.withColumn("score", F.try_divide(F.col("n"), F.col("n_chars")) * fresh * same * F.least(F.lit(1.0), F.col("size") / 10000))
    return scored.select("path", "term", "n", "score")


def search(index: DataFrame, meta: DataFrame, query: str, now: Column, language: str | None = None, limit: int | None = None) -> DataFrame:
    """path, term, n, score, best first.

    meta: path, n_chars, size, modified, language.  The few terms prune the index by pushdown.
    """
    hits = index.filter(F.col("term").isin(*query_terms(query))).join(meta, "path")
    out = scores(hits, now, language).orderBy(F.desc("score"), "path", "term")
    return out if limit is None else out.limit(limit)


def storage_search(files: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Files by occurrences of the query's terms over text length."""
    total = F.lit(0)
    for t in query_terms(query):
        total = total + F.regexp_count(F.lower("content"), F.lit(re.escape(t)))
    return files.withColumn("score", F.try_divide(total, F.length("content"))).filter("score > 0").select("path", "score").orderBy(F.desc("score"), "path").limit(limit)


def fuzzy(terms: DataFrame, query: str, ratio: float = 0.3, least: int = 2) -> DataFrame:
    """term, query, distance, score of terms within max(2, 30 % of the length) edits.

    The query's words are constants; lengths are compared before edits are counted.
    """
    wanted = F.explode(F.array(*[F.lit(q) for q in query_terms(query)])).alias("query")
    pairs = terms.select("term", wanted)
    allowed = F.greatest(F.lit(least), F.floor(F.length("query") * ratio))
    near = pairs.filter(F.abs(F.length("term") - F.length("query")) <= allowed).withColumn("distance", F.levenshtein("term", "query"))
    return near.filter(F.col("distance") <= allowed).withColumn("score", 1 - F.col("distance") / F.greatest(F.length("term"), F.length("query")))


def word_overlap(files: DataFrame, query: str, least: float = 0.1) -> DataFrame:
    return files.withColumn("score", text.overlap_score(F.lit(query), F.col("content"))).filter(F.col("score") > least).select("path", "score").orderBy(F.desc("score"), "path")


def explain_usage(chunks: DataFrame, symbol: str) -> DataFrame:
    """Chunks that define or mention a symbol; the first of them is the definition."""
    rx = rf"(?i){text.WORD_EDGE}{re.escape(symbol)}{text.WORD_EDGE}"
    hit = chunks.filter(F.array_contains("symbols", symbol) | F.col("content").rlike(rx))
    first = hit.filter(F.array_contains("symbols", symbol)).agg(F.min(F.struct("path", "start_line")).alias("_first"))  # one row
    return hit.crossJoin(F.broadcast(first)).withColumn("is_definition", F.coalesce(F.struct("path", "start_line") == F.col("_first"), F.lit(False))).drop("_first")


def related_terms(history: DataFrame, results: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Earlier queries that share a word with this one, then words of result paths."""
    mine = F.array(*[F.lit(w) for w in query_terms(query)])
    past = history.filter(F.arrays_overlap(text.words(F.col("query")), mine) & (F.lower("query") != query.lower())).select(F.lower("query").alias("term"), F.lit(0).alias("source"))
    parts = results.select(F.explode(F.filter(F.split(F.lower("path"), r"[/._-]"), lambda w: F.length(w) > 3)).alias("term"), F.lit(1).alias("source"))
    return past.unionByName(parts).groupBy("term").agg(F.min("source").alias("source")).orderBy("source", "term").limit(limit)


def popular(history: DataFrame, limit: int = 10) -> DataFrame:
    return history.groupBy(F.lower("query").alias("query")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(limit)


def recent_distinct(history: DataFrame, window: int = 50, limit: int = 10) -> DataFrame:
    """Latest use of each query among the last ``window`` (a bounded window)."""
    last = history.orderBy(F.desc("ts"), "query").limit(window)
    return last.groupBy("query").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "query").limit(limit)


def suggestions(history: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Earlier queries that start with a prefix, most used first."""
    return popular(history.filter(F.startswith(F.lower("query"), F.lit(prefix.lower()))), limit)
