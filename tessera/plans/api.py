"""The service's calls as functions of DataFrames: search, context, usages, listings, prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import paths, text, tokens
from tessera.operators import analytics, chunking, compression, routing, search, selection, textindex


def search_repo(chunks: DataFrame, query: list[float], limit: int = 10, min_score: float = 0.0, **filters) -> DataFrame:
    k, least = search.clamp(limit, min_score)
    return search.ranked(search.top_k(search.filters(chunks, **filters), query, k, least))


def get_context(chunks: DataFrame, path: str) -> DataFrame:
    """A file's chunks in order; a path also matches by its end."""
    p = path.replace("\\", "/")
    return chunks.filter((F.col("path") == p) | F.endswith("path", F.lit(p))).orderBy("path", "start_line")


def get_chunk(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == chunk_id)


def explain_usage(chunks: DataFrame, symbol: str, limit: int = 10) -> DataFrame:
    with_symbols = chunks if "symbols" in chunks.columns else chunks.withColumn("symbols", chunking.symbols(F.col("content")))
    return textindex.explain_usage(with_symbols, symbol).orderBy(F.desc("is_definition"), "path", "start_line").limit(limit)


def list_indexed_files(chunks: DataFrame) -> DataFrame:
    return analytics.listed_files(chunks)


def suggest(history: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    return textindex.suggestions(history, prefix, limit)


def chat_context(chunks: DataFrame, query: list[float], limit: int = 5) -> DataFrame:
    """Top hits with their first lines and symbols, for a reply."""
    hits = search_repo(chunks, query, limit)
    return hits.withColumn("context", F.slice(F.split("content", "\n"), 1, 5)).withColumn("symbols", F.slice(chunking.symbols(F.col("content")), 1, 10))


def health(chunks: DataFrame) -> DataFrame:
    return analytics.live_counts(chunks).withColumn("status", F.lit("ok"))


def contexts(scored: DataFrame, budget: int) -> DataFrame:
    """For each query_id: its chosen and compressed candidates as ``context``, their number and tokens.

    scored: query_id, id, path, content, language, kind, signature, start_line, end_line, score.
    """
    dense = selection.with_density(scored)
    chosen = selection.select_within(dense, budget, by="query_id", min_score=0.3, diversity=True)
    body = scored.select("query_id", "id", "content", "language", "kind", "signature", "start_line", "end_line")
    full = compression.compress(chosen.join(body, ["query_id", "id"]), F.greatest(F.lit(1), F.floor(F.lit(budget) / 20)))
    text_of = selection.prompt(full.drop("content").withColumnRenamed("compressed", "content"), by="query_id")
    sums = full.groupBy("query_id").agg(F.count("*").alias("chunks"), F.sum("original_tokens").alias("original"), F.sum("compressed_tokens").alias("optimized"))
    return text_of.withColumnRenamed("prompt", "context").join(sums, "query_id")


def answer(requests: DataFrame, known: DataFrame, affordable: Column) -> DataFrame:
    """For each request: intent, the context of its query_id, tokens saved, model.

    requests: id, prompt, query_id.  known: ``contexts``; requests with the same candidates share one.
    """
    out = routing.detect(requests).join(known, "query_id").drop("query_id")
    return out.withColumn("savings", selection.savings(F.col("original"), F.col("optimized"))).withColumn("model", routing.route(F.col("optimized"), F.col("complexity"), affordable))


def reconstruct_prompt(requests: DataFrame, scored: DataFrame, budget: int, affordable: Column) -> DataFrame:
    """``answer`` for requests (id, prompt) that each have candidates of their own: query_id in ``scored`` is the request's id."""
    return answer(requests.withColumn("query_id", F.col("id")), contexts(scored, budget), affordable)


__all__ = ["answer", "chat_context", "contexts", "explain_usage", "get_chunk", "get_context", "health", "list_indexed_files", "paths", "reconstruct_prompt", "search_repo", "suggest", "text", "tokens"]
