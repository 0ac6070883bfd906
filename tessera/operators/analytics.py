"""Statistics over index, cache, usage, health and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def live_counts(chunks: DataFrame) -> DataFrame:
    return chunks.filter("deleted_at is null").agg(F.count("*").alias("total_chunks"), F.count_distinct("path").alias("total_files"))


def by_language(chunks: DataFrame) -> DataFrame:
    """language, file_count, chunk_count of live chunks."""
    return chunks.filter("deleted_at is null").groupBy("language").agg(F.count_distinct("path").alias("file_count"), F.count("*").alias("chunk_count"))


def index_statistics(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row; both sides are single-row aggregates."""
    f = files.filter("deleted_at is null").agg(F.count("*").alias("total_files"), F.sum("chunk_count").alias("total_chunk_refs"), F.max("last_indexed").alias("last_updated"))
    return f.crossJoin(F.broadcast(chunks.filter("deleted_at is null").agg(F.count("*").alias("total_chunks"))))


def daily_usage(log: DataFrame) -> DataFrame:
    return log.groupBy("date", "metric").agg(F.sum("value").alias("total_value"), F.count_distinct("user_id").alias("unique_users"))


def active_users(users: DataFrame, conversations: DataFrame, now: Column) -> DataFrame:
    """Users active within a day and their conversations of that day."""
    since = now - F.expr("interval 1 day")
    recent = conversations.filter(F.col("created_at") >= since).groupBy("user_id").agg(F.count_distinct("conv_id").alias("conversation_count"))
    return users.filter(F.col("last_active") >= since).join(recent, "user_id", "left").withColumn("conversation_count", F.coalesce("conversation_count", F.lit(0)))


def popular_documents(documents: DataFrame, chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Documents by how many of their chunks are cached under ``chunk:<id>``."""
    hits = chunks.withColumn("key", F.concat(F.lit("chunk:"), F.col("chunk_id"))).join(cache.select("key").distinct(), "key").groupBy("doc_id").agg(F.count_distinct("key").alias("access_count"))
    return documents.join(hits, "doc_id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)))


def cache_performance(cache: DataFrame, now: Column) -> DataFrame:
    within = lambda days: F.count_if(F.unix_micros(now) - F.unix_micros("created_at") < days * 86_400_000_000)
    return cache.agg(F.count("*").alias("total_entries"), F.sum("access_count").alias("total_accesses"), F.avg("access_count").alias("avg_accesses"), F.max("access_count").alias("max_accesses"), within(1).alias("entries_last_24h"), within(7).alias("entries_last_7d"))


def provider_stats(metrics: DataFrame) -> DataFrame:
    hits = F.count_if(F.col("cache_hit"))
    return metrics.groupBy("provider", "model").agg(
        F.count("*").alias("total"), F.avg("generation_time").alias("avg_time"), F.min("generation_time").alias("min_time"), F.max("generation_time").alias("max_time"),
        hits.alias("cache_hits"), F.count_if(~F.col("cache_hit")).alias("cache_misses"), (hits / F.count("*")).alias("hit_rate"),
    )


def error_stats(metrics: DataFrame) -> DataFrame:
    return metrics.filter("error is not null").groupBy("provider", "error").agg(F.count("*").alias("error_count"), F.max("ts").alias("last_occurrence"))


def token_metrics(savings: DataFrame) -> DataFrame:
    """Totals, ratio of sums, best and worst single ratio."""
    ratio = F.try_divide(F.col("original"), F.col("optimized"))
    return savings.agg(F.count("*").alias("queries"), F.sum("original").alias("original"), F.sum("optimized").alias("optimized"), (F.sum("original") - F.sum("optimized")).alias("saved"), F.try_divide(F.sum("original"), F.sum("optimized")).alias("avg_ratio"), F.max(ratio).alias("best_ratio"), F.min(ratio).alias("worst_ratio"))


def token_metrics_by_type(savings: DataFrame) -> DataFrame:
    """The same a query type, with the records of best and worst ratio, earliest first."""
    ratio = F.col("original") / F.col("optimized")
    return savings.groupBy("query_type").agg(F.count("*").alias("queries"), F.sum("original").alias("original"), F.sum("optimized").alias("optimized"), F.max_by("id", F.struct(ratio, F.negative("id"))).alias("best_id"), F.min_by("id", F.struct(ratio, "id")).alias("worst_id"))


def health(requests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Requests, failures, latency over successes only, error rate."""
    ok = lambda c: F.when(F.col("success"), F.col(c))
    return requests.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), F.count_if(F.col("success")).alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.avg(ok("latency")), F.lit(0.0)).alias("avg_latency"),
        F.min(ok("latency")).alias("min_latency"), F.max(ok("latency")).alias("max_latency"), F.coalesce(F.try_divide(F.count_if(~F.col("success")), F.count("*")), F.lit(0.0)).alias("error_rate"),
    )


def is_healthy(stats: DataFrame, most_errors: float = 0.1, most_latency: float = 5000.0) -> DataFrame:
    return stats.withColumn("healthy", (F.col("error_rate") <= most_errors) & (F.col("avg_latency") <= most_latency))


def text_index_stats(index: DataFrame) -> DataFrame:
    """Terms, files, mean terms a file, largest and smallest file."""
    files = index.groupBy("path").agg(F.count("*").alias("terms"))
    f = files.agg(F.count("*").alias("files"), F.avg("terms").alias("avg_terms"), F.max_by("path", F.struct("terms", "path")).alias("largest"), F.min_by("path", F.struct("terms", "path")).alias("smallest"))
    return f.crossJoin(F.broadcast(index.agg(F.count_distinct("term").alias("terms"))))


def storage_metrics(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("mtime").alias("oldest"), F.max("mtime").alias("newest"), F.count_distinct("language").alias("languages"))


def progress_summary(chunks: DataFrame, seconds: float) -> DataFrame:
    n = F.count_distinct("path")
    return chunks.agg(n.alias("files"), F.count("*").alias("chunks"), F.round(F.try_divide(F.count("*"), n), 2).alias("chunks_per_file"), F.round(n / seconds, 2).alias("files_per_second"))


def language_and_kind(chunks: DataFrame) -> DataFrame:
    """Counts by language and by kind in one pass."""
    return chunks.groupingSets([["language"], ["kind"]], "language", "kind").agg(F.count("*").alias("n"))


def history_stats(history: DataFrame) -> DataFrame:
    n = F.count_distinct(F.lower("query"))
    return history.agg(F.count("*").alias("total"), n.alias("distinct_queries"), F.try_divide(F.count("*"), n).alias("avg_uses"))


def listed_files(chunks: DataFrame) -> DataFrame:
    """Files with chunk counts, listed by language: file rows first, so lists hold files only."""
    per_file = chunks.groupBy("language", "path").agg(F.count("*").alias("chunks"))
    return per_file.groupBy("language").agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.array_sort(F.collect_list(F.struct("path", "chunks"))).alias("listing"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Content hashes held by more than one file, how often, and the first path."""
    return files.groupBy(F.sha2("content", 256).alias("hash")).agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).filter("copies > 1")


def sample_stats(df: DataFrame, value: str) -> DataFrame:
    """min, max, mean, population deviation and upper median (element n/2 of the sorted values).

    The median counts values at or below each distinct value, so no list of all is built.
    Values are dealt to 4,096 slices of their range; only slices are counted in one task.
    """
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    span = F.when(F.col("max") > F.col("min"), F.floor((F.col("v") - F.col("min")) / (F.col("max") - F.col("min")) * 4095)).otherwise(0).cast("int")
    counts = counts.filter("v is not null").crossJoin(F.broadcast(total.select(F.col("n").alias("total"), "min", "max"))).withColumn("slice", span)
    before = counts.groupBy("slice").agg(F.sum("n").alias("held")).select("slice", (F.sum("held").over(Window.orderBy("slice")) - F.col("held")).alias("before"))
    upto = counts.join(F.broadcast(before), "slice").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("slice").orderBy("v")))
    median = upto.filter(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("v").alias("median"))
    return total.crossJoin(F.broadcast(median))


def size_estimates(chunks: DataFrame) -> DataFrame:
    """Bytes a memory store, a table store and a graph index would take."""
    length, dim = F.length("content"), F.size("embedding")
    return chunks.agg(F.sum(2 * length + 8 * dim + 200).alias("memory_bytes"), F.sum(2 * length + 4 * dim + 64 + 200).alias("table_bytes"), F.sum(4 * dim + 150).alias("index_bytes"))


def register_views(spark, tables: dict[str, DataFrame], now: Column | None = None) -> list[str]:
    """Temporary views under their usual names over the tables that are given, themselves views by their keys.

    chunks, files, index_metadata; users, conversations; usage_log; documents, document_chunks,
    cache_metadata; embedding_cache; embedding_metrics.  A view is made where all its tables are.
    """
    at = F.current_timestamp() if now is None else now
    live = lambda df: df.filter("deleted_at IS NULL")
    views = {
        "active_code_chunks": (live, "chunks"), "active_indexed_files": (live, "files"), "files_by_language": (by_language, "chunks"), "index_statistics": (index_statistics, "files", "chunks"),
        "active_users": (lambda u, c: active_users(u, c, at), "users", "conversations"), "daily_usage_summary": (daily_usage, "usage_log"), "popular_documents": (popular_documents, "documents", "document_chunks", "cache_metadata"),
        "v_cache_performance": (lambda c: cache_performance(c, at), "embedding_cache"), "v_provider_stats": (provider_stats, "embedding_metrics"), "v_error_stats": (error_stats, "embedding_metrics"),
    }
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    made = [name for name, (_, *needs) in views.items() if all(n in tables for n in needs)]
    for name in made:
        f, *needs = views[name]
        f(*(tables[n] for n in needs)).createOrReplaceTempView(name)
    return made
