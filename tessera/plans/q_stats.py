"""Queries of statistics, views, usage analytics and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import analytics, textindex
from tessera.plans.common import FILES, files, history, r6, table
from tessera.streaming import caches, state


def _chunks(s, d):
    """Live and deleted chunks: a document each, every ninth deleted."""
    return files(s, d).select(F.col("doc_id").alias("id"), "path", "content", "language", F.when(F.col("doc_id") % 9 == 0, F.to_timestamp(F.lit("2024-01-01"))).alias("deleted_at"), F.when(F.col("doc_id") % 4 == 0, "class").otherwise("function").alias("kind"))


def _files(s, d):
    return files(s, d).select("path", "content", "language", F.octet_length("content").cast("long").alias("size"), (F.col("doc_id") % 100).alias("mtime"), F.when(F.col("doc_id") % 9 == 0, F.to_timestamp(F.lit("2024-01-01"))).alias("deleted_at"), (F.col("doc_id") % 5).alias("chunk_count"), F.col("doc_id").alias("last_indexed"))


def _metrics(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("provider"), (F.col("user_id") % 3).alias("model"), F.round("value", 2).alias("generation_time"), (F.col("user_id") % 2 == 0).alias("cache_hit"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("user_id") % 4)).alias("error"), F.col("ts"))


def _savings(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("original"), (F.col("o_custkey") % 500 + 1).alias("optimized"), F.col("o_orderpriority").alias("query_type"))


def live_counts(s, d):
    return analytics.live_counts(_chunks(s, d))


def files_by_language(s, d):
    return analytics.by_language(_chunks(s, d))


def index_statistics(s, d):
    return analytics.index_statistics(_files(s, d), _chunks(s, d))


def daily_usage(s, d):
    log = table(s, d, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("metric"), F.floor("value").cast("long").alias("value"), "user_id")
    return analytics.daily_usage(log).withColumn("date", F.col("date").cast("string"))


def active_users(s, d):
    at = F.to_timestamp(F.lit("2024-01-29 00:00:00"))
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("ts") < at)
    users = e.groupBy("user_id").agg(F.max("ts").alias("last_active"))
    conv = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("conv_id"), F.col("ts").alias("created_at"))
    return analytics.active_users(users, conv, at).select("user_id", "conversation_count")


def popular_documents(s, d):
    docs = table(s, d, "documents").select("doc_id", "source")
    c = table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 50).alias("doc_id"))
    cache = table(s, d, "labels").select(F.concat(F.lit("chunk:"), "doc_id").alias("key"))
    return analytics.popular_documents(docs, c, cache).select("doc_id", "access_count")


def cache_performance(s, d):
    c = table(s, d, "events").select((F.col("user_id") + 1).alias("access_count"), F.col("ts").cast("timestamp").alias("created_at"))
    p = analytics.cache_performance(c, F.to_timestamp(F.lit("2024-01-30 00:00:00")))
    return p.withColumn("avg_accesses", r6(F.col("avg_accesses")))


def provider_stats(s, d):
    p = analytics.provider_stats(_metrics(s, d))
    return p.withColumn("avg_time", r6(F.col("avg_time"))).withColumn("hit_rate", r6(F.col("hit_rate")))


def error_stats(s, d):
    return analytics.error_stats(_metrics(s, d))


def token_metrics(s, d):
    m = analytics.token_metrics(_savings(s, d))
    return m.select("queries", "original", "optimized", "saved", *[r6(F.col(c)).alias(c) for c in ("avg_ratio", "best_ratio", "worst_ratio")])


def token_metrics_by_type(s, d):
    return analytics.token_metrics_by_type(_savings(s, d))


def health(s, d):
    r = table(s, d, "events").select((F.col("event_type") != "error").alias("success"), F.round("value", 2).alias("latency"), F.to_date("ts").alias("day"))
    h = analytics.is_healthy(analytics.health(r, ["day"]), 0.2)
    return h.select(F.col("day").cast("string").alias("day"), "total", "succeeded", "failed", r6(F.col("avg_latency")).alias("avg_latency"), "min_latency", "max_latency", r6(F.col("error_rate")).alias("error_rate"), "healthy")


def text_index_stats(s, d):
    index = textindex.postings(files(s, d))
    return analytics.text_index_stats(index).select("files", r6(F.col("avg_terms")).alias("avg_terms"), "largest", "smallest", "terms")


def storage_metrics(s, d):
    return analytics.storage_metrics(_files(s, d))


def progress(s, d):
    return analytics.progress_summary(_chunks(s, d).withColumn("path", F.substring_index("path", "/", 4)), 10.0)


def grouping_sets(s, d):
    return analytics.language_and_kind(_chunks(s, d))


def history_stats(s, d):
    return analytics.history_stats(history(s, d)).withColumn("avg_uses", r6(F.col("avg_uses")))


def listed_files(s, d):
    li = analytics.listed_files(_chunks(s, d))
    return li.select("language", "files", "chunks", F.get("listing", F.lit(0))["path"].alias("first_path"))


def duplicates(s, d):
    return analytics.duplicate_groups(_files(s, d))


def sample_stats(s, d):
    x = analytics.sample_stats(table(s, d, "lineitem"), "l_quantity")
    return x.select("n", "min", "max", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "median")


def size_estimates(s, d):
    f = files(s, d).join(table(s, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return analytics.size_estimates(f)


def rate_limit(s, d):
    r = state.rate_limited(table(s, d, "events"), 30)
    return r.select("event_id", "in_window", "allowed")


def usage_by_hour(s, d):
    e = table(s, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


def views(s, d):
    analytics.register_views(s, {"chunks": _chunks(s, d), "files": _files(s, d)})
    return s.sql("SELECT language, file_count, chunk_count FROM files_by_language WHERE chunk_count > 0")


def view_providers(s, d):
    """Providers with their errors, by SQL over two of the views."""
    e = table(s, d, "events")
    log = e.select(F.to_date("ts").alias("date"), F.col("event_type").alias("metric"), F.floor("value").cast("long").alias("value"), "user_id")
    analytics.register_views(s, {"embedding_metrics": _metrics(s, d), "usage_log": log})
    return s.sql(
        "SELECT p.provider, p.total, coalesce(x.errors, 0) AS errors, u.days FROM (SELECT provider, CAST(sum(total) AS BIGINT) AS total FROM v_provider_stats GROUP BY provider) p"
        " LEFT JOIN (SELECT provider, CAST(sum(error_count) AS BIGINT) AS errors FROM v_error_stats GROUP BY provider) x ON x.provider = p.provider JOIN (SELECT metric, count(*) AS days FROM daily_usage_summary GROUP BY metric) u ON u.metric = p.provider"
    )


def recent_savings(s, d):
    return _savings(s, d).orderBy(F.desc("id")).limit(20).select("id", "original", "optimized")


def _cached(policy, capacity, ttl):
    """What a policy does for the events as requests, a key being a user's kind of event."""

    def query(s, d):
        e = table(s, d, "events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
        return caches.cached(e, policy, capacity, ttl, shards=64).select("key", "ts", "hit", "size", "evicted")

    return query


def cache_totals(s, d):
    c = table(s, d, "documents").groupBy("source").agg(F.count("*").alias("entries"), F.sum(F.octet_length("text")).alias("bytes"))
    return c


_C = FILES + ", c AS (SELECT doc_id AS id, path, content, language, doc_id % 9 = 0 AS gone, CASE WHEN doc_id % 4 = 0 THEN 'class' ELSE 'function' END AS kind FROM files)"
_M = "m AS (SELECT event_type AS provider, user_id % 3 AS model, round(value, 2) AS t, user_id % 2 = 0 AS hit, CASE WHEN event_type = 'error' THEN 'e' || (user_id % 4) END AS error, ts FROM events)"
_S = "s AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS original, o_custkey % 500 + 1 AS optimized, o_orderpriority AS query_type FROM orders)"
_WORDS = FILES + ", p AS (SELECT path, term, count(*) AS n FROM (SELECT path, unnest(list_filter(regexp_split_to_array(lower(content), '\\W+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by'))) AS term FROM files) GROUP BY path, term), f AS (SELECT path, count(*) AS terms FROM p GROUP BY path)"

QUERIES = {
    "live_counts": (live_counts, f"WITH {_C} SELECT count(*) AS total_chunks, count(DISTINCT path) AS total_files FROM c WHERE NOT gone"),
    "files_by_language": (files_by_language, f"WITH {_C} SELECT language, count(DISTINCT path) AS file_count, count(*) AS chunk_count FROM c WHERE NOT gone GROUP BY language"),
    "index_statistics": (index_statistics, f"WITH {_C} SELECT count(*) AS total_files, CAST(sum(id % 5) AS BIGINT) AS total_chunk_refs, max(id) AS last_updated, count(*) AS total_chunks FROM c WHERE NOT gone"),
    "daily_usage_summary": (daily_usage, "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type AS metric, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_value, count(DISTINCT user_id) AS unique_users FROM events GROUP BY 1, 2"),
    "active_users": (
        active_users,
        "WITH e AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-29'), u AS (SELECT user_id, max(ts) AS l FROM e GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-28'), c AS (SELECT user_id, count(*) AS n FROM e WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-28' GROUP BY 1) SELECT u.user_id, coalesce(n, 0) AS conversation_count FROM u LEFT JOIN c ON u.user_id = c.user_id",
    ),
    "popular_documents": (popular_documents, "WITH h AS (SELECT vec_id % 50 AS doc_id, count(*) AS n FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels) GROUP BY 1) SELECT d.doc_id, coalesce(n, 0) AS access_count FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id"),
    "cache_performance": (
        cache_performance,
        "SELECT count(*) AS total_entries, CAST(sum(user_id + 1) AS BIGINT) AS total_accesses, round(avg(user_id + 1), 6) AS avg_accesses, max(user_id + 1) AS max_accesses, count(*) FILTER (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(ts) < 86400000000) AS entries_last_24h, count(*) FILTER (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(ts) < 604800000000) AS entries_last_7d FROM events",
    ),
    "provider_stats": (provider_stats, f"WITH {_M} SELECT provider, model, count(*) AS total, round(avg(t), 6) AS avg_time, min(t) AS min_time, max(t) AS max_time, count(*) FILTER (hit) AS cache_hits, count(*) FILTER (NOT hit) AS cache_misses, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS hit_rate FROM m GROUP BY provider, model"),
    "error_stats": (error_stats, f"WITH {_M} SELECT provider, error, count(*) AS error_count, max(ts) AS last_occurrence FROM m WHERE error IS NOT NULL GROUP BY 1, 2"),
    "token_metrics": (token_metrics, f"WITH {_S} SELECT count(*) AS queries, CAST(sum(original) AS BIGINT) AS original, CAST(sum(optimized) AS BIGINT) AS optimized, CAST(sum(original) - sum(optimized) AS BIGINT) AS saved, round(sum(original)::DOUBLE / sum(optimized)::DOUBLE, 6) AS avg_ratio, round(max(original / optimized::DOUBLE), 6) AS best_ratio, round(min(original / optimized::DOUBLE), 6) AS worst_ratio FROM s"),
    "token_metrics_by_type": (token_metrics_by_type, f"WITH {_S} SELECT query_type, count(*) AS queries, CAST(sum(original) AS BIGINT) AS original, CAST(sum(optimized) AS BIGINT) AS optimized, first(id ORDER BY original / optimized::DOUBLE DESC, id) AS best_id, first(id ORDER BY original / optimized::DOUBLE, id) AS worst_id FROM s GROUP BY query_type"),
    "health_by_day": (
        health,
        "WITH r AS (SELECT event_type <> 'error' AS ok, round(value, 2) AS v, CAST(ts AS DATE) AS day FROM events) SELECT CAST(day AS VARCHAR) AS day, count(*) AS total, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, round(coalesce(avg(v) FILTER (ok), 0), 6) AS avg_latency, min(v) FILTER (ok) AS min_latency, max(v) FILTER (ok) AS max_latency, round(count(*) FILTER (NOT ok) / count(*)::DOUBLE, 6) AS error_rate, count(*) FILTER (NOT ok) / count(*)::DOUBLE <= 0.2 AND coalesce(avg(v) FILTER (ok), 0) <= 5000 AS healthy FROM r GROUP BY day",
    ),
    "text_index_stats": (text_index_stats, f"WITH {_WORDS} SELECT count(*) AS files, round(avg(terms), 6) AS avg_terms, first(path ORDER BY terms DESC, path DESC) AS largest, first(path ORDER BY terms, path) AS smallest, (SELECT count(DISTINCT term) FROM p) AS terms FROM f"),
    "storage_metrics": (storage_metrics, f"WITH {FILES} SELECT count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes, min(doc_id % 100) AS oldest, max(doc_id % 100) AS newest, count(DISTINCT language) AS languages FROM files"),
    "progress_summary": (progress, f"WITH {FILES}, a AS (SELECT regexp_extract(path, '^(/[^/]*/[^/]*/[^/]*)', 1) AS p FROM files) SELECT count(DISTINCT p) AS files, count(*) AS chunks, round(count(*) / count(DISTINCT p)::DOUBLE, 2) AS chunks_per_file, round(count(DISTINCT p) / 10.0::DOUBLE, 2) AS files_per_second FROM a"),
    "grouping_sets_lang_kind": (grouping_sets, f"WITH {_C} SELECT language, kind, count(*) AS n FROM c GROUP BY GROUPING SETS ((language), (kind))"),
    "history_stats": (history_stats, "WITH h AS (SELECT event_type || ' ' || (user_id % 20) AS q FROM events) SELECT count(*) AS total, count(DISTINCT q) AS distinct_queries, round(count(*) / count(DISTINCT q)::DOUBLE, 6) AS avg_uses FROM h"),
    "list_indexed_files": (listed_files, f"WITH {_C} SELECT language, count(DISTINCT path) AS files, count(*) AS chunks, min(path) AS first_path FROM c GROUP BY language"),
    "duplicate_groups": (duplicates, f"WITH {FILES} SELECT sha256(content) AS hash, count(*) AS copies, min(path) AS first_path FROM files GROUP BY 1 HAVING count(*) > 1"),
    "sample_stats": (sample_stats, "WITH a AS (SELECT list(l_quantity ORDER BY l_quantity) AS v FROM lineitem) SELECT count(*) AS n, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, (SELECT v[len(v) // 2 + 1] FROM a) AS median FROM lineitem"),
    "size_estimates": (size_estimates, f"WITH {FILES}, a AS (SELECT length(content) AS l, len(embedding) AS d FROM files JOIN embeddings ON doc_id = vec_id) SELECT CAST(sum(2 * l + 8 * d + 200) AS BIGINT) AS memory_bytes, CAST(sum(2 * l + 4 * d + 264) AS BIGINT) AS table_bytes, CAST(sum(4 * d + 150) AS BIGINT) AS index_bytes FROM a"),
    "rate_limit": (rate_limit, "WITH a AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS in_window FROM events) SELECT event_id, in_window, in_window <= 30 AS allowed FROM a"),
    "usage_by_hour": (usage_by_hour, "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"),
    "view_files_by_language": (views, f"WITH {_C} SELECT language, count(DISTINCT path) AS file_count, count(*) AS chunk_count FROM c WHERE NOT gone GROUP BY language"),
    "view_providers": (view_providers, "SELECT event_type AS provider, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY event_type"),
    "recent_savings": (recent_savings, f"WITH {_S} SELECT id, original, optimized FROM s ORDER BY id DESC LIMIT 20"),
    "cache_oldest": (_cached("oldest", 6400, 86_400.0), None),
    "cache_recent": (_cached("recent", 12_800, 86_400.0), None),
    "cache_bounded": (_cached("bounded", 3200, None), None),
    "cache_totals": (cache_totals, "SELECT source, count(*) AS entries, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source"),
}
