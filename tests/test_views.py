"""Views, usage entries, index checks and vacuum."""

import datetime

from pyspark.sql import functions as F

from tessera.operators import analytics, integrity, scoring


def test_all_views(spark):
    day = datetime.datetime(2024, 1, 2)
    frame = spark.createDataFrame
    tables = {
        "chunks": frame([(1, "/a", "py", None), (2, "/a", "py", day), (3, "/b", "go", None)], "id long, path string, language string, deleted_at timestamp"),
        "files": frame([("/a", 2, 5, None), ("/b", 1, 6, None), ("/c", 9, 7, day)], "path string, chunk_count int, last_indexed int, deleted_at timestamp"),
        "users": frame([(1, day), (2, day - datetime.timedelta(days=9))], "user_id long, last_active timestamp"),
        "conversations": frame([(1, 7, day), (1, 8, day - datetime.timedelta(days=3))], "user_id long, conv_id long, created_at timestamp"),
        "documents": frame([(1,), (2,)], "doc_id long"), "document_chunks": frame([(5, 1), (6, 1)], "chunk_id long, doc_id long"), "cache_metadata": frame([("chunk:5",), ("chunk:5",)], "key string"),
        "embedding_cache": frame([(3, day), (1, day - datetime.timedelta(days=5))], "access_count long, created_at timestamp"),
    }
    made = analytics.register_views(spark, tables, F.lit(day))
    assert len(made) == 7 and "v_provider_stats" not in made
    rows = lambda q: sorted(map(tuple, spark.sql(q).collect()))
    assert rows("SELECT id FROM active_code_chunks") == [(1,), (3,)] and rows("SELECT path FROM active_indexed_files") == [("/a",), ("/b",)]
    assert rows("SELECT language, file_count, chunk_count FROM files_by_language") == [("go", 1, 1), ("py", 1, 1)]
    assert rows("SELECT total_files, total_chunk_refs, total_chunks FROM index_statistics") == [(2, 3, 2)]
    assert rows("SELECT user_id, conversation_count FROM active_users") == [(1, 1)]
    assert rows("SELECT doc_id, access_count FROM popular_documents") == [(1, 1), (2, 0)]
    assert rows("SELECT total_entries, total_accesses, entries_last_24h, entries_last_7d FROM v_cache_performance") == [(2, 4, 1, 2)]


def test_usage_index_and_vacuum(spark, tmp_path):
    day = datetime.datetime(2024, 1, 2)
    usage = spark.createDataFrame([("a", day, True)], "chunk_id string, ts timestamp, helpful boolean")
    more = scoring.add_usage(usage, spark.createDataFrame([("b", False)], "chunk_id string, helpful boolean"), F.lit(day + datetime.timedelta(days=1)))
    assert sorted(map(tuple, more.collect())) == [("a", day, True), ("b", day + datetime.timedelta(days=1), False)]
    meta = spark.createDataFrame([(day, 3)], "last_updated timestamp, files_indexed long")
    assert integrity.valid_index(meta).first().valid and not integrity.valid_index(meta.limit(0)).first().valid
    assert not integrity.valid_index(meta.withColumn("last_updated", F.lit(None).cast("timestamp"))).first().valid
    files = spark.createDataFrame([("/b", None), ("/a", None), ("/c", day)], "path string, deleted_at timestamp")
    integrity.vacuum(files, f"{tmp_path}/v", files=1)
    assert [r.path for r in spark.read.parquet(f"{tmp_path}/v").collect()] == ["/a", "/b"]
