"""The progress table against what the batches held."""

import datetime
import time

from pyspark.sql import functions as F

from tessera.streaming import caches, progress

START = datetime.datetime(2024, 1, 1)


def test_progress_and_hit_rate(spark, tmp_path):
    listener = progress.Progress(spark, total=40).start()
    try:
        for i in range(3):
            rows = [(START + datetime.timedelta(seconds=60 * i + j), f"k{j % 4}") for j in range(10)]
            spark.createDataFrame(rows, "ts timestamp, key string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            stream = spark.readStream.schema("ts timestamp, key string").parquet(f"{tmp_path}/in/*")
            seen = progress.observed(caches.cached(stream, "bounded", 8), chunks=F.lit(2), size=F.octet_length("key"), hit=F.col("hit"))
            q = seen.writeStream.queryName("work").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            assert q.awaitTermination(240) and q.exception() is None
        for _ in range(100):
            if sum(r[3] == 30 for r in listener.rows):
                break
            time.sleep(0.2)
    finally:
        listener.stop()
    rows = [r for r in listener.table().orderBy("batch").collect() if r.files]
    assert [r.files for r in rows][-1] == 30 and [r.chunks for r in rows][-1] == 60 and rows[-1].bytes == 60
    assert rows[-1].percent == 75.0 and rows[-1].hit_rate == 26 / 30 and rows[-1].query == "work"
    assert rows[-1].eta_ms > 0 and rows[-1].ms_per_chunk > 0
    s = listener.summary().first()
    assert (s.files, s.chunks, s.chunks_per_file) == (30, 60, 2.0) and s.files_per_second > 0
    assert progress.remaining_ms(1000, 10, 40) == 3000 and progress.remaining_ms(5, 0, 40) == progress.remaining_ms(5, 3, 0) == 0
