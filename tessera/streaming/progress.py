"""Progress and running metrics of streams, from what their batches observe; no second pass.

``observed`` names counts to take while rows pass by; a ``Progress`` listens to all queries of
a session and keeps a row for each batch: files, chunks, tokens and bytes so far, percent and
expected time to the end, running share of cache hits and mean time a chunk.
"""

from __future__ import annotations

from collections import deque
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "tessera_progress"
KEPT = 10_000
SCHEMA = "query string, batch long, at timestamp, files long, chunks long, tokens long, bytes long, percent double, eta_ms long, hit_rate double, ms_per_chunk double"
COUNTS = ("files", "chunks", "tokens", "bytes", "hits", "asked")


def observed(rows: DataFrame, files: Column | None = None, chunks: Column | None = None, tokens: Column | None = None, size: Column | None = None, hit: Column | None = None) -> DataFrame:
    """The rows, with sums taken as they pass: by default each row is a file of one chunk."""
    one = F.lit(1)
    sums = {"files": one if files is None else files, "chunks": one if chunks is None else chunks, "tokens": tokens, "bytes": size, "hits": None if hit is None else hit.cast("long"), "asked": None if hit is None else one}
    total = lambda c: F.lit(0).cast("long") if c is None else F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.observe(NAME, *(total(c).alias(n) for n, c in sums.items()))


def remaining_ms(elapsed_ms: float, done: int, total: int) -> int:
    """Expected time for what is left at the mean pace so far; 0 where nothing is known."""
    return 0 if not done or not total else round(max(0, total - done) * elapsed_ms / done)


class Progress(StreamingQueryListener):
    """Keeps the newest ``KEPT`` batches; ``total`` is the number of files expected, if known."""

    def __init__(self, spark: SparkSession, total: int = 0):
        self.spark, self.total, self.rows, self.sums, self.spent = spark, total, deque(maxlen=KEPT), {}, {}

    def start(self) -> Progress:
        self.spark.streams.addListener(self)
        return self

    def stop(self) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        self.sums.setdefault(str(event.id), dict.fromkeys(COUNTS, 0))
        self.spent.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = (p.observedMetrics or {}).get(NAME)
        if seen is None:
            return
        key = str(p.id)
        so_far = self.sums.setdefault(key, dict.fromkeys(COUNTS, 0))
        for n in COUNTS:
            so_far[n] += seen[n]
        self.spent[key] = self.spent.get(key, 0) + int(p.batchDuration or 0)
        done, spent = so_far["files"], self.spent[key]
        percent = min(100.0, 100.0 * done / self.total) if self.total else 0.0
        at = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        rate = so_far["hits"] / so_far["asked"] if so_far["asked"] else 0.0
        self.rows.append((p.name or key, int(p.batchId), at, *(so_far[n] for n in COUNTS[:4]), percent, remaining_ms(spent, done, self.total), rate, spent / so_far["chunks"] if so_far["chunks"] else 0.0))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self) -> DataFrame:
        """A row for each batch seen."""
        return self.spark.createDataFrame(list(self.rows), SCHEMA)

    def summary(self) -> DataFrame:
        """query, files, chunks, chunks a file and files a second at the last batch of each query."""
        last = self.table().groupBy("query").agg(F.max_by(F.struct("files", "chunks", "tokens", "bytes", "ms_per_chunk"), "batch").alias("l")).select("query", "l.*")
        return last.select("query", "files", "chunks", "tokens", "bytes", F.try_divide("chunks", "files").alias("chunks_per_file"), F.try_divide(F.col("files") * 1000, F.col("ms_per_chunk") * F.col("chunks")).alias("files_per_second"))
