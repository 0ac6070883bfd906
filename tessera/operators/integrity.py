"""Integrity checks, keyed merges, structural diffs and clean-up."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def issues(files: DataFrame, chunks: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """check, path, detail: missing fields, wrong chunk counts, orphans, duplicates, totals."""
    counts = chunks.groupBy("path").agg(F.count("*").alias("n"))
    row = lambda check, detail: (F.lit(check).alias("check"), "path", detail.cast("string").alias("detail"))
    out = files.filter("path is null or checksum is null or size < 0").select(*row("missing_field", F.lit("path, checksum or size")))
    out = out.unionByName(files.join(counts, "path", "left").filter(F.coalesce("n", F.lit(0)) != F.col("chunk_count")).select(*row("chunk_count", F.coalesce("n", F.lit(0)))))
    out = out.unionByName(counts.join(files.select("path"), "path", "left_anti").select(*row("orphan", F.col("n"))))
    same = files.groupBy("checksum").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n > 1")
    out = out.unionByName(same.select(*row("duplicate", F.col("n"))))
    if declared is not None:  # one row: total_files, total_size; sizes may differ by 1 KB
        real = files.agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).crossJoin(F.broadcast(declared))
        wrong = real.filter((F.col("files") != F.col("total_files")) | (F.abs(F.col("bytes") - F.col("total_size")) > 1024))
        out = out.unionByName(wrong.select(F.lit("totals").alias("check"), F.lit(None).cast("string").alias("path"), F.concat_ws("/", "files", "bytes").alias("detail")))
    return out


def verify(index: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed files that are missing or differ."""
    f = files.select("path", F.col("checksum").alias("found"))
    return index.join(f, "path", "left").withColumn("status", F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("checksum"), "corrupt").otherwise("ok")).select("path", "status")


def merge(parts: list[DataFrame], key: str, strategy: str = "replace") -> tuple[DataFrame, DataFrame]:
    """Keyed merge of tables (columns key, value): ``replace`` last wins, ``merge`` first non-null, ``concat`` all.

    Gives the merged rows and one row with merged and conflicts.
    """
    both = None
    for i, p in enumerate(parts):
        q = p.select(key, "value").withColumn("_i", F.lit(i))
        both = q if both is None else both.unionByName(q)
    how = {
        "replace": F.max_by("value", "_i"),
        "merge": F.min_by("value", F.when(F.col("value").isNotNull(), F.col("_i"))),
        "concat": F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "value"))), lambda e: e["value"]), ","),
    }[strategy]
    merged = both.groupBy(key).agg(how.alias("value"))
    return merged, both.agg(F.count_distinct(key).alias("merged"), (F.count("*") - F.count_distinct(key)).alias("conflicts"))


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change (added, removed, modified) and both values."""
    o, n = old.select(key, F.col(value).alias("before"), F.lit(True).alias("_o")), new.select(key, F.col(value).alias("after"), F.lit(True).alias("_n"))
    j = o.join(n, key, "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    return j.withColumn("change", change).filter("change is not null").select(key, "change", "before", "after")


def flatten_json(df: DataFrame, column: str, key: str) -> DataFrame:
    """key, path, value: each leaf of a JSON text under its dotted path; a broken text is one row without path."""

    def leaves(x, at: str) -> Iterator[tuple[str, str]]:
        if isinstance(x, (dict, list)) and x:
            for k, v in x.items() if isinstance(x, dict) else enumerate(x):
                yield from leaves(v, f"{at}[{k}]" if isinstance(x, list) else f"{at}.{k}" if at else str(k))
        else:
            yield at, json.dumps(x, ensure_ascii=False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[column]):
                try:
                    rows += [(k, p, v) for p, v in leaves(json.loads(t or ""), "")]
                except ValueError:
                    rows.append((k, None, t))
            yield pd.DataFrame(rows, columns=[key, "path", "value"])

    return df.select(key, column).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, path string, value string")


def diff_json(old: DataFrame, new: DataFrame, column: str, key: str) -> DataFrame:
    """key, path, change and both values of the leaves that two versions of JSON texts differ in."""
    at = lambda df: flatten_json(df, column, key).withColumn("_at", F.struct(key, "path"))
    return diff(at(old), at(new), "_at", "value").select(f"_at.{key}", "_at.path", "change", "before", "after")


def json_shape(text: str | None) -> tuple[bool, int, int, int, int, int, int, str | None]:
    """valid, depth, objects, arrays, strings, numbers, keys, error."""
    try:
        root = json.loads(text or "")
    except ValueError as e:
        return False, 0, 0, 0, 0, 0, 0, str(e)
    depth = objects = arrays = strings = numbers = keys = 0
    todo = [(root, 1)]
    while todo:
        x, d = todo.pop()
        depth = max(depth, d)
        if isinstance(x, dict):
            objects, keys = objects + 1, keys + len(x)
            todo += [(v, d + 1) for v in x.values()]
        elif isinstance(x, list):
            arrays += 1
            todo += [(v, d + 1) for v in x]
        elif isinstance(x, str):
            strings += 1
        elif isinstance(x, (int, float)) and not isinstance(x, bool):
            numbers += 1
    return True, depth, objects, arrays, strings, numbers, keys, None


def json_structure(df: DataFrame, column: str, key: str) -> DataFrame:
    """Shape of a JSON text column."""
    names = ["valid", "depth", "objects", "arrays", "strings", "numbers", "keys", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[[key]].reset_index(drop=True), pd.DataFrame([json_shape(t) for t in b[column]], columns=names)], axis=1)

    return df.select(key, column).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, valid boolean, depth long, objects long, arrays long, strings long, numbers long, keys long, error string")


def clean_up(files: DataFrame, referenced: DataFrame, backups: DataFrame, now: Column, most_bytes: int, keep_days: int) -> DataFrame:
    """path, reason, bytes of what may go: orphans, oversized files, old backups."""
    old = backups.filter(F.col("created_at") < now - F.expr(f"interval {keep_days} days")).select("path", F.lit("old_backup").alias("reason"), F.col("size").alias("bytes"))
    orphan = files.join(referenced.select("path").distinct(), "path", "left_anti").select("path", F.lit("orphan").alias("reason"), F.col("size").alias("bytes"))
    large = files.filter(F.col("size") > most_bytes).select("path", F.lit("oversized").alias("reason"), F.col("size").alias("bytes"))
    return orphan.unionByName(large).unionByName(old)


def add_favorite(favorites: DataFrame, entry: DataFrame) -> DataFrame:
    """Favourites with an entry that is not there yet (by query and filters)."""
    new = entry.join(favorites, (entry.query == favorites.query) & entry.filters.eqNullSafe(favorites.filters), "left_anti")
    return favorites.unionByName(new.select(favorites.columns))


def remove_favorite(favorites: DataFrame, query: str) -> DataFrame:
    return favorites.filter(F.col("query") != query)


def valid_index(metadata: DataFrame) -> DataFrame:
    """One row, valid: whether there is metadata and all of it says when it was updated and how many files it has."""
    sound = F.col("last_updated").isNotNull() & F.col("files_indexed").isNotNull()
    return metadata.agg(F.coalesce(F.every(sound), F.lit(False)).alias("valid"))


def vacuum(stored: DataFrame, path: str, key: str = "path", files: int | None = None) -> None:
    """Write the live rows of a table to a new folder, sorted by key, in few files; the old one stays until it is dropped."""
    live = stored.filter("deleted_at IS NULL") if "deleted_at" in stored.columns else stored
    (live.repartitionByRange(files, key) if files else live.repartitionByRange(key)).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)
