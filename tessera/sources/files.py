"""File sources and sinks: walks, payloads, JSON streams, exports, backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessera.functions import paths

# Extensions taken from a source tree.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "py", "rs", "go", "java", "cpp", "c", "h")
PAYLOAD = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("language", T.StringType())])
MAX_FILES, MAX_BYTES = 100, 10 * 1024 * 1024


def walk(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True, max_size: int | None = None, include: list[str] | None = None, exclude: list[str] | None = None, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """path, size, mtime, extension, content (binary) of files below a folder.

    Only listing options reach the source; size and name filters are pushed to it as
    predicates, so contents of other files are not read.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(root)
    df = df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), paths.extension(F.col("path")).alias("extension"), "content")
    df = df.filter(~paths.is_skipped(F.substring_index("path", root.rstrip("/"), -1)))
    if max_size is not None:
        df = df.filter(F.col("size") <= max_size)
    if extensions:
        df = df.filter(F.col("extension").isin(*extensions))
    if include or exclude:
        df = df.filter(paths.matches_patterns(F.col("path"), include or [], exclude or []))
    return df


def as_text(df: DataFrame) -> DataFrame:
    """Contents decoded, with language and checksum."""
    return df.select("path", F.decode("content", "UTF-8").alias("content"), paths.language(F.col("path")).alias("language"), "size", "mtime", F.sha2("content", 256).alias("checksum"))


def apply_ignore_rules(df: DataFrame, rules: list[str]) -> DataFrame:
    """Drop what ignore rules name: blank lines and # lines say nothing, a trailing / is a folder."""
    for rule in (r.strip() for r in rules):
        if rule and not rule.startswith("#"):
            rx = paths.glob_regex(rule.strip("/"))
            df = df.filter(~F.col("path").rlike(f"(^|/){rx}(/|$)"))
    return df


def payload(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """An indexing request: at most ``MAX_FILES`` files."""
    if len(rows) > MAX_FILES:
        raise ValueError(f"more than {MAX_FILES} files in one request")
    return spark.createDataFrame(rows, PAYLOAD)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a safe path and content of up to 10 MB, and the others with their reason."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    reason = F.when(~F.coalesce(paths.is_safe(F.col("path")), F.lit(False)), "invalid path").when(size == 0, "empty content").when(size > MAX_BYTES, "content too large")
    judged = df.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """Objects or arrays of JSON files, plain or compressed."""
    r = spark.read.option("multiLine", str(multi_line).lower())
    return (r.schema(schema) if schema else r).json(path)


def entries(df: DataFrame, column: str) -> DataFrame:
    """A map column to one row a key."""
    return df.select(F.explode(column).alias("key", "value"))


def write_json(df: DataFrame, path: str, compress: bool = True) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if compress else "none").json(path)


def process_json(spark: SparkSession, source: str, target: str, schema: str, keep: Column, make: list[Column]) -> int:
    """Filter, map and write; gives how many rows were written, counted on the way."""
    from pyspark.sql import Observation

    seen = Observation("written")
    df = spark.read.schema(schema).json(source).filter(keep).select(*make)
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(target)
    return seen.get["n"]


def export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").format(kind).save(path)


def load_export(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.format(kind)
    return (r.schema(schema) if schema else r).load(path)


def backup(df: DataFrame, root: str, version: str) -> str:
    """A copy in a folder of its own; an existing version is an error."""
    path = f"{root.rstrip('/')}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def restore(spark: SparkSession, root: str, version: str, current: DataFrame | None = None, safety: str | None = None) -> DataFrame:
    """A version's rows; the current rows are backed up first where a safety version is named."""
    if current is not None and safety:
        backup(current, root, safety)
    return spark.read.parquet(f"{root.rstrip('/')}/v={version}")


def newest(df: DataFrame, ts: str = "ts", n: int = 100) -> DataFrame:
    """The last ``n`` rows by time."""
    return df.orderBy(F.desc(ts)).limit(n)


def unexpired(df: DataFrame, now: Column, ttl_seconds: int = 86_400, ts: str = "stored_at") -> DataFrame:
    """Entries of a store whose time to live has not passed."""
    return df.filter(F.unix_micros(now) - F.unix_micros(F.col(ts)) < ttl_seconds * 1_000_000)
