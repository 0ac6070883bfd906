"""Chunking and parsing.  All native chunkers are narrow: lines stay in arrays of their file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators import declarations

# Where a chunk begins, what names a symbol, what is a dependency line.
BOUNDARY = r"^(function|def|class|export\s+function|export\s+class|const\s+\w+\s*=\s*async|\w+\s*=\s*async)"
FUNCTION_NAME, CLASS_NAME = r"function\s+(\w+)", r"class\s+(\w+)"
CONST_NAME = r"(?:const|let)\s+(\w+)\s*=\s*(?:async\s+)?(?:\(|\([^)]*\)\s*=>)"
DEPENDENCY = r"^(import |use |require\()"
MAX_CHUNKS = 1000


def _lines(content: str) -> Column:
    return F.split(F.coalesce(F.col(content), F.lit("")), "\n")


def fixed_lines(files: DataFrame, size: int = 50, drop_blank: bool = True) -> DataFrame:
    """Windows of ``size`` lines; ids count the kept ones.  Files of more than 1,000 chunks raise."""
    lines = _lines("content")
    window = lambda k: F.struct((k * size + 1).alias("start_line"), F.least((k + 1) * size, F.size(lines)).alias("end_line"), F.array_join(F.slice(lines, k * size + 1, F.lit(size)), "\n").alias("content"))
    made = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lines) / size).cast("int") - 1), window)
    made = F.filter(made, lambda c: ~c["content"].rlike(r"^\s*$")) if drop_blank else made
    checked = F.when(F.size(made) > MAX_CHUNKS, F.raise_error(F.concat(F.lit("too many chunks in "), "path"))).otherwise(made)
    return files.select("path", "language", F.posexplode(checked).alias("idx", "c")).select(F.concat_ws(":", "path", "idx").alias("chunk_id"), "path", "language", "idx", "c.start_line", "c.end_line", "c.content")


def at_boundaries(files: DataFrame) -> DataFrame:
    """A new chunk at each line that begins a function or class."""
    lines = _lines("content")
    starts = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i > 0) & F.trim(F.get(lines, i)).rlike(BOUNDARY)))
    with_starts = files.select("path", "language", lines.alias("lines"), starts.alias("starts"))
    end = lambda i: F.coalesce(F.get("starts", i + 1), F.size("lines"))
    cut = F.transform("starts", lambda s, i: F.struct((s + 1).alias("start_line"), end(i).alias("end_line"), F.array_join(F.slice("lines", s + 1, end(i) - s), "\n").alias("content")))
    return with_starts.select("path", "language", F.posexplode(cut).alias("idx", "c")).select("path", "language", "idx", "c.*")


def packed_lines(files: DataFrame, target_tokens: int = 500) -> DataFrame:
    """Lines packed greedily: a piece closes before the line that would exceed the target."""
    cost = lambda line: F.ceil((F.length(line) + 1) / 4).cast("long")
    empty = F.expr("cast(array() as array<struct<first:int,last:int,tokens:bigint>>)")

    def step(acc: Column, x: Column) -> Column:
        full = (acc["tokens"] > 0) & (acc["tokens"] + x["cost"] > target_tokens)
        closed = F.concat(acc["out"], F.array(F.struct(acc["first"].alias("first"), (x["i"] - 1).alias("last"), acc["tokens"].alias("tokens"))))
        return F.struct(F.when(full, closed).otherwise(acc["out"]).alias("out"), F.when(full, x["i"]).otherwise(acc["first"]).alias("first"), F.when(full, x["cost"]).otherwise(acc["tokens"] + x["cost"]).alias("tokens"), x["i"].alias("at"))

    items = F.transform(_lines("content"), lambda line, i: F.struct(i.alias("i"), cost(line).alias("cost")))
    start = F.struct(empty.alias("out"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("tokens"), F.lit(-1).alias("at"))
    pieces = F.aggregate(items, start, step, lambda acc: F.concat(acc["out"], F.array(F.struct(acc["first"].alias("first"), acc["at"].alias("last"), acc["tokens"].alias("tokens")))))
    return files.select("path", F.posexplode(pieces).alias("idx", "p")).select("path", "idx", (F.col("p.first") + 1).alias("start_line"), (F.col("p.last") + 1).alias("end_line"), F.col("p.tokens").alias("tokens"))


def symbols(content: Column) -> Column:
    """Names of functions, classes and function constants, in this order."""
    return F.concat(*[F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(p), F.lit(1)) for p in (FUNCTION_NAME, CLASS_NAME, CONST_NAME)])


def dependencies(content: Column) -> Column:
    """Trimmed lines that import something."""
    return F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x.rlike(DEPENDENCY))


def _gaps(lines: Column, spans: Column, least_lines: int, most_lines: int, least_bytes: int) -> Column:
    """Pieces of the lines that no span (sorted, with start_line and end_line) covers."""
    gap = lambda acc, s: F.struct(F.greatest(acc["at"], s["end_line"] + 1).alias("at"), F.when(s["start_line"] > acc["at"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), (s["start_line"] - 1).alias("b"))))).otherwise(acc["out"]).alias("out"))
    closing = F.array(F.struct((F.size(lines) + 1).alias("start_line"), (F.size(lines) + 1).alias("end_line")))
    ends = F.transform(spans, lambda s: F.struct(s["start_line"].alias("start_line"), s["end_line"].alias("end_line")))
    gaps = F.aggregate(F.concat(ends, closing), F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("out")), gap, lambda acc: acc["out"])
    long = F.filter(gaps, lambda g: g["b"] - g["a"] + 1 >= least_lines)
    pieces = F.flatten(F.transform(long, lambda g: F.transform(F.sequence(g["a"], g["b"], F.lit(most_lines)), lambda at: F.struct(at.alias("start_line"), F.least(g["b"], at + most_lines - 1).alias("end_line")))))
    return F.filter(_sliced(lines, pieces), lambda p: F.octet_length(F.trim(p["content"])) >= least_bytes)


def _sliced(lines: Column, spans: Column) -> Column:
    """Spans with the text of their lines."""
    cut = lambda s: F.array_join(F.slice(lines, s["start_line"], s["end_line"] - s["start_line"] + 1), "\n")
    return F.transform(spans, lambda s: F.struct(s["start_line"].alias("start_line"), s["end_line"].alias("end_line"), cut(s).alias("content")))


def uncovered(files: DataFrame, spans: DataFrame, least_lines: int = 5, most_lines: int = 200, least_bytes: int = 50) -> DataFrame:
    """Runs of lines that no span (path, start_line, end_line) covers: gaps of sorted span ends."""
    by_file = spans.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line"))).alias("spans"))
    f = files.join(by_file, "path", "left").select("path", _lines("content").alias("lines"), F.coalesce("spans", F.expr("cast(array() as array<struct<start_line:int,end_line:int>>)")).alias("spans"))
    return f.select("path", F.explode(_gaps(F.col("lines"), F.col("spans"), least_lines, most_lines, least_bytes)).alias("g")).select("path", "g.*")


def name_and_kind(chunks: DataFrame) -> DataFrame:
    """First function's name, else first class's, else ``lines-a-b``; kind class, function or imports."""
    f, c = F.regexp_extract("content", FUNCTION_NAME, 1), F.regexp_extract("content", CLASS_NAME, 1)
    short = F.col("end_line") - F.col("start_line") + 1 < 20
    name = F.coalesce(F.nullif(f, F.lit("")), F.nullif(c, F.lit("")), F.concat_ws("-", F.lit("lines"), "start_line", "end_line"))
    kind = F.when(c != "", "class").when(f != "", "function").when((F.size(dependencies(F.col("content"))) > 0) & short, "imports").otherwise("function")
    return chunks.withColumn("name", name).withColumn("kind", kind)


# -- structure ---------------------------------------------------------------------------

_DECLARED = "array<struct<kind: string, name: string, signature: string, start_line: int, end_line: int, parent: string, error: string>>"


def parsed(files: DataFrame) -> DataFrame:
    """path, content, language and all that a file declares, as an array; narrow, one pass over each text."""
    names = ["kind", "name", "signature", "start_line", "end_line", "parent", "error"]
    kind = pa.list_(pa.struct([(n, pa.int32() if n.endswith("_line") else pa.string()) for n in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(names, d)) for d in declarations.declared(c, k)] for c, k in zip(b.column("content").to_pylist(), b.column("language").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "declared"])

    return files.select("path", "content", "language").mapInArrow(run, f"path string, content string, language string, declared {_DECLARED}")


def parse(files: DataFrame) -> DataFrame:
    """Functions, classes, imports and syntax errors of each file, a row each."""
    return parsed(files).select("path", F.explode("declared").alias("d")).select("path", "d.*")


def structural(files: DataFrame, look_back: int = 3, least_bytes: int = 50) -> DataFrame:
    """Chunks of classes, then of functions outside them with up to three comment or blank lines before, then of uncovered runs.

    Pieces of a run under ``least_bytes`` are left out, as in ``uncovered``; 0 keeps every line of a run.

    One narrow pass: a file is parsed once and stays one row until its chunks are made.
    """
    f = parsed(files).select("path", _lines("content").alias("lines"), F.filter("declared", lambda d: d["kind"].isin("class", "function")).alias("d"))
    f = f.withColumn("classes", F.filter("d", lambda d: (d["kind"] == "class") & d["parent"].isNull()))
    within = lambda d, c: (d["start_line"] >= c["start_line"]) & (d["end_line"] <= c["end_line"])
    f = f.withColumn("functions", F.filter("d", lambda d: (d["kind"] == "function") & ~F.exists("classes", lambda c: within(d, c))))
    plain = lambda i: F.coalesce(F.trim(F.get("lines", i)).rlike(r"^(//|/\*|\*|#|$)"), F.lit(False))

    def begin(d: Column) -> Column:
        """The first line of a function and of what stands right before it."""
        steps = [F.when((d["start_line"] > k) & plain(d["start_line"] - 1 - k), 1).otherwise(0) for k in range(1, look_back + 1)]
        reach = steps[0]
        for k in range(1, look_back):
            reach = reach + F.when(reach == k, steps[k]).otherwise(0)
        return d["start_line"] - reach

    span = lambda d, start: F.struct(start.alias("start_line"), d["end_line"].alias("end_line"), d["kind"].alias("kind"), d["name"].alias("name"))
    f = f.select("path", "lines", F.array_sort(F.concat(F.transform("classes", lambda d: span(d, d["start_line"])), F.transform("functions", lambda d: span(d, begin(d))))).alias("spans"))
    cut = lambda s: F.array_join(F.slice("lines", s["start_line"], s["end_line"] - s["start_line"] + 1), "\n")
    none = F.lit(None).cast("string")
    row = lambda s, kind, name, content: F.struct(kind.alias("kind"), name.alias("name"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line"), content.alias("content"))
    made = F.transform("spans", lambda s: row(s, s["kind"], s["name"], cut(s)))
    rest = F.transform(_gaps(F.col("lines"), F.col("spans"), 5, 200, least_bytes), lambda g: row(g, F.lit("block"), none, g["content"]))
    return f.select("path", F.explode(F.concat(made, rest)).alias("c")).select("path", "c.*")


def chunk(files: DataFrame, strategy: str = "hybrid") -> DataFrame:
    """``line`` fixed windows, ``structure`` declarations, ``hybrid`` declarations and, for files without any, windows."""
    if strategy == "line":
        return fixed_lines(files).select("path", "start_line", "end_line", "content")
    s = structural(files).select("path", "start_line", "end_line", "content")
    if strategy == "structure":
        return s
    return s.unionByName(fixed_lines(files.join(s.select("path").distinct(), "path", "left_anti")).select(s.columns))
