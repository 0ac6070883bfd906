"""Chunkers as table functions for SQL: ``SELECT * FROM chunk_lines(TABLE(files) PARTITION BY path, size => 50)``.

Each takes rows of (path, content) and, for declarations, language; what it adds is told by
``analyze`` from its arguments, so a wrong argument is an error of the query, not of a task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessera.operators import chunking, declarations


def _checked(table: AnalyzeArgument, needs: tuple[str, ...]) -> None:
    if not table.isTable:
        raise Exception("the first argument is a table: TABLE(...)")  # noqa: TRY002 - shown as the query's error
    if lacking := [n for n in needs if n not in table.dataType.fieldNames()]:
        raise Exception(f"the table has no column {', '.join(lacking)}")  # noqa: TRY002


def _positive(size: AnalyzeArgument | None, name: str) -> None:
    if size is not None and (size.value is None or int(size.value) < 1):
        raise Exception(f"{name} is a constant of 1 or more")  # noqa: TRY002


def _spans() -> StructType:
    return StructType().add("path", StringType()).add("idx", IntegerType()).add("start_line", IntegerType()).add("end_line", IntegerType()).add("content", StringType())


class ChunkLines:
    """Windows of ``size`` lines; blank ones are left out and not counted."""

    @staticmethod
    def analyze(files: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
        _checked(files, ("path", "content"))
        _positive(size, "size")
        return AnalyzeResult(_spans())

    def eval(self, files: Row, size: int = 50) -> Iterator[tuple]:
        lines, idx = (files["content"] or "").split("\n"), 0
        for at in range(0, len(lines), size):
            text = "\n".join(lines[at : at + size])
            if text.strip(" \t\n\x0b\f\r"):
                yield files["path"], idx, at + 1, min(at + size, len(lines)), text
                idx += 1


class ChunkTokens:
    """Lines packed greedily to ``target`` estimated tokens."""

    @staticmethod
    def analyze(files: AnalyzeArgument, target: AnalyzeArgument | None = None) -> AnalyzeResult:
        _checked(files, ("path", "content"))
        _positive(target, "target")
        return AnalyzeResult(StructType().add("path", StringType()).add("idx", IntegerType()).add("start_line", IntegerType()).add("end_line", IntegerType()).add("tokens", LongType()))

    def eval(self, files: Row, target: int = 500) -> Iterator[tuple]:
        idx, first, tokens, at = 0, 0, 0, 0
        for at, line in enumerate((files["content"] or "").split("\n")):
            cost = math.ceil((len(line) + 1) / 4)
            if tokens and tokens + cost > target:
                yield files["path"], idx, first + 1, at, tokens
                idx, first, tokens = idx + 1, at, 0
            tokens += cost
        yield files["path"], idx, first + 1, at + 1, tokens


class ChunkBoundaries:
    """A new chunk at each line that begins a function or class."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        _checked(files, ("path", "content"))
        return AnalyzeResult(_spans())

    def eval(self, files: Row) -> Iterator[tuple]:
        lines = (files["content"] or "").split("\n")
        starts = [0, *(i for i, x in enumerate(lines) if i and re.search(chunking.BOUNDARY, x.strip(" "), re.ASCII))]
        for idx, (a, b) in enumerate(zip(starts, [*starts[1:], len(lines)])):
            yield files["path"], idx, a + 1, b, "\n".join(lines[a:b])


class Declarations:
    """Functions, classes, imports and errors."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        _checked(files, ("path", "content", "language"))
        s = StructType().add("path", StringType()).add("kind", StringType()).add("name", StringType()).add("signature", StringType())
        return AnalyzeResult(s.add("start_line", IntegerType()).add("end_line", IntegerType()).add("parent", StringType()).add("error", StringType()))

    def eval(self, files: Row) -> Iterator[tuple]:
        for d in declarations.declared(files["content"], files["language"]):
            yield files["path"], *d


FUNCTIONS = {"chunk_lines": ChunkLines, "chunk_tokens": ChunkTokens, "chunk_boundaries": ChunkBoundaries, "declarations": Declarations}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, udtf(f))
