"""Files of JSON values one after the other, read in byte ranges and written with one commit.

Where an object begins cannot be told from a byte range alone: it may start inside a string.
So ranges are first summed up, each by itself, for the three states a range can start in
(outside a string, inside, behind a backslash): the state at its end and the change of depth.
Chaining these few numbers a range gives every range's true start, and then each is read by
itself: it gives the values that open in it, reading on beyond its end to close the last.

``level`` 0 gives whole values; 1 gives what lies in arrays at the top, for files that are one
array.  Objects and arrays are values, bare numbers and strings are passed over.  A value that
does not end, and a bracket that closes nothing or the wrong one, come as rows with an error.
The texts are parsed by the engine's own ``from_json``.

A task reads many ranges, about ``RANGE`` bytes, and is sent those alone.

Paths are those of a file system that is mounted on all nodes.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

RANGE = 64 << 20
MORE = 1 << 16
SCHEMA = "path string, offset long, value string, error string"
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_STRING = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+(?P<end>"|\\?\Z)', re.S)
_REST = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+(?P<end>"|\\?\Z)', re.S)
_TOKEN = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+(?P<end>"|\\?\Z)|[{}\[\]]', re.S)
_PAIRS = {b"}": b"{", b"]": b"["}


def local(path: str) -> str:
    return path.removeprefix("file://")


def _left(text: bytes) -> int:
    """The state behind a string's text that reaches the end."""
    return ESCAPED if (len(text) - len(text.rstrip(b"\\"))) % 2 else INSIDE


def summed(data: bytes, state: int) -> tuple[int, int]:
    """State and depth behind some bytes, from a state before them."""
    end = OUTSIDE
    if not data:
        return state, 0
    if state == ESCAPED:
        data, state = data[1:], INSIDE
    if state == INSIDE:
        m = _REST.match(data)
        if m["end"] != b'"':
            return _left(data), 0
        data = data[m.end() :]

    def drop(m: re.Match) -> bytes:
        nonlocal end
        if m["end"] != b'"':
            end = _left(m[0][1:])
        return b""

    bare = _STRING.sub(drop, data)
    return end, sum(bare.count(x) for x in (b"{", b"[")) - sum(bare.count(x) for x in (b"}", b"]"))


def values(path: str, start: int, stop: int, state: int, depth: int, level: int) -> Iterator[tuple[str, int, str | None, str | None]]:
    """Rows of the values that open in a range."""
    with open(local(path), "rb") as f:
        f.seek(start)
        data, ended = f.read(stop - start), False
        size, at, begun, step = stop - start, 0, -1, MORE
        if state == ESCAPED:
            at = 1
        if state != OUTSIDE:
            at = _REST.match(data, at).end()
        open_: list[bytes] = []
        while True:
            m = _TOKEN.search(data, at)
            cut = m is not None and m["end"] is not None and m["end"] != b'"'
            if (m is None or cut) and begun >= 0 and not ended:
                more = f.read(step)
                ended, step = not more, step * 2
                at = m.start() if cut else len(data)
                data += more
                continue
            if m is None or (m.start() >= size and begun < 0):
                break
            at, sign = m.end(), m[0]
            if m["end"] is not None:
                continue
            if sign in b"{[":
                if depth == level and begun < 0:
                    begun = m.start()
                if begun >= 0:
                    open_.append(sign)
                depth += 1
            elif begun >= 0:
                if open_[-1] != _PAIRS[sign]:
                    yield path, start + begun, None, f"{sign.decode()} at {start + m.start()} closes {open_[-1].decode()}"
                    return
                open_.pop()
                depth -= 1
                if not open_:
                    yield path, start + begun, data[begun:at].decode("utf-8", "replace"), None
                    begun = -1
            else:
                depth -= 1
                if depth < 0:
                    yield path, start + m.start(), None, f"{sign.decode()} closes nothing"
                    return
        if begun >= 0:
            yield path, start + begun, None, "does not end"


def plan(spark: SparkSession, paths: Sequence[str], size: int = RANGE) -> list[tuple[str, int, int, int, int]]:
    """(path, start, stop, state, depth) of each range: a few numbers for each ``size`` bytes."""
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                n = os.path.getsize(local(p))
                starts = range(0, max(n, 1), size)
                yield pd.DataFrame({"path": p, "start": list(starts), "stop": [min(a + size, n) for a in starts]})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, a, z in zip(*(c.to_pylist() for c in b.columns)):
                with open(local(p), "rb") as f:
                    f.seek(a)
                    data = f.read(z - a)
                found = [summed(data, s) for s in (OUTSIDE, INSIDE, ESCAPED)]
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([a]), pa.array([z]), pa.array([[x[0] for x in found]], pa.list_(pa.int32())), pa.array([[x[1] for x in found]], pa.list_(pa.int64()))], names=["path", "start", "stop", "states", "depths"])

    def chained(ranges: pd.DataFrame) -> pd.DataFrame:
        state, depth, out = OUTSIDE, 0, []
        for r in ranges.sort_values("start").itertuples():
            out.append((r.path, r.start, r.stop, state, depth))
            state, depth = int(r.states[state]), depth + int(r.depths[state])
        return pd.DataFrame(out, columns=["path", "start", "stop", "state", "depth"])

    ranges = files.mapInPandas(cut, "path string, start long, stop long").repartition("path", "start")
    found = ranges.mapInArrow(sums, "path string, start long, stop long, states array<int>, depths array<long>")
    return [tuple(r) for r in found.groupBy("path").applyInPandas(chained, "path string, start long, stop long, state int, depth long").orderBy("path", "start").collect()]


def tasks(ranges: Sequence[Sequence], count: int) -> list[tuple]:
    """Neighbouring ranges put together to at most ``count`` tasks of about as many bytes."""
    total = sum(stop - start for _, start, stop, _, _ in ranges)
    out: dict[int, list[tuple]] = {}
    done = 0
    for r in ranges:
        out.setdefault(done * count // max(1, total), []).append(tuple(r))
        done += r[2] - r[1]
    return [tuple(x) for x in out.values()]


class _Ranges(InputPartition):
    """Some ranges, one after the other."""


class _Reader(DataSourceReader):
    def __init__(self, ranges: list, level: int, count: int):
        self.ranges, self.level, self.count = ranges, level, count

    def partitions(self) -> Sequence[InputPartition]:
        return [_Ranges(t) for t in tasks(self.ranges, self.count)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for r in partition.value:
            yield from values(*r, self.level)

    def __getstate__(self) -> dict:
        """What goes to every task, which has its own ranges: all of them would be the square of the input."""
        return self.__dict__ | {"ranges": []}


class _Written(WriterCommitMessage):
    def __init__(self, file: str | None):
        self.file = file


class _Writer(DataSourceWriter):
    """Tasks write below a folder of the job's own; the commit moves all files, then marks success."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    @property
    def own(self) -> str:
        return os.path.join(self.path, f"_temporary-{self.job}")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        name = None
        for row in iterator:
            if name is None:
                name = os.path.join(self.own, f"part-{uuid.uuid4().hex}.json")
                f = open(name, "w", encoding="utf-8")  # noqa: SIM115 - closed below
            if row["value"] is not None:
                f.write(row["value"] + "\n")
        if name is not None:
            f.close()
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for x in os.scandir(self.path):
                if x.name.startswith(("part-", "_SUCCESS")):
                    os.remove(x.path)
        for m in messages:
            if m is not None and m.file:
                os.replace(m.file, os.path.join(self.path, os.path.basename(m.file)))
        shutil.rmtree(self.own, ignore_errors=True)
        with open(os.path.join(self.path, "_SUCCESS"), "w"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        # Tasks may still run: once the folder has another name, they can open no file in it.
        gone = os.path.join(self.path, f"_aborted-{self.job}")
        os.rename(self.own, gone)
        shutil.rmtree(gone, ignore_errors=True)


class JsonStream(DataSource):
    """``json_stream``: reads with the options ``ranges``, ``level`` and ``tasks``, writes rows of ``value``."""

    @classmethod
    def name(cls) -> str:
        return "json_stream"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(json.loads(self.options["ranges"]), int(self.options.get("level", "0")), int(self.options.get("tasks", "1")))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if "value" not in schema.fieldNames():
            raise ValueError("a column named value is written")
        w = _Writer(local(self.options["path"]), overwrite)
        os.makedirs(w.own)
        return w


def read(spark: SparkSession, path: str, size: int = RANGE, level: int = 0) -> DataFrame:
    """path, offset, value, error of all values in a file or in a folder's files."""
    spark.dataSource.register(JsonStream)
    at = local(path)
    found = sorted(os.path.join(at, x) for x in os.listdir(at) if not x.startswith(("_", "."))) if os.path.isdir(at) else [at]
    ranges = plan(spark, found, size) if found else []
    count = max(spark.sparkContext.defaultParallelism, -(-sum(stop - start for _, start, stop, _, _ in ranges) // RANGE))
    return spark.read.format("json_stream").option("ranges", json.dumps(ranges)).option("level", str(level)).option("tasks", str(count)).load()


def write(values_: DataFrame, path: str, mode: str = "append") -> None:
    """The texts of ``value``, one after the other."""
    values_.sparkSession.dataSource.register(JsonStream)
    values_.select("value").write.format("json_stream").mode(mode).option("path", path).save()
