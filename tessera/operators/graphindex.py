"""A layered small-world graph index: one graph a shard, stored as rows, searched by beams.

Rows are dealt to shards by a hash of their id; a shard's vectors fit ``SHARD_BYTES``, so the
number of shards follows the data and no task holds more than one.  A shard's graph has
layers: a node is on layer l with a chance of m to the power -l, drawn from its id.  On each
layer a node is linked to ``m`` of its nearest nodes (found by blocks of matrix products over
the shard, ``ef_construction`` looked at), those first that are nearer to it than to one
already linked; links go both ways, twice as many on the lowest layer, where a ring keeps
every node within reach.  A search walks down the layers with a beam of ``ef`` nodes, many
queries in step, and the answers of all shards are merged.

Similarity is the cosine; that with a zero vector is 0.  Removed rows are marked and walked
through, but never returned; ``compact`` builds shards with many of them anew.  Added rows
form new shards.  A vector of another length, a missing one, or an id that is there already
raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SHARD_BYTES = 4 << 20
SHARDS_SCHEMA = "shard int, node int, id long, vector array<float>, level int, links array<array<int>>, dead boolean"
#: Cells of the table of nodes that the queries of a batch have seen.
_SEEN = 1 << 23
#: Queries that are checked against a whole shard at a time, and how much products of unit vectors may be off.
_CHECKED, _OFF = 64, 1e-9


@dataclass(frozen=True)
class Preset:
    m: int
    ef_construction: int
    ef_search: int


# Links, candidates when building, beam when searching.
PRESETS = {"fast": Preset(12, 100, 30), "default": Preset(16, 200, 50), "accurate": Preset(32, 400, 100)}


# -- one shard -------------------------------------------------------------------------


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, summed one component after the other; 0 with a zero vector."""
    dot, x, y = (np.zeros(len(a)) for _ in range(3))
    for p, q in zip(np.ascontiguousarray(a.T, dtype=np.float64), np.ascontiguousarray(b.T, dtype=np.float64)):
        dot += p * q
        x += p * p
        y += q * q
    length = np.sqrt(x * y)
    return np.clip(np.divide(dot, length, out=np.zeros_like(dot), where=length > 0), -1.0, 1.0)


def levels(ids: np.ndarray, m: int) -> np.ndarray:
    """Layers drawn from ids: a fraction 1/m of the nodes of each layer is on the next."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    share = ((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.minimum(np.floor(-np.log(np.maximum(share, 1e-300)) / np.log(m)), 12).astype(np.int32)


def _chosen(near: np.ndarray, score: np.ndarray, v: np.ndarray, m: int) -> np.ndarray:
    """Which of each node's candidates (nearest first) it is linked to."""
    among = np.einsum("bcd,bed->bce", v[near], v[near])
    closest = np.full(near.shape, -np.inf, dtype=among.dtype)
    keep = np.zeros(near.shape, dtype=bool)
    for j in range(near.shape[1]):
        ok = (closest[:, j] < score[:, j]) & (keep.sum(axis=1) < m)
        keep[:, j] = ok
        closest[ok] = np.maximum(closest[ok], among[ok, j])
    spare = (~keep).cumsum(axis=1) <= (m - keep.sum(axis=1))[:, None]
    return keep | (~keep & spare)


def linked(v: np.ndarray, nodes: np.ndarray, m: int, looked_at: int, most: int, ring: bool) -> list[np.ndarray]:
    """Links of ``nodes`` (rows of ``v``, unit vectors) among themselves, at most ``most`` each, and the ring."""
    n, w = len(nodes), v[nodes]
    if n == 1:
        return [np.empty(0, dtype=np.int64)]
    c = min(n - 1, looked_at, 4 * m)
    source, target, score = [], [], []
    for at in range(0, n, 256):
        s = w[at : at + 256] @ w.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        near = np.argpartition(-s, c - 1, axis=1)[:, :c]
        order = np.argsort(-np.take_along_axis(s, near, axis=1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        near_score = np.take_along_axis(s, near, axis=1)
        row, col = np.nonzero(_chosen(near, near_score, w, m))
        source.append(row + at)
        target.append(near[row, col])
        score.append(near_score[row, col])
    a, b, s = np.concatenate(source), np.concatenate(target), np.concatenate(score)
    a, b, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
    _, first = np.unique(a * n + b, return_index=True)
    a, b, s = a[first], b[first], s[first]
    order = np.lexsort((b, -s, a))
    a, b = a[order], b[order]
    begin = np.searchsorted(a, np.arange(n))
    keep = np.arange(len(a)) - begin[a] < most
    a, b = a[keep], b[keep]
    if ring:
        a, b = np.divmod(np.unique(np.append(a * n + b, np.arange(n) * n + (np.arange(n) + 1) % n)), n)
    return [nodes[x] for x in np.split(b, np.searchsorted(a, np.arange(1, n)))]


class Shard:
    """Vectors and links of one shard, in node order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, level: np.ndarray, links: list[list[np.ndarray]], dead: np.ndarray):
        self.ids, self.dead = ids, dead
        self.vectors, self.v = vectors, unit(vectors.astype(np.float64))
        self.entry = int(level.argmax())
        self.layers = []
        for at in range(int(level.max()) + 1):
            own = [x[at] if at < len(x) else () for x in links]
            size = np.array([len(x) for x in own])
            table = np.full((len(own), max(1, size.max())), -1, dtype=np.int64)
            table[np.arange(table.shape[1]) < size[:, None]] = np.concatenate([np.asarray(x, dtype=np.int64) for x in own])
            self.layers.append(table)

    @staticmethod
    def built(ids: np.ndarray, vectors: np.ndarray, preset: Preset) -> tuple[np.ndarray, list[list[list[int]]]]:
        level, v = levels(ids, preset.m), unit(vectors.astype(np.float64))
        links: list[list[list[int]]] = [[] for _ in ids]
        for at in range(int(level.max()) + 1):
            nodes = np.flatnonzero(level >= at)
            for i, x in zip(nodes.tolist(), linked(v, nodes, preset.m, preset.ef_construction, preset.m * (1 + (at == 0)), at == 0)):
                links[i].append(x.tolist())
        return level, links

    def search(self, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (-1: none) and cosines of the best ``k`` live nodes found for each query."""
        q = unit(queries.astype(np.float64))
        ef = max(ef, k)
        nodes = np.full((len(q), 1), self.entry)
        for table in reversed(self.layers):
            nodes, scores = self._layer(table, q, nodes, ef if table is self.layers[0] else min(ef, 8))
        scores[(nodes < 0) | self.dead[nodes]] = -np.inf
        order = np.lexsort((self.ids[nodes], -scores), axis=1)[:, :k]
        nodes, scores = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(scores, order, axis=1)
        return np.where(np.isfinite(scores), nodes, -1), scores

    def checked(self, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` without fail: what the beam found is a floor, and every live row that reaches it is scored."""
        q, (_, found) = unit(queries.astype(np.float64)), self.search(queries, k, ef)
        floor = found[:, k - 1] if found.shape[1] == k else np.full(len(q), -np.inf)
        nodes, scores = np.full((len(q), k), -1), np.full((len(q), k), -np.inf)
        for at in range(0, len(q), _CHECKED):
            row, node = np.nonzero((q[at : at + _CHECKED] @ self.v.T >= floor[at : at + _CHECKED, None] - _OFF) & ~self.dead)
            score = cosines(queries[at + row], self.vectors[node])
            order = np.lexsort((self.ids[node], -score, row))
            row, node, score = row[order], node[order], score[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            best = nth < k
            nodes[at + row[best], nth[best]], scores[at + row[best], nth[best]] = node[best], score[best]
        return nodes, scores

    def _layer(self, table: np.ndarray, q: np.ndarray, begin: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((n, len(self.ids) + 1), dtype=bool)
        seen[rows, begin] = True
        seen[:, -1] = True
        pool = begin
        score = np.where(begin < 0, -np.inf, np.einsum("qd,qed->qe", q, self.v[begin]))
        open_ = np.isfinite(score)
        live = np.arange(n)
        while len(live):
            best = np.where(open_[live], score[live], -np.inf).argmax(axis=1)
            more = open_[live, best]
            live, best = live[more], best[more]
            if not len(live):
                break
            open_[live, best] = False
            near = table[pool[live, best]]
            new = ~seen[live[:, None], near]
            near = np.where(new, near, -1)
            seen[live[:, None], near] = True
            s = np.where(new, np.einsum("qd,qed->qe", q[live], self.v[near]), -np.inf)
            width = pool.shape[1]
            if width < ef + near.shape[1]:
                grow = ef + near.shape[1] - width
                pool, score, open_ = (np.pad(x, ((0, 0), (0, grow)), constant_values=c) for x, c in ((pool, -1), (score, -np.inf), (open_, False)))
            pool[live, ef:], score[live, ef:], open_[live, ef:] = near, s, new
            order = np.argsort(-score[live], axis=1, kind="stable")
            pool[live], score[live], open_[live] = (np.take_along_axis(x[live], order, axis=1) for x in (pool, score, open_))
            open_[live, ef:] = False
            score[live, ef:] = -np.inf
        return pool[:, :ef], score[:, :ef]


# -- rows ------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Sorted batches as one table a shard."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        shard = b.column("shard").to_numpy()
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))[: len(shard)].tolist()
        for a, z in zip(cuts, [*cuts[1:], len(shard)]):
            if held and held[0].column("shard")[0].as_py() != shard[a]:
                yield held[0].column("shard")[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield held[0].column("shard")[0].as_py(), pa.Table.from_batches(held)


def _build(rows: DataFrame, preset: Preset) -> DataFrame:
    """Index rows of (shard, id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, t in _by_shard(batches):
            t = t.combine_chunks()
            ids, vectors = t.column("id").to_numpy(), _matrix(t.column("vector").chunk(0))
            level, links = Shard.built(ids, vectors, preset)
            for at in range(0, len(ids), 2048):
                to = min(at + 2048, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * (to - at), pa.int32()), pa.array(np.arange(at, to, dtype=np.int32)), pa.array(ids[at:to]), t.column("vector").chunk(0).slice(at, to - at), pa.array(level[at:to]), pa.array(links[at:to], pa.list_(pa.list_(pa.int32()))), pa.array([False] * (to - at))],
                    names=["shard", "node", "id", "vector", "level", "links", "dead"],
                )

    dealt = rows.select("shard", "id", "vector").repartition("shard").sortWithinPartitions("shard", "id")
    return dealt.mapInArrow(run, SHARDS_SCHEMA)


def _fitting(rows: DataFrame, dim: int, key: str, vector: str) -> DataFrame:
    size = F.coalesce(F.size(vector), F.lit(-1))
    wrong = F.raise_error(F.concat(F.lit(f"vector of {dim} dimensions expected, got "), size.cast("string")))
    return rows.select(F.col(key).cast("long").alias("id"), F.when(size == dim, F.col(vector).cast("array<float>")).otherwise(wrong).alias("vector"))


def _once(rows: DataFrame) -> DataFrame:
    """Rows by id; one that comes twice raises."""
    n = rows.groupBy("id").agg(F.first("vector").alias("vector"), F.count("*").alias("n"))
    return n.select(F.when(F.col("n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("duplicate id "), F.col("id").cast("string")))).alias("id"), "vector")


def _dealt(rows: DataFrame, count: int, dim: int, first: int, shard_bytes: int) -> DataFrame:
    shards = max(1, -(-count * dim * 4 // shard_bytes))
    return rows.withColumn("shard", (F.pmod(F.xxhash64("id"), F.lit(shards)) + first).cast("int"))


def build(rows: DataFrame, dim: int, preset: str = "default", key: str = "id", vector: str = "embedding", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index rows of a table."""
    return _build(_dealt(_once(_fitting(rows, dim, key, vector)), rows.count(), dim, 0, shard_bytes), PRESETS[preset])


def add(index: DataFrame, rows: DataFrame, dim: int, preset: str = "default", key: str = "id", vector: str = "embedding", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index with further rows in shards of their own."""
    there = index.filter("NOT dead").select("id", F.lit(True).alias("there"))
    fresh = _once(_fitting(rows, dim, key, vector)).join(there, "id", "left")
    fresh = fresh.select(F.when(F.col("there"), F.raise_error(F.concat(F.lit("duplicate id "), F.col("id").cast("string")))).otherwise(F.col("id")).alias("id"), "vector")
    first = (index.agg(F.max("shard")).first()[0] or 0) + 1
    return index.unionByName(_build(_dealt(fresh, rows.count(), dim, first, shard_bytes), PRESETS[preset]))


def remove(index: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The index with rows marked as removed; ids that are not there change nothing."""
    gone = ids.select(F.col(key).alias("id"), F.lit(True).alias("gone")).distinct()
    return index.join(gone, "id", "left").select("shard", "node", "id", "vector", "level", "links", (F.col("dead") | F.coalesce("gone", F.lit(False))).alias("dead"))


def compact(index: DataFrame, preset: str = "default", share: float = 0.2) -> DataFrame:
    """Shards of which more than ``share`` is removed built anew without those rows."""
    full = index.groupBy("shard").agg((F.avg(F.col("dead").cast("int")) > share).alias("stale"))
    marked = index.join(full, "shard")
    return marked.filter("NOT stale").drop("stale").unionByName(_build(marked.filter("stale AND NOT dead"), PRESETS[preset]))


def save(index: DataFrame, path: str) -> None:
    index.repartition("shard").sortWithinPartitions("shard", "node").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS_SCHEMA).parquet(path)


def stats(index: DataFrame, preset: str = "default") -> DataFrame:
    """count, dimension, m, ef, size_bytes: four bytes a component and 150 a row."""
    p = PRESETS[preset]
    s = index.filter("NOT dead").agg(F.count("*").alias("count"), F.coalesce(F.max(F.size("vector")), F.lit(0)).cast("long").alias("dimension"))
    return s.select("count", "dimension", F.lit(p.m).alias("m"), F.lit(p.ef_search).alias("ef"), (F.col("count") * (F.col("dimension") * 4 + 150)).alias("size_bytes"))


def search(index: DataFrame, queries: DataFrame, k: int = 10, ef: int | None = None, preset: str = "default", key: str = "query_id", vector: str = "embedding", exact: bool = False) -> DataFrame:
    """query_id, id, score, rank: the best ``k`` found for each query, ties to the smaller id.

    Each query goes to each shard; what a shard finds is merged by query.  With ``exact`` a
    shard is then checked for rows that the graph missed, by blocks of matrix products: no more
    memory, but time by queries times rows.
    """
    beam = ef or PRESETS[preset].ef_search
    asked = queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<float>").alias("vector"))
    shards = index.select("shard").distinct()
    fanned = asked.join(F.broadcast(shards))  # a shard is one row for some megabytes of vectors
    none = lambda kind: F.lit(None).cast(kind)
    both = index.select(F.lit(0).alias("kind"), "shard", "node", "id", "vector", "level", "links", "dead").unionByName(
        fanned.select(F.lit(1).alias("kind"), "shard", none("int").alias("node"), F.col("query_id").alias("id"), "vector", none("int").alias("level"), none("array<array<int>>").alias("links"), none("boolean").alias("dead"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _by_shard(batches):
            t = t.combine_chunks()
            mine = int((t.column("kind").to_numpy() == 0).sum())
            rows, asks = t.slice(0, mine).combine_chunks(), t.slice(mine).combine_chunks()
            if not len(asks):
                continue
            dim, want = len(rows.column("vector")[0]), pa.compute.list_value_length(asks.column("vector")).to_numpy()
            if (want != dim).any():
                raise ValueError(f"query of {dim} dimensions expected")
            shard = Shard(rows.column("id").to_numpy(), _matrix(rows.column("vector").chunk(0)), rows.column("level").to_numpy(), rows.column("links").to_pylist(), rows.column("dead").to_numpy())
            ids, vectors = asks.column("id").to_numpy(), _matrix(asks.column("vector").chunk(0))
            for at in range(0, len(ids), step := max(1, _SEEN // (mine + 1))):
                nodes, scores = (shard.checked if exact else shard.search)(vectors[at : at + step], k, beam)
                r, c = np.nonzero(nodes >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + step][r]), pa.array(shard.ids[nodes[r, c]]), pa.array(scores[r, c])], names=["query_id", "id", "score"])

    found = both.repartition("shard").sortWithinPartitions("shard", "kind", "node").mapInArrow(run, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
