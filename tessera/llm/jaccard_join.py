"""Exact self-join of texts by the Jaccard similarity of their word shingles.

Jaccard distance is a metric, so with threshold t and d = 1 - t: documents within d of one
pivot are one component whatever lies between them, and a document z can only link to a
document x that is within d of pivot p if d(z, p) <= 2d and d(x, p) >= d(z, p) - d.

1. Texts of equal shingle sets become one node.
2. A linked node has at most a quarter of its shingles outside its partner.  So of its
   least-hashed 40 per cent, all but a quarter of the set's size must occur in other nodes.
   Nodes that fail this end here; only (shingle, node) pairs move to find them.
3. Unrelated texts are all at distance 1 of each other, where Voronoi cells of random pivots
   say nothing, so regions are seeded by shingles: linked nodes share one of their
   ``quarter + 1`` rarest shingles.  Every such shingle's nodes get the most central
   of them (whose shingles most others have) as pivot; nodes are compared with their pivots.
4. Nodes within d of a pivot of a shingle are settled for it.  The others join again with
   new pivots, eight times as many per shingle each time, until none is left.
5. Boundary windows: where z is not within d but within 2d of a pivot and not in its
   component yet, it is joined with the pivot's nodes x of the window.  Both are seen as
   differences from the pivot; a link needs a shared difference, so they meet by those.

Groups are only aggregated and joined, and nodes of a shingle meet its pivots alone.  Copies
settle in the first round, however many they are.  Where many texts share rare shingles
without being linked, each open one becomes a pivot in the end, so a shingle then costs the
square of its nodes.  A pair is first tried by sizes and by sketches of its sets, about two
bits a shingle, whose differing bits are a lower bound of the shingles that differ; what
that leaves is compared by whole sets, as 64-bit hashes.  Nodes are told apart by 128 bits.

Cases: null and empty texts, or texts without words, have an empty set and are linked with
nothing; a text of fewer words than a shingle is one shingle; texts are read whole; a null id
is a valid id, component of itself if unlinked; repeated rows stay repeated; an empty table
gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm import words as W
from tessera.llm.components import components
from tessera.llm.memory import trimmed
from tessera.llm.staging import Stage

SHINGLE = 5
_SLICE = 256
_SEEN = 200_000


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.empty(0, dtype=np.uint64)
    return np.unique(W.grams(W.hashes(w), min(SHINGLE, len(w))) + np.uint64(min(SHINGLE, len(w))))


def node_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else 0


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            yield whole.slice(at, _SLICE)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document (key is its node), and the least-hashed shingles of its node.

    A task gives each node's shingles once, as far as it remembers.
    """
    names = ["key", "node", "doc_id", "txt", "n", "chk"]
    seen: set[int] = set()
    for b in _parts(batches):
        sets = [shingles(t) for t in b.column("text").to_pylist()]
        nodes = np.array([node_of(s) for s in sets], dtype=np.int64)
        checks = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), seed=1) for s in sets], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes), b.column("doc_id"), b.column("txt"), pa.array([len(s) for s in sets], pa.int64()), pa.array(checks)], names=names)
        keys, of, sizes = [], [], []
        for s, node in zip(sets, nodes.tolist()):
            if len(s) and node not in seen:
                seen.add(node)
                keys.append(s[: band(len(s))])
                of.append(node)
                sizes.append(len(keys[-1]))
        if len(seen) > _SEEN:
            seen.clear()
        if keys:
            flat = np.concatenate(keys).view(np.int64)
            none = pa.nulls(len(flat), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array(of, dtype=np.int64), sizes)), none, none, none, none], names=names)


def band(n: int) -> int:
    """How many shingles of a set of ``n`` are looked at first: a quarter, 15 per cent and one."""
    return min(n, n // 4 + 1 + (15 * n + 99) // 100)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, node) to the number of keys each node shares with another; rows of documents pass."""

    names = ["node", "shared", "doc_id", "txt", "n", "chk"]

    def emit(key: np.ndarray, node: np.ndarray, first_alone: bool, last_alone: bool) -> pa.RecordBatch:
        same = key[1:] == key[:-1]
        shared = np.zeros(len(key), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        shared[0] |= not first_alone
        shared[-1] |= not last_alone
        of, n = np.unique(node[shared], return_counts=True)
        none = pa.nulls(len(of), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(of), pa.array(n), none, none, none, none], names=names)

    last_key = None
    held_key, held_node = np.empty(0, np.int64), np.empty(0, np.int64)
    for whole in batches:
        is_doc = whole.column("n").is_valid()
        d = whole.filter(is_doc)
        if d.num_rows:
            yield pa.RecordBatch.from_arrays([d.column("node"), pa.nulls(d.num_rows, pa.int64()), d.column("doc_id"), d.column("txt"), d.column("n"), d.column("chk")], names=names)
        b = whole.filter(pc.invert(is_doc))
        key, node = np.concatenate((held_key, b.column("key").to_numpy())), np.concatenate((held_node, b.column("node").to_numpy()))
        if not len(key):
            continue
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        if len(key) > 1:
            yield emit(key[:-1], node[:-1], key[0] != last_key, key[-1] != key[-2])
            last_key = key[-2]
        held_key, held_node = key[-1:], node[-1:]
    if len(held_key):
        yield emit(held_key, held_node, held_key[0] != last_key, True)


def sketch(s: np.ndarray) -> bytes:
    """One bit for each class of the low hash bits: whether an odd number of the set falls there."""
    width = max(64, 1 << int(2 * max(len(s), 1) - 1).bit_length())
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of how many shingles only one of two sets has: differing bits of their sketches."""
    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _parts(batches):
        sets = [shingles(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "bits", "body"])


def _near_enough(least: int):
    """Pairs whose sketches leave a similarity of ``least`` per cent possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = (b.column("n_a").to_numpy() + b.column("n_b").to_numpy()).astype(np.int64)
            apart = np.fromiter(map(least_difference, b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist()), dtype=np.int64, count=b.num_rows)
            yield b.select(["a", "b"]).filter(pa.array(100 * (both - apart) >= least * (both + apart)))

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _parts(batches):
        sets = [np.frombuffer(x, dtype=np.int64) for x in b.column("body").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)), pa.array(np.repeat(b.column("node").to_numpy(), [len(s) for s in sets]))], names=["key", "node"])


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _parts(batches):
        inter, union = [], []
        for x, y in zip(b.column("body_a").to_pylist(), b.column("body_b").to_pylist()):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            inter.append(_overlap(x, y))
            union.append(len(x) + len(y) - inter[-1])
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "inter", "uni"])


def _differences(percent: int):
    """(pivot a, node b) to one row for each difference by which a linked node can be met.

    Let c be percent / (100 + percent) and b have A shingles beside the pivot's and lack D of
    them.  Two nodes, one of them not linked to the pivot, are linked only if they share more
    than c A + (1 - c) D differences, and at least c (|a| + |b|) - |a and b| of an unlinked b.
    So of its differences, in one order for all, it has to show ``take``.
    """
    c = percent / (100 + percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            out: list[np.ndarray] = []
            takes: list[int] = []
            for x, y, linked in zip(batch.column("body_a").to_pylist(), batch.column("body_b").to_pylist(), batch.column("linked").to_pylist()):
                p, z = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                diff = np.setxor1d(p, z, assume_unique=True)
                both = (len(p) + len(z) - len(diff)) // 2
                more, less = len(z) - both, len(p) - both
                need = int(c * more + (1 - c) * less + 1e-9) + 1 if linked else max(1, int(np.ceil(c * (len(p) + len(z)) - both - 1e-9)))
                take = len(diff) - need + 1
                out.append(diff.view(np.int64) if take > 0 else diff[:0].view(np.int64))
                takes.append(max(0, take))
            n = [len(o) for o in out]
            at = pa.array(np.repeat(np.arange(len(out)), n))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in ("a", "b", "dist", "linked")] + [pa.array(np.concatenate(out) if out else np.empty(0, np.int64)), pa.array(np.repeat(np.array(takes, dtype=np.int32), n))], names=["a", "b", "dist", "linked", "token", "take"])

    return run


def link_nodes(docs: DataFrame, stage: Stage, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, txt, text.  Gives (doc_id, txt, n, node) and links (a, b) that join all components."""
    if percent < 75:
        raise ValueError("shingle prefixes are laid out for a similarity of 0.75 or more")
    rows = docs.mapInArrow(trimmed(_scanned), "key long, node long, doc_id long, txt long, n long, chk long")
    scan = stage.put("scan", rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(trimmed(_shared), "node long, shared long, doc_id long, txt long, n long, chk long"))
    nodes = scan.filter("n is not null").select("doc_id", "txt", "n", "node", "chk")
    # Sets that have 64 bits in common but not 128; about none, even among billions.
    twins = nodes.filter("n > 0").groupBy("node").agg(F.min("chk").alias("lo"), F.max("chk").alias("hi")).filter("lo <> hi").select("node", F.lit(True).alias("twin"))
    counts = scan.filter("n is null").groupBy("node").agg(F.sum("shared").alias("shared")).join(twins, "node", "left_anti")
    nodes = nodes.join(twins, "node", "left").select("doc_id", "txt", "n", F.when(F.col("twin"), F.xxhash64("node", "chk")).otherwise(F.col("node")).alias("node"), F.coalesce("twin", F.lit(False)).alias("twin"))
    nodes = stage.put("nodes", nodes)
    size = F.col("n")
    looked = F.least(size, F.floor(size / 4) + 1 + F.floor((15 * size + 99) / 100))
    one = nodes.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "txt")).alias("d"), F.first("n").alias("n"), F.max("twin").alias("twin"))
    alive = one.join(counts, "node", "left").filter(F.col("twin") | (F.col("shared") >= looked - F.floor(size / 4)))
    alive = alive.select("node", F.col("d.doc_id").alias("doc_id"), F.col("d.txt").alias("txt"))
    same = docs.doc_id.eqNullSafe(alive.doc_id) & (docs.txt == alive.txt)
    chosen = docs.join(alive, same).select("node", "text").dropDuplicates(["node"])
    sets = stage.put("sets", chosen.mapInArrow(trimmed(_sets), "node long, n long, bits binary, body binary"))
    stage.drop("scan")

    def with_sets(p: DataFrame) -> DataFrame:
        a, b = sets.select(F.col("node").alias("a"), F.col("body").alias("body_a")), sets.select(F.col("node").alias("b"), F.col("body").alias("body_b"))
        return p.join(a, "a").join(b, "b")

    def compare(p: DataFrame, least: int) -> DataFrame:
        """Of pairs (a, b) those whose sizes and sketches allow ``least`` per cent, to a, b, inter, uni."""
        side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
        near = p.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
        return with_sets(near.mapInArrow(trimmed(_near_enough(least)), "a long, b long")).mapInArrow(trimmed(_compared), "a long, b long, inter long, uni long")

    linked = 100 * F.col("inter") >= percent * F.col("uni")
    reach = 2 * percent - 100  # per cent of similarity at distance 2d
    # Rarest shingles first: those of one node alone fill a node's prefix without a row.
    keys = sets.mapInArrow(trimmed(_keys), "key long, node long")
    common = keys.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    by_node = keys.join(common, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("ks")).join(sets.select("node", "n"), "node")
    # Of two linked nodes the smaller has its first common shingle among its first
    # n - ceil(2 c n) + 1, with c = percent / (100 + percent), the larger among a quarter and one.
    # A partner has at most ``most`` shingles, since only what others have can be shared.
    # Central nodes rank high: their shingles are those that most others have.
    alone = F.col("n") - F.size("ks")
    by_node = stage.put("by_node", by_node.select(
        "node", "n", "ks", (F.aggregate("ks", F.lit(0).cast("long"), lambda acc, k: acc + k["df"]) / F.col("n")).alias("rank"), (F.floor(F.col("n") / 4) + 1 - alone).cast("int").alias("slots"),
        (F.col("n") - F.ceil(F.col("n") * (2 * percent / (100 + percent)) - 1e-9) + 1 - alone).cast("int").alias("as_smaller"), F.floor(F.size("ks") * ((100 + percent) / percent) - F.col("n") + 1e-9).cast("long").alias("most"),
    ))
    reach_of = by_node.select("node", "n", "most")
    # Every linked pair has the smaller node here as ``open``: only those need to be pivots.
    left = by_node.filter("slots > 0").select("node", "n", "rank", F.when(F.col("most") >= F.col("n"), F.col("as_smaller")).otherwise(0).alias("opened"), F.posexplode(F.slice("ks", F.lit(1), F.col("slots"))).alias("at", "k"))
    left = left.select("k.key", "node", "n", "rank", (F.col("at") < F.col("opened")).alias("open"))
    left = stage.put("left-0", left)
    stars, i, pivots = [], 0, 1
    while True:
        # One pivot for each (shingle, lane); a shingle has ``pivots`` lanes.
        lane = F.pmod(F.xxhash64("node"), F.lit(pivots))
        tops = left.filter("open").groupBy("key", lane.alias("lane")).agg(F.max(F.struct("rank", "node", "n")).alias("top"))
        several = left.groupBy("key").agg(F.count("*").alias("all"), F.max("open").alias("any")).filter("all > 1 and any").select("key")
        heads = stage.put(f"heads-{i}", tops.join(several, "key").select("key", F.col("top.node").alias("a"), F.col("top.n").alias("n_a")))
        apart = (F.col("node") != F.col("a")) & (100 * F.least("n", "n_a") >= reach * F.greatest("n", "n_a"))
        met = left.join(heads, "key").filter(apart).select("key", "a", F.col("node").alias("b"))
        star = stage.put(f"star-{i}", compare(met.select("a", "b").distinct(), reach).filter(100 * F.col("inter") >= reach * F.col("uni")).withColumn("linked", linked))
        stars.append(star)
        settled = met.join(star.filter("linked").select("a", "b"), ["a", "b"]).select("key", F.col("b").alias("node")).distinct()
        rest = left.join(several, "key").join(heads.select("key", F.col("a").alias("node")), ["key", "node"], "left_anti").join(settled, ["key", "node"], "left_anti")
        i += 1
        left = stage.put(f"left-{i}", rest)
        stage.drop(f"left-{i - 1}")
        stage.drop(f"heads-{i - 1}")
        if left.isEmpty():
            break
        pivots *= 8
    star = stars[0]
    for s in stars[1:]:
        star = star.unionByName(s)
    links = star.filter("linked").select("a", "b").distinct()

    # Boundary windows, for nodes whose component is not yet that of the pivot.
    roots = stage.put("roots", components(links, stage, "reached"))
    at = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    outer = star.filter(~F.col("linked")).join(at("a"), "a", "left").join(at("b"), "b", "left")
    outer = outer.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "inter", "uni").distinct()
    dist = (1 - F.col("inter") / F.col("uni")).alias("dist")
    outer = stage.put("outer", outer)
    if not outer.isEmpty():
        inner = star.filter("linked").join(outer.select("a").distinct(), "a", "left_semi").distinct()
        region = outer.select("a", "b", dist, F.lit(False).alias("linked")).unionByName(inner.select("a", "b", dist, F.lit(True).alias("linked")))
        diff = stage.put("differences", with_sets(region).mapInArrow(trimmed(_differences(percent)), "a long, b long, dist double, linked boolean, token long, take int"))
        # The rarest of a region first: what all its nodes differ in comes last, or not at all.
        often = diff.groupBy("a", "token").agg(F.count("*").alias("often"), F.max(~F.col("linked")).alias("outside")).filter("often > 1 and outside")
        shown = diff.join(often, ["a", "token"], "left").withColumn("nth", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.coalesce("often", F.lit(1)), "token")))
        diff = shown.filter("nth <= take and often is not null")
        z = diff.filter("not linked").select("a", "token", F.col("b").alias("z"), F.col("dist").alias("dz"))
        x = diff.filter("linked").select("a", "token", F.col("b").alias("x"), F.col("dist").alias("dx"))
        window = F.col("dx") >= F.col("dz") - (1 - percent / 100) - 1e-9
        z = z.join(reach_of.select(F.col("node").alias("z"), F.col("n").alias("n_z"), F.col("most").alias("most_z")), "z")
        x = x.join(reach_of.select(F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("most").alias("most_x")), "x")
        fit = (F.col("n_x") <= F.col("most_z")) & (F.col("n_z") <= F.col("most_x"))
        meet = z.join(x, ["a", "token"]).filter(window & fit & (F.col("x") != F.col("z"))).select(F.least("x", "z").alias("a"), F.greatest("x", "z").alias("b")).distinct()
        links = links.unionByName(compare(meet, percent).filter(linked).select("a", "b"))
    return nodes, links


def grouped(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, txt (the text's hash), n (shingles), root (the same for all of a component)."""
    stage = Stage(df.sparkSession, "jaccard")
    docs = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("txt"), F.col(text).alias("text"))
    nodes, links = link_nodes(docs, stage, percent)
    links = stage.put("links", links)
    stage.keep("nodes", "links")
    roots = stage.put("placed", components(links, stage, "joined"))
    stage.keep("nodes", "placed")
    return nodes.join(roots, "node", "left").select("doc_id", "txt", "n", F.coalesce("root", "node").alias("root"))


def join_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable)."""
    placed = grouped(df, doc_id, text, percent)
    least = placed.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``df``, of each component only the one of least id; texts without words all stay."""
    placed = grouped(df, doc_id, text, percent)
    kept = placed.filter("n > 0").groupBy("root").agg(F.min(F.struct("doc_id", "txt")).alias("k")).select(F.col("k.doc_id").alias("keep_id"), F.col("k.txt").alias("keep_txt"))
    wordless = F.coalesce(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")), F.lit(0)) == 0
    rows = df.withColumn("keep_txt", F.xxhash64(text))
    full = rows.filter(~wordless).join(kept, (F.col(doc_id).eqNullSafe(F.col("keep_id"))) & (rows.keep_txt == kept.keep_txt)).dropDuplicates(["keep_id", text]).select(*(rows[c] for c in df.columns))
    return full.unionByName(rows.filter(wordless).select(df.columns))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d
), p AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM p a JOIN p b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r(x, y) AS (
  SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.y, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON s.doc_id = m.x
"""
