"""Repair of the structure of conversations at least cost.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``.  Rows that are blank
or repeat an earlier row are deleted; any row may be kept (0), given the role that is due (2)
or deleted (3), rows without text may be put in anywhere (2), and a truncated row that stays
costs 1.  Of the cheapest edits those come out whose initials (D, I, K, R) are least.

Costs to go from a point are a vector over four states (start, after s, after u, after a).
Less its least value only a few vectors occur, and what a block of ``BLOCK`` rows does to one
depends on the block's symbols alone.  So the four Russians' tables hold, for each block of
symbols and each vector behind it, the vector before it, the cost, and for each state before
it the state behind it.  Conversations are worked through backward, a lookup a block, and
traced forward, blocks being expanded backward where single edits are wanted; at a tie the
least initial is taken, which the vectors allow at every row.

Rows are sorted over all conversations by range and cut into segments of at most ``SEGMENT``
rows.  A segment is summed up for every vector that may lie behind it, the segments of a
conversation are linked, and each is traced by itself; equal rows are one row with a number.
So a conversation of a third of all rows is dealt to many tasks.  Two steps see all of one
conversation: the link (a few numbers a segment) and the digest, which as a SHA-256 needs all
bytes in order; it streams them and holds none but the audit string.

Cases: a null role or text is one space; a null conversation is one like any other; null turns
come first; rows of one turn are in order of role and text, equal rows side by side; texts of
any length are hashed whole; an empty table gives an empty table; clashing extra columns do
no harm, for only the four named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.staging import Stage

BLOCK = 4
SEGMENT_BITS = 12
SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
#: States: 0 start, 1 after s, 2 after u, 3 after a.  What follows, and what is put in.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
DUE = "uuau"
ROLES = {"u": "user", "a": "assistant"}
TAIL = ("", "ua", "a", "")
END = (0, 4, 2, 0)
#: Symbols: 0 no row, 1 a row that must go, then kind (s, u, a, other) twice and truncated.
SYMBOLS = 10
KINDS = "sua?"
_EDITS = str.maketrans("uaUA", "IIRR")


# -- tables ----------------------------------------------------------------------------

Vector = tuple[int, ...]


def before(symbol: int, f: Vector) -> Vector:
    """Costs to go before a row from those behind it."""
    if symbol < 2:
        return tuple(x + DELETE * symbol for x in f)
    kind, late = KINDS[(symbol - 2) // 2], symbol % 2 * CUT_SHORT
    g = []
    for q in range(4):
        ways = [DELETE + f[q], REROLE + late + f[NEXT[q, DUE[q]]]]
        if (q, kind) in NEXT:
            ways.append(KEEP + late + f[NEXT[q, kind]])
        g.append(min(ways))
    u, a = min(g[2], INSERT + g[3]), min(g[3], INSERT + g[2])
    return min(g[0], INSERT + u), min(g[1], INSERT + u), u, a


def edits(symbol: int, q: int, f: Vector) -> tuple[str, int]:
    """What is done before and at a row in state ``q``: rows put in (u, a), then D, K, U or A; and the state behind."""
    if symbol < 2:
        return "D" * symbol, q
    kind, late, now, said = KINDS[(symbol - 2) // 2], symbol % 2 * CUT_SHORT, before(symbol, f), ""
    while now[q] != DELETE + f[q]:
        after = NEXT[q, DUE[q]]
        if now[q] == INSERT + now[after]:
            said += DUE[q]
            q = after
        elif (q, kind) in NEXT and now[q] == KEEP + late + f[NEXT[q, kind]]:
            return said + "K", NEXT[q, kind]
        else:
            return said + DUE[q].upper(), after
    return said + "D", q


class Tables:
    """Transitions of all vectors by one symbol and by blocks; vector 0 is that of the end."""

    def __init__(self):
        at, self.vectors, step, cost = {END: 0}, [END], [], []
        for f in self.vectors:
            made = [before(s, f) for s in range(SYMBOLS)]
            for g in made:
                base = tuple(x - min(g) for x in g)
                if base not in at:
                    at[base] = len(self.vectors)
                    self.vectors.append(base)
            step.append([at[tuple(x - min(g) for x in g)] for g in made])
            cost.append([min(g) for g in made])
        act = [[[edits(s, q, f) for q in range(4)] for s in range(SYMBOLS)] for f in self.vectors]
        self.act = [[[x[0] for x in y] for y in z] for z in act]
        self.one = (np.array(step), np.array(cost), np.array([[[x[1] for x in y] for y in z] for z in act]))
        self.step, self.cost, self.exit = self.one
        for _ in range(BLOCK - 1):
            self.longer()

    def longer(self) -> None:
        """Blocks of one more symbol in front: the vector behind that symbol is the one before the block."""
        step, cost, exits = self.one
        mid = self.step[:, None, :]
        first = np.arange(SYMBOLS)[None, :, None]
        n = len(self.vectors)
        gone = exits[mid, first]
        behind = np.take_along_axis(np.broadcast_to(self.exit[:, None], (*gone.shape[:3], 4)), gone, axis=3)
        self.step, self.cost, self.exit = step[mid, first].reshape(n, -1), (cost[mid, first] + self.cost[:, None, :]).reshape(n, -1), behind.reshape(n, -1, 4)

    def blocks(self, symbols: list[int]) -> list[int]:
        """Block codes; the first block begins with symbols for no row."""
        s = np.array([0] * (-len(symbols) % BLOCK) + symbols).reshape(-1, BLOCK)
        return (s @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist()

    def summed(self, symbols: list[int]) -> np.ndarray:
        """For each vector behind a segment: cost, vector before it, and the state behind for each before."""
        codes, v = self.blocks(symbols), np.arange(len(self.vectors))
        cost, behind = np.zeros_like(v), []
        for c in reversed(codes):
            behind.append(v)
            cost, v = cost + self.cost[v, c], self.step[v, c]
        q = np.tile(np.arange(4), (len(v), 1))
        for c in codes:
            q = self.exit[behind.pop()[:, None], c, q]
        return np.column_stack([cost, v, q]).astype("<i4")

    def traced(self, symbols: list[int], v: int, q: int) -> list[str]:
        """The edits at each row of a segment between a state before it and a vector behind it."""
        codes, behind = self.blocks(symbols), []
        for c in reversed(codes):
            behind.append(v)
            v = int(self.step[v, c])
        step, _, exits = self.one
        said, at = [], -(-len(symbols) % BLOCK)
        for _ in codes:
            row, v, inside = symbols[max(at, 0) : at + BLOCK], behind.pop(), []
            for s in reversed(row):
                inside.append(v)
                v = int(step[v, s])
            for s in row:
                v = inside.pop()
                said.append(self.act[v][s][q])
                q = int(exits[v, s, q])
            at += BLOCK
        return said


@cache
def tables() -> Tables:
    return Tables()


# -- Spark -----------------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first columns."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _arrow(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _batched(names: list[str], kinds: list[pa.DataType], rows: Iterator[tuple], size: int = 2048) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _arrow(names, kinds, held)
            held = []
    if held:
        yield _arrow(names, kinds, held)


_LONG, _TEXT, _BYTES = pa.int64(), pa.string(), pa.binary()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        t = tables()
        for (conv, seg), found in _runs(batches, 2):
            firsts = [r[1] for r in found]
            illegal = sum(r[3] - 1 for r in found) + sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
            yield conv, seg, firsts[0], firsts[-1], illegal, t.summed([r[2] for r in found]).tobytes()

    yield from _batched(["conv", "seg", "head", "foot", "illegal", "summed"], [_LONG, _LONG, _TEXT, _TEXT, _LONG, _BYTES], rows())


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        t = tables()
        for (conv,), found in _runs(batches, 1):
            summed = [np.frombuffer(r[4], dtype="<i4").reshape(len(t.vectors), 6) for r in found]
            v, cost, behind = 0, 0, []
            for s in reversed(summed):
                behind.append(v)
                cost, v = cost + int(s[v, 0]), int(s[v, 1])
            cost += t.vectors[v][0]
            illegal = sum(r[3] for r in found) + sum(a[2] + b[1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
            q = 0
            for r, s in zip(found, summed):
                v = behind.pop()
                entry, q = q, int(s[v, 2 + q])
                yield (conv, r[0], v, entry, *((None,) * 3 if behind else (TAIL[q], cost, illegal)))

    yield from _batched(["conv", "seg", "behind", "entry", "tail", "cost", "illegal"], [_LONG, _LONG, _LONG, _LONG, _TEXT, _LONG, _LONG], rows())


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        t = tables()
        for (conv, _), found in _runs(batches, 2):
            (_, _, _, behind, entry, tail), marks = found[0], found[1:]
            for r, said in zip(marks, t.traced([m[1] for m in marks], behind, entry)):
                yield conv, r[0], said + "D" * (r[2] - 1)
            if tail:
                yield conv, (1 << 63) - 1, tail

    yield from _batched(["conv", "pos", "said"], [_LONG, _LONG, _TEXT], rows())


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, edits, role or None, text): rows put in, rows with what is done to them."""
    said = ""
    for b in batches:
        for conv, pos, own, role, text in zip(*(c.to_pylist() for c in b.columns)):
            if own is not None:
                said = own
                put = said.rstrip("DKUA")
                for x in put:
                    yield conv, "I", ROLES[x], ""
                said = said[len(put) :]
            elif said[:1] == "K":
                yield conv, said, role, text
            elif said[:1] in "UA" and said:
                yield conv, said, ROLES[said[0].lower()], text
            elif said:
                yield conv, said, None, None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        key, begun = None, False
        for conv, said, role, text in _repaired(batches):
            if not begun or conv != key:
                if begun:
                    yield key, "".join(audit), digest.hexdigest(), kept
                key, begun, audit, digest, kept = conv, True, [], hashlib.sha256(), 0
            audit.append(said.translate(_EDITS))
            if role is not None:
                digest.update(f"\n{role}:{text}".encode("utf-8", "surrogatepass")[kept == 0 :])
                kept += 1
        if begun:
            yield key, "".join(audit), digest.hexdigest(), kept

    yield from _batched(["conv", "audit", "repaired_sha256", "repaired"], [_LONG, _TEXT, _TEXT, _LONG], rows())


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        key, at = None, -1
        for conv, _, role, text in _repaired(batches):
            if role is not None:
                key, at = conv, at + 1 if at >= 0 and conv == key else 0
                yield conv, at, role, text

    yield from _batched(["conv", "turn", "role", "text"], [_LONG, _LONG, _TEXT, _TEXT], rows(), 256)


class Repair:
    """One run over some turns; its tables are staged once for all that is asked of it."""

    def __init__(self, df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.stage = Stage(df.sparkSession, "repair")
        filled = lambda c: F.coalesce(F.col(c), F.lit(" "))
        equal = df.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text")).groupBy("conv", "turn", "role", "text").count()
        ranged = equal.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
        self.rows = self.stage.put("rows", ranged.withColumn("pos", F.monotonically_increasing_id()))
        self.marks = self.stage.put("marks", self._marked())
        keys = ["conv", "seg"]
        summed = _dealt(self.marks.select("conv", "seg", "pos", "initial", "symbol", "count"), keys, ["pos"]).mapInArrow(_summaries, "conv long, seg long, head string, foot string, illegal long, summed binary")
        self.links = self.stage.put("links", _dealt(summed, ["conv"], ["seg"]).mapInArrow(_links, "conv long, seg long, behind long, entry long, tail string, cost long, illegal long"))
        none = F.lit(None).cast("long")
        both = self.links.select("conv", "seg", none.alias("pos"), none.alias("symbol"), none.alias("count"), "behind", "entry", "tail").unionByName(
            self.marks.select("conv", "seg", "pos", F.col("symbol").cast("long").alias("symbol"), "count"), allowMissingColumns=True
        )
        traced = _dealt(both, keys, ["pos"]).mapInArrow(_traces, "conv long, pos long, said string")
        told = traced.unionByName(self.rows.select("conv", "pos", "role", "text"), allowMissingColumns=True).select("conv", "pos", "said", "role", "text")
        self.told = told.repartition("conv").sortWithinPartitions("conv", "pos", F.col("said").asc_nulls_last())

    def _marked(self) -> DataFrame:
        """Faults and symbols, without texts."""
        bare = F.rtrim(F.col("text"), F.lit(SPACE))
        ends = F.substring(bare, -1, 1).isin(".", "!", "?")
        rows = self.rows.select("conv", "turn", "role", "pos", "count", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), (bare == "").alias("empty"), (~ends).alias("open"))
        keys = ("conv", "role", "t1", "t2")
        first = rows.groupBy(*(F.col(k).alias(f"f_{k}") for k in keys)).agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1")
        found = rows.join(first, [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in keys], "left").withColumn("again", F.coalesce(F.col("pos") > F.col("first"), F.lit(False)))
        initial = F.substring("role", 1, 1)
        kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
        late = F.col("open") & ~F.col("again") & ~F.col("empty")
        return found.select(
            "conv", "turn", F.shiftright("pos", SEGMENT_BITS).alias("seg"), "pos", "count", initial.alias("initial"), F.when(F.col("empty") | F.col("again"), 1).otherwise(2 + 2 * kind + late.cast("int")).alias("symbol"),
            F.when(F.col("empty"), F.col("count")).otherwise(0).alias("blank"), F.when(F.col("empty"), 0).otherwise(F.col("count") - 1 + F.col("again").cast("long")).alias("duplicate"), late.cast("long").alias("truncated"),
        )

    def report(self, conversations: DataFrame | None = None) -> DataFrame:
        """One row a conversation, and for each of ``conversations`` (conv_id) without rows one of zeros."""
        turns = self.marks.groupBy("conv").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum((F.col("count") - 1) * DELETE).alias("more")
        )
        ends = self.links.filter("tail IS NOT NULL").select("conv", "cost", "illegal")
        digests = self.told.mapInArrow(_digests, "conv long, audit string, repaired_sha256 string, repaired long")
        parts = turns.unionByName(ends, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
        if conversations is not None:
            parts = parts.unionByName(conversations.select(F.col("conv_id").cast("long").alias("conv")).distinct(), allowMissingColumns=True)
        zero = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long")
        return parts.groupBy("conv").agg(
            *(zero(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")), (zero("cost") + zero("more")).alias("cost"),
            F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"), zero("repaired").alias("repaired"),
        ).withColumnRenamed("conv", "conv_id")

    def turns(self) -> DataFrame:
        """The repaired conversations: conv_id, turn (from 0), role, text."""
        return self.told.mapInArrow(_turns, "conv long, turn long, role string, text string").withColumnRenamed("conv", "conv_id")


def damage(df: DataFrame) -> DataFrame:
    """Conversations with faults at rows that a checksum of conversation and turn picks, one in 20 for each of five faults."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    text: Column = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def _sql() -> str:
    """The same edits by a recursion from the last row on, with a cost, edits and rows for each state."""
    state = lambda q: f"{{'c': c{q}, 'a': a{q}, 'r': r{q}}}"
    put: Callable[[str, str], str] = lambda s, role: f"{{'c': {s}.c + 2, 'a': 'I' || {s}.a, 'r': list_prepend('{role}:', {s}.r)}}"

    def ways(q: int) -> str:
        due = NEXT[q, DUE[q]]
        kept = "".join(f", CASE WHEN NOT gone AND initial = '{i}' THEN {{'c': c{t} + late, 'a': 'K' || a{t}, 'r': list_prepend(role || ':' || text, r{t})}} END" for (p, i), t in NEXT.items() if p == q)
        return f"list_min(list_filter([{{'c': c{q} + 3, 'a': 'D' || a{q}, 'r': r{q}}}, CASE WHEN NOT gone THEN {{'c': c{due} + 2 + late, 'a': 'R' || a{due}, 'r': list_prepend('{ROLES[DUE[q]]}:' || text, r{due})}} END{kept}], lambda x: x IS NOT NULL)) AS g{q}"

    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), picked AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS fault FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM picked WHERE fault <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, {space}) AS bare, left(role, 1) AS initial FROM damaged
), judged AS (
  SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM numbered
), rows_ AS (SELECT *, blank OR duplicate AS gone, truncated::INT AS late, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM judged),
backward AS (
  SELECT DISTINCT conv_id, n + 1 AS i, 0 AS c0, '' AS a0, []::VARCHAR[] AS r0, 4 AS c1, 'II' AS a1, ['user:', 'assistant:'] AS r1, 2 AS c2, 'I' AS a2, ['assistant:'] AS r2, 0 AS c3, '' AS a3, []::VARCHAR[] AS r3 FROM rows_
  UNION ALL
  SELECT conv_id, i, s0.c, s0.a, s0.r, s1.c, s1.a, s1.r, s2.c, s2.a, s2.r, s3.c, s3.a, s3.r FROM (
    SELECT conv_id, i, list_min([g0, {put('s2', 'user')}]) AS s0, list_min([g1, {put('s2', 'user')}]) AS s1, s2, s3 FROM (
      SELECT *, list_min([g2, {put('g3', 'assistant')}]) AS s2, list_min([g3, {put('g2', 'user')}]) AS s3 FROM (
        SELECT x.conv_id, x.i, {', '.join(ways(q) for q in range(4))} FROM backward b JOIN rows_ x ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND x.i = b.i - 1)))
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate, sum(truncated::INT) AS truncated,
    sum((previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM rows_ GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(c0, 0)::BIGINT AS cost, coalesce(a0, '') AS audit, sha256(coalesce(array_to_string(r0, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN backward b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1
"""


ORACLE_SQL = _sql()
