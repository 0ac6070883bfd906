"""Language identification by multilingual mixture inference.

A document is a mixture of languages.  Letter trigrams, hashed to ``BUCKETS``, are counted
for each language over all learning documents; a document's proportions are estimated by
expectation-maximisation of its trigrams' likelihood, until no proportion moves by more than
``STEP``.  Its set of languages is grown one by one: of all languages not in it the one whose
addition makes the likelihood largest is taken, while that gains more than ``PENALTY`` *
ln(trigrams).

Scale: both passes are narrow Arrow batch functions.  Counts are summed within each map task
and then by (language, bucket); the model is languages times ``BUCKETS`` numbers, whatever
the corpus, which bounds what goes to the driver and out by broadcast.

Cases: a null text, or one without letters, is ``und`` with score 0; rows without a language
are predicted but not learned from; with nothing to learn from, all is ``und``; texts are
read whole; repeated rows give repeated results; an empty table gives an empty table;
columns of the input are kept, and a clash with an output name raises ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.llm.memory import trimmed

BUCKETS = 1 << 15
ALPHA = 0.05
PENALTY = 2.0
STEP, ROUNDS = 1e-4, 1000
UNKNOWN = "und"
_SLICE = 256
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-cased letters; anything else is one blank."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[x]
    if not is_letter.any():
        return np.empty(0, dtype=np.int64)
    x = np.where(is_letter, x, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    x = np.concatenate(([32], x[keep], [32])).astype(np.uint32)
    if x[-2] == 32:
        x = x[:-1]
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(17)).astype(np.int64)


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities, languages by buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, _SLICE):
                part = b.slice(at, _SLICE)
                for t, k in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    h = trigrams(t)
                    if k not in sums:
                        sums[k] = np.zeros(BUCKETS, dtype=np.int64)
                    np.add.at(sums[k], h, 1) if len(h) < 64 else np.add(sums[k], np.bincount(h, minlength=BUCKETS), out=sums[k])
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at])], names=["lang", "bucket", "n"])

    learn = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    rows = learn.mapInArrow(trimmed(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    found = np.array(rows.column("lang").to_pylist(), dtype=object)
    names = sorted(set(found))
    counts = np.zeros((len(names), BUCKETS))
    if names:
        counts[np.searchsorted(names, found.astype(str)), rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    counts += ALPHA
    return names, counts / counts.sum(axis=1, keepdims=True)


def proportions(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """EM for mixture weights; p: trigrams by languages, n: how often each occurs.

    Steps shrink geometrically; ``ROUNDS`` only guards against rounding that never settles.
    """
    w = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for _ in range(ROUNDS):
        joint = p * w
        last, w = w, (n / joint.sum(axis=1)) @ joint / total
        if np.abs(w - last).max() <= STEP:
            break
    return w, float(n @ np.log(p @ w))


def mixture(text: str | None, model: np.ndarray) -> list[tuple[int, float]]:
    """(language, proportion), largest first; empty if the text has no letters.  model: buckets by languages."""
    h = trigrams(text) if text else np.empty(0, dtype=np.int64)
    if not len(h) or not model.shape[1]:
        return []
    at, n = np.unique(h, return_counts=True)
    p, n = model[at], n.astype(float)
    single = n @ np.log(p)
    order = [int(np.argmax(single))]
    best, shares, cost = float(single[order[0]]), np.ones(1), PENALTY * np.log(n.sum() + 1)
    while len(order) < p.shape[1]:
        rest = [k for k in range(p.shape[1]) if k not in order]
        # No mixture can gain more than taking the better of its languages for each trigram.
        now = np.log(p[:, order] @ shares)
        rest = [k for k in rest if n @ np.maximum(np.log(p[:, k]) - now, 0) > cost]
        tried = [(like, -k, w) for k in rest for w, like in [proportions(p[:, [*order, k]], n)]]
        if not tried or max(tried, key=lambda t: t[:2])[0] - best <= cost:
            break
        best, k, shares = max(tried, key=lambda t: t[:2])
        order.append(-k)
    return sorted(((k, float(s)) for k, s in zip(order, shares)), key=lambda x: -x[1])


def predict(df: DataFrame, names: list[str], model: np.ndarray, text: str = "text", label: str = "lang_pred", score: str = "score", parts: str = "languages") -> DataFrame:
    """Add the main language, its proportion, and all languages as array of (lang, share)."""
    fields = [T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(parts, T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])))]
    taken = {c.lower() for c in df.columns} & {f.name.lower() for f in fields}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are in the input already")
    held = df.sparkSession.sparkContext.broadcast((names, np.ascontiguousarray(model.T)))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, by_bucket = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b = whole.slice(at, _SLICE)
                found = [mixture(t, by_bucket) for t in b.column(text).to_pylist()]
                main = pa.array([langs[m[0][0]] if m else UNKNOWN for m in found], pa.string())
                share = pa.array([min(1.0, m[0][1]) if m else 0.0 for m in found], pa.float64())
                every = pa.array([[{"lang": langs[k], "share": s} for k, s in m] for m in found], kind)
                yield pa.RecordBatch.from_arrays([*b.columns, main, share, every], names=[*b.schema.names, label, score, parts])

    return df.mapInArrow(trimmed(run), T.StructType([*df.schema.fields, *fields]))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(df: DataFrame) -> DataFrame:
    """doc_id, text and further columns with held_out, lang_pred, score and languages."""
    names, model = fit(df.filter(~held_out(F.col("doc_id"))))
    return predict(df.withColumn("held_out", held_out(F.col("doc_id"))), names, model)
