"""Collocations against a count of all phrases in plain Python; filters against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import collocations as co

DOCS = "doc_id long, text string, lang string, id string, word string, f string"


def brute(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(2)) for q, b in cand.items() if len(p) == 2):
                continue
            score, cut = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top]):  # noqa: E741
            out[lang, i + 1] = (p.decode(), -a, l, r, n[lang], -s)
    return out


def found(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def test_phrases_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    vocab = ["new", "York", "CITY", "é", "É", "the", "a", "b\xa0c", "x\x01", "zz", "don't"]
    line = lambda: " ".join(rnd.choices(vocab, [9, 9, 7, 3, 3, 20, 5, 2, 2, 1, 1], k=rnd.randint(0, 30))) + rnd.choice([".", ", ", "\n", "\t", "", "?!"])
    rows = [(i, "".join(line() for _ in range(rnd.randint(0, 4))), rnd.choice(["en", "fr", None, "und"])) for i in range(150)]
    rows += [(None, None, "en"), (1, "", None), (2, " \n\t", "xx"), (3, "long tail " * 20_000, "de"), (4, "a a a a a a a a a a a a a", "rep"), (5, rows[0][1], "en"), (5, rows[0][1], "en")]
    df = spark.createDataFrame([(*r, "1", "2", "3") for r in rows], DOCS).repartition(3)
    want = brute(rows)
    assert found(co.mine(df)) == want and len(want) > 20
    assert found(co.mine(df, bits=64)) == want, "a full bit array only lets more n-grams be counted"
    monkeypatch.setattr(co, "HELD", 50)
    monkeypatch.setattr(co, "HELD_WORDS", 5)
    monkeypatch.setattr(co, "SHARD_WORDS", 100)
    monkeypatch.setattr(co, "LEAST", 10)
    assert found(co.mine(df, least=4, top=7)) == brute(rows, 4, 7)
    assert co.mine(spark.createDataFrame([], DOCS)).count() == 0


def test_filters_are_lossless():
    rnd = np.random.default_rng(1)
    for k, n, bits in ((1, 0, 3), (2, 1, 3), (2, 5000, 3), (3, 5000, 7)):
        ids = [rnd.integers(0, 40, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(k)]
        want = Counter(zip(*(x.tolist() for x in ids)))
        parts = [co.Filter.of(co.spread([x[i::3] for x in ids]), np.ones(len(ids[0][i::3]), dtype=np.int64)) for i in range(3)]
        shards = defaultdict(list)
        for p in parts:
            for shard, data in p.shards(bits):
                shards[shard].append(co.Filter.unpacked(data, shard, bits))
        got = Counter()
        for fs in shards.values():
            f = co.Filter.merged(fs)
            assert (np.diff(f.grams[0].astype(object)) >= 0).all()
            got.update(dict(zip(zip(*(x.tolist() for x in co.spread(f.grams))), f.counts.tolist())))
        assert got == want


def test_filters_with_equal_first_ids_and_large_counts():
    x = [np.array([7, 7, 7, 7], dtype=np.uint64), np.array([2, 1, 2, 1], dtype=np.uint64)]
    f = co.Filter.of(x, np.array([1, 300, 2, 1 << 40]))
    assert f.grams[1].tolist() == [1, 2] and f.counts.tolist() == [300 + (1 << 40), 3]
    ((shard, data),) = f.shards(4)
    back = co.Filter.unpacked(data, shard, 4)
    assert [g.tolist() for g in back.grams] == [g.tolist() for g in f.grams] and back.counts.tolist() == f.counts.tolist()
