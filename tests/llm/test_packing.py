"""Packing against the tokenizer library and a sum of squares counted afresh."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.queries import vocabulary

DOCS = "doc_id long, text string, length string, sequence_id string"


def ids(n, rnd):
    return np.array([rnd.randrange(49_000) for _ in range(n)], dtype="<u4")


def test_levels_minimise_the_sum_of_squares():
    rnd = random.Random(4)
    packer, counts = packing.Packer(50), Counter()
    for i in range(800):
        size = rnd.choice([7, 13, rnd.randint(1, 49)])
        best = []
        for h in [0, *sorted(h for h in counts if counts[h])]:
            if h + size <= 50:
                after = Counter(counts)
                after[h] -= h > 0
                after[h + size] += h + size < 50
                best.append((sum(n * n for n in after.values()), -h))
        want = -min(best)[1]
        assert packer.level(size) == want
        counts[want] -= want > 0
        counts[want + size] += want + size < 50
        list(packer.place((i, 0, ids(size, rnd), size)))
        assert {h: n for h, n in counts.items() if n} == {h: int(n) for h, n in enumerate(packer.counts) if n}


def test_windows_of_one_size_are_cut_open():
    rnd = random.Random(5)
    packer, out = packing.Packer(64, most_open=20), []
    docs = [ids(40, rnd) for _ in range(500)]
    for i, x in enumerate(docs):
        out.extend(packer.add(i, x))
        assert packer.opened == packer.counts.sum() == sum(map(len, packer.windows.values())) <= 20
    out.extend(packer.finish())
    whole(out, docs, 64)
    assert list(packing.Packer(8).finish()) == []


def whole(out, docs, capacity):
    """Each id in one piece, offsets without gaps, no sequence padded by more than it must be."""
    pieces, windows = defaultdict(list), defaultdict(list)
    for doc, start, x, total, seq, offset in out:
        assert total == len(docs[doc]) and len(x)
        pieces[doc].append((start, x.tolist()))
        windows[seq].append((offset, len(x)))
    for doc, x in enumerate(docs):
        assert [i for _, p in sorted(pieces[doc]) for i in p] == x.tolist()
    padding = 0
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0


def test_packs_whole_documents(spark):
    rnd = random.Random(6)
    texts = [None, "", " \n ", "word " * 30_000, "İstanbul ½ <|endoftext|> x"] + [" ".join(rnd.choice(["alpha", "béta", "don't", "12,5", "…"]) for _ in range(rnd.randint(1, 1500))) for _ in range(60)]
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)] + [(None, "no id", "a", "b"), (7, texts[7], "a", "b")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    out = packing.pack(df, vocabulary())
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in [*enumerate(texts), (None, "no id")]}
    got, seen = out.collect(), Counter()
    for r in got:
        piece = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and r.token_ids == np.array(piece, dtype="<u4").tobytes() and 0 < r.length <= 2048
        seen.update((r.doc_id, r.start + i) for i in range(r.length))
    assert seen == Counter({(d, i): 2 if d == 7 else 1 for d, x in want.items() for i in range(len(x))})
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [sum(n for _, n in w[:i]) for i in range(len(w))]
    most = packing.layout(out).agg({"padding": "sum", "filled": "max"}).first()
    assert (most["sum(padding)"], most["max(filled)"]) == (0, 2048)
    assert packing.pack(spark.createDataFrame([], DOCS), vocabulary()).count() == 0
