"""Repair against a dynamic programme over rows and states with whole edit strings."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from tessera.llm import repair

TURNS = "conv_id long, turn long, role string, text string, pos string, said string, conv string"
SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def damaged(rows):
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fault, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        for _ in range(0 if fault == 0 else 2 if fault == 3 else 1):
            yield conv, turn, "user" if fault == 4 else role, text


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, (role if role is not None else " ").encode(), (text if text is not None else " ").encode()))
    out = {}
    for conv, found in by.items():
        found = [(t, r.decode(), x.decode()) for _, t, r, x in sorted(found)]
        faults, seen, n = [], set(), Counter()
        for _, role, text in found:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            n[fault] += 1
        # Best (cost, edits, rows) from a state, with rows put in; a detour over all states costs at most eight.
        best = {q: min((2 * i, "I" * i, [("user", ""), ("assistant", "")][2 - i :]) for i, p in ((0, ""), (2, "s"), (1, "u"), (0, "a")) if p == q) for q in NEXT}
        for (_, role, text), fault in zip(reversed(found), reversed(faults)):
            now = {}
            for q in NEXT:
                ways = [(best[q][0] + 3, "D" + best[q][1], best[q][2])]
                if fault not in ("blank", "duplicate"):
                    late = fault == "truncated"
                    for i, p in NEXT[q].items():
                        c, a, r = best[p]
                        if role[:1] == i:
                            ways.append((c + late, "K" + a, [(role, text), *r]))
                        if i in "ua":
                            ways.append((c + 2 + late, "R" + a, [({"u": "user", "a": "assistant"}[i], text), *r]))
                now[q] = min(ways)
            for _ in range(3):
                for q in NEXT:
                    for i, p in NEXT[q].items():
                        if i in "ua":
                            c, a, r = now[p]
                            now[q] = min(now[q], (c + 2, "I" + a, [({"u": "user", "a": "assistant"}[i], ""), *r]))
            best = now
        cost, audit, left = best[""]
        turns = {t for (has, t, *_) in sorted((t is not None, t) if t is not None else (False, 0) for c, t, *_ in rows if c == conv) if has}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(found, found[1:])]
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(), left)
    return out


def compared(spark, rows, conversations=()):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS).repartition(3)
    run = repair.Repair(df)
    want = brute(rows)
    ids = spark.createDataFrame([(c, "x") for c in conversations], "conv_id long, conv string")
    got = {r.conv_id: r for r in run.report(ids).collect()}
    assert set(got) == set(want) | set(conversations)
    for conv, w in want.items():
        g = got[conv]
        assert (g.gaps, g.blank, g.duplicate, g.truncated, g.illegal, g.cost, g.audit, g.repaired_sha256) == w[:8], conv
        assert g.repaired == len(w[8])
    for conv in set(conversations) - set(want):
        assert tuple(got[conv])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), 0)
    turns = defaultdict(list)
    for r in run.turns().collect():
        turns[r.conv_id].append((r.turn, r.role, r.text))
    for conv, w in want.items():
        assert [x[1:] for x in sorted(turns[conv])] == w[8] and [x[0] for x in sorted(turns[conv])] == list(range(len(w[8])))


def test_repair_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(8)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user", "assistant"], ["Yes.", "no", "Why?", "", " \t", None, "ok!\n", "é…", "Good.", "cut "]
    rows = []
    for conv in [None, *range(60)]:
        rows += [(conv, rnd.choice([None, i, i, i, i + 3]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"Text {i}{rnd.choice('.!? x')}") for i in range(rnd.randint(1, 9))]
    rows += [(100, i, "user" if i % 2 == 0 else "assistant", f"t {i} " * 3 + ".") for i in range(40)]
    rows += [(101, 5, "assistant", "same.")] * 30 + [(101, None, "user", "again.")] * 3 + [(102, 0, "user", "word " * 50_000 + "."), (102, 1, "assistant", "fin")]
    monkeypatch.setattr(repair, "SEGMENT_BITS", 3)
    compared(spark, rows, [5, 777, None])
    hurt = list(damaged(rows))
    compared(spark, hurt, [r[0] for r in rows])
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)
    assert Counter(map(tuple, repair.damage(df).collect())) == Counter(hurt)
    assert repair.Repair(df.limit(0)).report().count() == 0


def test_blocks_are_single_steps():
    t, rnd = repair.tables(), random.Random(2)
    assert len(t.vectors) < 64 and t.step.shape == (len(t.vectors), repair.SYMBOLS**repair.BLOCK)
    for _ in range(200):
        row = [rnd.randint(1, 9) for _ in range(rnd.randint(1, 14))]
        for v, f in enumerate(t.vectors):
            for s in reversed(row):
                f = repair.before(s, f)
            cost, before, *states = t.summed(row)[v].tolist()
            assert tuple(x + cost for x in t.vectors[before]) == f
            for q in range(4):
                said, end = t.traced(row, v, q), q
                for x in "".join(said):
                    end = end if x == "D" else None if end is None else repair.NEXT.get((end, x.lower() if x in "uaUA" else "?"), end if x != "K" else -1)
                    if end == -1:
                        break
                assert len(said) == len(row) and (end in (-1, states[q]))
