"""Sharding, chat, mixing, personal data, fingerprints against plain Python."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import xxhash

from tessera.llm import chat, fingerprints, mixing, pii, sharding

DOCS = "doc_id long, text string, source string, lang string, n_chars long, shard string, entities string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, None, None, "x", "y") for i, t, s in rows], DOCS).repartition(3)


EDGES = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (None, "one two", "b"), (4, "x " * 30_000, "b"), (5, "same text", "a"), (5, "same text", "a"), (6, "same text", None)]


def test_sharding_is_longest_first(spark):
    rnd = random.Random(1)
    rows = EDGES + [(100 + i, rnd.choice("abc") * rnd.randint(1, 60), "s") for i in range(300)]
    out = [r.asDict() for r in sharding.shard_documents(docs(spark, rows), 16).collect()]
    assert len(out) == len(rows)
    size = Counter()
    for _, t, _ in rows:
        size[t or ""] += len((t or "").encode()) + 1
    loads = [0] * 16
    for n in sorted(size.values(), reverse=True):
        heapq.heappush(loads, heapq.heappop(loads) + n) if loads else None
        heapq.heapify(loads)
    got = Counter()
    for r in out:
        got[r["shard"]] += r["size"]
    assert sorted(got.values()) == sorted(x for x in loads if x)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    where = {}
    for r in out:
        where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(v) == 1 for v in where.values())
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def test_sharding_bundles_small_groups(spark):
    """Thousands of groups below the share of a unit, a few above, one of many copies."""
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 60))) for _ in range(4000)] + ["z" * 3000, "y" * 9000] + ["copy"] * 2000
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    out = sharding.shard_documents(docs(spark, rows), 16, heavy_share=64, bundles=256).collect()
    got, where = Counter(), {}
    for r in out:
        got[r["shard"]] += r["size"]
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert len(out) == len(rows) and all(len(v) == 1 for v in where.values()) and len(got) == 16
    mean = sum(got.values()) / 16
    assert max(got.values()) <= max(mean * 1.05, 5 * 2000)
    assert max(Counter(r["shard"] for r in out).values()) < 4200
    assert sharding.shard_documents(docs(spark, EDGES), 16, heavy_share=1, bundles=1).count() == len(EDGES)


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(5, "a", "s"), (5, "b", "s"), (5, "b", "t"), (None, "c", "s"), (7, None, "s"), (7, "", "s"), (None, None, None)] + [(i, f"text {i % 40}", "s") for i in range(100, 300)]
    df = docs(spark, rows).drop("shard")
    placed = sharding.shard_documents(df, 4)
    sharding.write_shards(df, placed, str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in out) == Counter(rows)
    want = {(r.doc_id, r.text_crc32): set() for r in placed.collect()}
    for r in placed.collect():
        want[r.doc_id, r.text_crc32].add((r.shard, r.slot))
    assert all((r.shard, r.slot) in want[r.doc_id, zlib.crc32((r.text or "").encode())] for r in out) and len({(r.shard, r.slot) for r in out}) == len(rows)


def test_chat_edge_cases(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, n_turns int"
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0
    long = "word <|im_end|> " * 30_000
    rows = [(7, 0, "user", long, "x", 1), (7, 1, "assistant", long, "y", 2)]
    r = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, schema))).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(long), hashlib.sha256(long.encode()).hexdigest())


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "<\\|x", "<\\\\|", "a\nb", "", None, "<|im_start|>assistant\nno<|im_end|>\n", "<|<|", "é😀"]
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate([("system", "s"), ("user", odd[2]), ("assistant", odd[0]), ("us%0A\ner", odd[6]), ("assistant", odd[1]), ("assistant", None), (None, odd[7])])]
    rows += [(3, i, "user", x) for i, x in enumerate(odd)] + [(4, 0, "assistant", odd[8]), (4, 0, "assistant", odd[8])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    for conv in (1, 2, None, 3, 4):
        mine = [(r or "", x or "") for c, t, r, x in rows if c == conv]
        loss = "".join(x for r, x in mine if r == "assistant")
        g = got[conv]
        assert g.n_turns == len(mine)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    ex = chat.expand_examples(chat.format_conversations(turns.filter("conv_id = 1"))).orderBy("example").collect()
    assert len(ex) == 3 and all(b.text.startswith(a.text) for a, b in zip(ex, ex[1:]))


def test_mixing_shards_hold_the_mix(spark):
    rnd = random.Random(3)
    df = docs(spark, [(i, "w " * rnd.randint(1, 400), rnd.choice("aaab")) for i in range(900)] + [(5000, "tiny one", "z")])
    out = mixing.mix(df)
    spans = [(r.source, s) for r in out.collect() for s in r.spans if s["times"]]
    assert all(len(s["shards"]) == s["times"] and all(0 <= x < mixing.SHARDS for x in s["shards"]) for _, s in spans)
    shares = {(r.shard, r.source): r.words for r in mixing.quotas(out).collect()}
    assert sum(shares.values()) == sum(r.taken for r in out.select("taken").collect())
    mean = sum(shares.values()) / mixing.SHARDS
    of = Counter()
    for (shard, _), n in shares.items():
        of[shard] += n
    assert len(of) == mixing.SHARDS and max(of.values()) < 1.1 * mean and min(of.values()) > 0.9 * mean
    a = [shares[i, "a"] for i in range(mixing.SHARDS)]
    assert max(a) - min(a) <= 0.1 * mean, "each shard has its quota of a source"


def test_mixing_near_targets(spark):
    rnd = random.Random(2)
    rows = EDGES + [(100 + i, "w " * rnd.randint(0, 90), rnd.choice(["a", "b", "c", None, "é"])) for i in range(600)]
    df = docs(spark, rows)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    words = Counter()
    for _, t, s in rows:
        words[s] += len((t or "").split())
    order = sorted((s for s in words if s is not None)) + [None]
    cap = {s: 2.0 * words[s] for s in order}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free, left = set(order), 1.5 * sum(words.values())
    while True:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > cap[s]}
        if not above:
            break
        free -= above
        left -= sum(cap[s] for s in above)
    target = {s: level * weight[s] if s in free else cap[s] for s in order}
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size and abs(r.target - target[r.source]) < 1e-6 and r.source_size == words[r.source]
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 20 for s in order)
    key = lambda x: sorted((r.doc_id or -1, r.size, r.taken) for r in x)
    assert key(out) == key(mixing.mix(df.repartition(5)).collect())
    assert mixing.mix(docs(spark, [])).count() == 0
    try:
        mixing.take_pieces(df.withColumn("mix_pass", mixing.F.lit(1)))
        raise AssertionError("a clashing name was taken")
    except ValueError:
        pass
    pieces = mixing.take_pieces(df).collect()
    assert abs(sum(len(r.text.split()) for r in pieces) - 1.5 * sum(words.values())) < 0.05 * sum(words.values())


def test_mixing_takes_small_sources(spark):
    """Sources of under half a block, of less than one and of a few blocks beside large ones."""
    sizes = {"a": 400_000, "b": 150_000, "c": 11, "d": 17, "e": 40, "f": 3, "g": 95, "h": 700, "i": 1, None: 21}
    rows, n = [], 0
    for s, size in sizes.items():
        step = 5_000 if size > 100_000 else max(1, size // 4)
        for a in range(0, size, step):
            n += 1
            rows.append((n, " ".join(f"w{n}-{i}" for i in range(min(step, size - a))), s))
    df = docs(spark, rows)
    taken, target = Counter(), {}
    for r in mixing.mix(df).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and sum(s.times * (s.high - s.low) for s in r.spans) == r.taken
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 0.5 for s in sizes), (taken, target)
    pieces = Counter()
    for r in mixing.take_pieces(df).collect():
        pieces[r.source] += len(r.text.split())
    assert pieces == +taken


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    out = []
    for o, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, t):
            d = re.sub("[^0-9]", "", m.group())
            bad = {"email": False, "ip": any(int(p) > 255 for p in m.group().split(".")) if kind == "ip" else False, "card": not (14 <= len(d) <= 19 and luhn(d)), "phone": not 10 <= len(d) <= 15}
            if not bad[kind]:
                out.append((m.start(), o, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_personal_data_equals_plain_patterns(spark):
    rnd = random.Random(3)
    bits = ["a@b.c", "@", ".", "..", "x", "1", "12", "255", "256", "0001", "-", " ", "  ", "+", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1111", "é", "\n", "a@b", "+1 (212) 555-0100", "_", "%", "b.c-d", "😀", "1.2.3.4", "378282246310005"]
    texts = [None, "", " "] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25))) for _ in range(600)] + ["1" * 30_000, "a." * 20_000 + "@" + "b." * 20_000 + "c", "1 " * 20_000, "4111111111111111 é " * 700]
    key = "9abc9ff9ca9fb9e9c999a9eb99999999a999bdde"
    added = {
        "DE89 3704 0044 0532 0130 00": "iban:0:27", "ssn 123-45-6789": "ssn:4:15", "123-45-6789": "", "pay DE89 3704 0044 0532 0130 00 NOW": "iban:4:31", "DE89370400440532013000 AND GO": "iban:0:22",
        "GB82WEST12345698765432": "iban:0:22", "DE89 3704 0044 0532 0130 01": "", "serial DE89370400440532013000": "", "bank serial DE89370400440532013000": "iban:12:34", "DE8937040044053201300": "",
        f'TOKEN = "{key}"': "secret:9:49", key: "", f"commit token {key}": "", "token aaaaaaaaaaaaaaaaaaaaaaaaaaaa": "", "order ssn 123-45-6789": "",
    }
    texts += added
    got = {r.doc_id: r for r in pii.report(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(got[i].spans.split(",")) | {""}
    assert {t: got[len(texts) - len(added) + i].spans for i, t in enumerate(added)} == added
    assert all(r.n_spans == len(r.spans.split(",")) * bool(r.spans) == len(r.scores.split(",")) * bool(r.scores) for r in got.values())
    assert pii.report(docs(spark, [])).count() == 0
    try:
        pii.find(docs(spark, []))
        raise AssertionError("a clashing output name was taken")
    except ValueError:
        pass
    row = pii.find(docs(spark, [(1, "to a@b.de or +1 (212) 555-0100!", "s")]).drop("entities")).select(pii.redact(pii.F.col("text"), pii.F.col("entities")).alias("t")).first()
    assert row.t == "to [EMAIL] or [PHONE]!"


def spark_hash(x, at=None):
    """The engine's 64-bit hash of a word, or of a long."""
    return xxhash.xxh64_intdigest(x if at is None else ((x ^ at) & (1 << 64) - 1).to_bytes(8, "little"), seed=42)


def signature(text):
    """For each sample the (term, t) of least a, every weighted term drawn for, and that a."""
    out = []
    terms = [(spark_hash(w.encode()), 1 + math.log(n)) for w, n in Counter((text or "").split()).items()]
    for k in range(fingerprints.SAMPLES if terms else 0):
        best = None
        for h, w in terms:
            x, y, z = (spark_hash(h, s) for s in fingerprints.salts(k))
            high, low = (lambda q: ((q >> 33) + 0.5) / 2**31), (lambda q: ((q & 2**31 - 1) + 0.5) / 2**31)
            rb, rest, c = -math.log(low(z)), -math.log(high(x)), -math.log(high(y) * low(y))
            r, b = rb + rest, rb / (rb + rest)
            t = math.floor(math.log(w) / r + b)
            best = min(best or (math.inf,), (c * math.exp(-r * (t - b + 1)), h, t))
        out.append(best[1:])
    return out


def test_fingerprints_equal_brute_force_sampling(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = EDGES[:4] + [(-(2**63), "low end " * 9, "s"), (2**63 - 1, "high end", "s")] + [(1000 + i, " ".join(rnd.choice(vocabulary[: rnd.choice([20, 900])]) for _ in range(rnd.randint(0, 120))), "s") for i in range(60)]
    out = fingerprints.compare_edited(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    text = {i: t or "" for i, t, _ in rows}
    order = sorted((i for i in text if i is not None)) + [None]
    following = dict(zip(order, order[1:] + order[:1]))

    def alike(a, b):
        return 1.0 if not a and not b else sum(x == y for x, y in zip(a, b)) / fingerprints.SAMPLES

    for r in out:
        t, nxt = text[r.doc_id], text[following[r.doc_id]]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
        assert (r.near_edited, r.near_next) == (alike(signature(t), signature(edited)), alike(signature(t), signature(nxt)))
        assert len(r.fingerprint) == (6 * fingerprints.SAMPLES if t.split() else 0)


def test_fingerprints_estimate_generalised_jaccard(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = EDGES + [(1000 + i, " ".join(rnd.choice(vocabulary[: rnd.choice([50, 900])]) for _ in range(rnd.randint(0, 500))), "s") for i in range(150)]
    out = fingerprints.compare_edited(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    order = sorted((i for i, _, _ in rows if i is not None)) + [None]
    text = {i: t or "" for i, t, _ in rows}
    following = {a: b for a, b in zip(order, order[1:] + order[:1]) if a != b}

    def weights(t):
        return {k: 1 + math.log(v) for k, v in Counter(t.split()).items()}

    def alike(a, b):
        a, b = weights(a), weights(b)
        total = sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
        return sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / total if total else 1.0

    errors = []
    for r in out:
        if r.doc_id == 5:
            continue
        t, nxt = text[r.doc_id], text[following[r.doc_id]]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
        errors += [r.near_edited - alike(t, edited), r.near_next - alike(t, nxt)]
    assert abs(sum(errors) / len(errors)) < 0.02 and math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.1
    assert fingerprints.compare_edited(docs(spark, [])).count() == 0
    assert len({r.fingerprint for r in out if r.doc_id in (5, 6)}) == 1
    by_id = fingerprints.fingerprint(docs(spark, rows).filter("doc_id > 5").withColumn("h2", fingerprints.F.lit(1)), ["doc_id"])
    assert {r.doc_id: fingerprints_text(r.codes) for r in by_id.collect()} == {r.doc_id: r.fingerprint for r in out if (r.doc_id or 0) > 5}
    try:
        fingerprints.fingerprint(docs(spark, []).withColumnRenamed("doc_id", "H"), ["H"])
        raise AssertionError("a clashing key name was taken")
    except ValueError:
        pass


def fingerprints_text(codes):
    return "".join(f"{c:06x}" for c in codes)


def test_ranges_follow_rows_not_values(spark):
    """Outlying ids leave the others spread over many ranges."""
    ids = [-(2**62), *range(3000), 2**62, None]
    df = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string").repartition(3)
    out = fingerprints.with_next(df, fingerprints.F.xxhash64("text")).filter("edge = 0").collect()
    assert max(Counter(r.rng for r in out).values()) <= 2 * len(ids) / (len(ids) // fingerprints.RANGE_ROWS)
    assert {r.doc_id: r.nxt.doc_id for r in out} == dict(zip(ids, ids[1:] + ids[:1]))
