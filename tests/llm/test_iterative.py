"""BPE, substring dedup, Jaccard join, neighbours, language and pipeline against plain Python."""

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import Window, functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, jaccard_join, language, neighbours, substring_dedup
from tessera.llm.staging import Stage

PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"


def test_bpe_equals_the_library(spark):
    lib, own, rnd = Tokenizer.from_file(PATH), bpe.WordBpe(bpe.read_vocabulary(PATH)), random.Random(1)
    texts = ["", "ΑΣ Σας", "don't I'LL", "a<|endoftext|>b <|STARTOFTEXT|><|startoftext|>", "x²½ ٣٤ 三四 ﬁ İst ſ z\x85q\x1cw", "a" * 5000, "ab" * 3000 + " é" * 10, "😀\U0001f468‍\U0001f469", "_a_b__ 12"]
    texts += ["".join(rnd.choice(["a", "'", "'s", " ", "é", "É", "_", "1", "²", "\n", "ß", "<|endoftext|>", "Σ", "the", "ing", "́", "."]) for _ in range(rnd.randint(0, 20))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    spec = bpe.read_vocabulary(PATH)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, spec), spec).collect()}
    for i, t in enumerate([*texts, ""]):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got[i].token_ids, "<u4").tolist() == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == lib.decode(ids, skip_special_tokens=False)
    parts = [own.inner[rnd.choice(b"thein")] for _ in range(400)]
    assert own.by_scan(parts[:]) == own.by_heap(parts[:])
    with pytest.raises(ValueError):
        bpe.encode(df.withColumnRenamed("doc_id", "N_tokens"), spec)
    with pytest.raises(ValueError):
        bpe.encode(df, bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    twice = df.filter("doc_id = 2").unionByName(df.filter("doc_id = 2"))
    assert bpe.decode(bpe.encode(twice, spec), spec).count() == 2 and bpe.decode(bpe.encode(df.limit(0), spec), spec).count() == 0


def test_bpe_worker_holds_little():
    """Words that nearly all differ fill the cache as far as it goes; what a worker allocates stays small."""
    rnd = random.Random(3)
    texts = [" ".join(f"{rnd.choice('abcdefgh')}{rnd.getrandbits(40):x}".translate(str.maketrans("0123456789", "ghijklmnop")) + rnd.choice([",", ".", ""]) for _ in range(300)) for _ in range(2000)]
    own, batch = bpe.WordBpe(bpe.read_vocabulary(PATH)), pa.record_batch([pa.array(texts)], names=["text"])
    tracemalloc.start()
    try:
        for b in bpe.slices(batch, "text"):
            own.encode_many(b.column("text").to_pylist())
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40e6, most


def test_bpe_words_of_many_texts():
    """The words of plain texts found at once are those that the pattern finds in each."""
    rnd = random.Random(4)
    bits = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "r", "l", "v", "e", "é", "×", "÷", "À", "ž", "¡", "®", "­", "_", "1", "23", " ", "\n", "!", "ab", "'RE", "\x0b", "\x00", "\x7f", "'sé"]
    for _ in range(3000):
        texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 12))) for _ in range(rnd.randint(1, 4))]
        coded, last = bpe.plain_words(bpe._BETWEEN.join(texts).lower().encode())
        want = [bpe._WORDS.findall(t.lower()) for t in texts]
        assert coded.to_pylist() == [w for x in want for w in x]
        assert last.tolist() == np.cumsum([len(x) for x in want]).tolist()


def repeats(rows):
    first, words = {}, [(t or "").encode().split() for _, t in rows]
    last = 1 << 62
    for (d, _), w in zip(rows, words):
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            first[k] = min(first.get(k, last), last - 1 if d is None else d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < (last - 1 if d is None else d) for q in range(p, p + 50)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=str)


def test_substrings(spark):
    rnd = random.Random(5)
    base = [[rnd.choice("abcdefgh") for _ in range(120)] for _ in range(4)]
    rows = []
    for _ in range(150):
        w = []
        for _ in range(rnd.randint(0, 4)):
            a = rnd.randint(0, 60)
            q = list(rnd.choice(base))[a : a + rnd.randint(20, 120)]
            if rnd.random() < 0.3:
                q[rnd.randrange(len(q))] = f"z{rnd.randint(0, 3)}"
            w += q
        rows.append((rnd.choice([None, *range(120)]), " ".join(w) if rnd.random() > 0.05 else None))
    rows += [(999, "x " * 300), (998, "x " * 200), (997, "\x0bx\x1cy\xa0z " * 80), (1000, "\x0bx\x1cy\xa0z " * 80)]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, grp string, at int").repartition(5)
    for words in (500_000, 400, 60):
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.drop_repeats(df, group_words=words).collect()), key=str)
        assert got == repeats(rows)
    assert substring_dedup.drop_repeats(df.limit(0)).count() == 0
    long = " ".join(f"w{i % 700}" for i in range(60_000))
    rows = [(1, long), (2, "a b c " + long[: len(long) // 2]), (3, "same " * 20_000), (4, "same " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.drop_repeats(df, group_words=5000).collect()), key=str) == repeats(rows)


def classes(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            x = len(a & sets[j])
            if x and 100 * x >= 75 * (len(a) + len(sets[j]) - x):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            least[root(i)] = min(least.get(root(i), 1 << 62), d)
    return sorted((d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def family(seed, n=260):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.choice([6, 9, 30, 80]))] for _ in range(8)]
    boiler = [rnd.choice(vocabulary) for _ in range(25)]
    rows = []
    for i in range(n):
        b = list(rnd.choice(bases[: rnd.choice([1, 8])]))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6, 10])):
            k = rnd.randrange(len(b))
            b = b[:k] + [rnd.choice(vocabulary[:20])] + b[k + 1 :] if rnd.random() < 0.6 else b[:k] + b[k + 1 :] or ["z"]
        b += boiler if rnd.random() < 0.3 else []
        rows.append((i, " ".join(b).upper() if rnd.random() < 0.3 else " ".join(b)))
    return rows + [(1000, None), (1001, ""), (1002, " \n "), (1003, "a b"), (1004, "A b"), (1005, "a c")]


def test_jaccard_classes(spark):
    rows = family(1)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, node int, key int").repartition(4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_texts(df).collect()) == classes(rows)
    kept = sorted(r.doc_id for r in jaccard_join.keep_one(df).collect())
    assert kept == sorted(d for d, n, c in classes(rows) if d == c)
    assert jaccard_join.join_texts(df.limit(0)).count() == 0


def overlapping(n, seed=3):
    """Texts of 8 of 18 paragraphs: most pairs overlap by 0.2 to 0.5, hardly any is linked."""
    rnd = random.Random(seed)
    paragraphs = [[f"p{i}w{j}" for j in range(12)] for i in range(18)]
    return [(i, " ".join(w for k in rnd.sample(range(18), 8) for w in paragraphs[k])) for i in range(n)]


def test_jaccard_overlapping_texts(spark):
    rows = overlapping(300)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_texts(df).collect()) == classes(rows)


def test_jaccard_shingle_common_to_all(spark):
    rows = [(i, f"one two three four five {i} " + " ".join(f"w{i}x{j}" for j in range(3 + i % 40))) for i in range(150)] + [(500, "one two three four five"), (501, "ONE two three four five")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_texts(df).collect()) == classes(rows)


def test_jaccard_null_and_repeated_ids(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(None, words), (None, words + " x"), (3, words), (3, words), (3, "lone text of six words here"), (9, words.upper()), (9, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_texts(df).collect()), key=str)
    assert got == sorted([(None, 56, 3), (None, 57, 3), (3, 56, 3), (3, 56, 3), (3, 2, 3), (9, 56, 3), (9, 0, 9), (None, 0, None)], key=str)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)] + [(2000, None, None), (2020, [0.0] * 16, None), (2040, [float("nan")] * 16, None), (2060, [1.0, None] * 8, None), (2080, [1.0], None), (2100, [], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string").repartition(3)
    got = {}
    for r in neighbours.nearest(df, lambda c: c % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    y, hits = x.astype(float), 0
    for q, found in got.items():
        s = y @ y[q]
        best = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        hits += len(set(best) & {f[1] for f in found})
    assert hits >= 0.9 * 20 * len(got)
    few = {(r.query_id, r.vec_id) for r in neighbours.nearest(df.filter("vec_id < 3"), lambda c: c >= 0).collect()}
    assert few == {(a, b) for a in range(3) for b in range(3) if a != b}
    assert neighbours.nearest(df.limit(0), lambda c: c >= 0).count() == 0


@pytest.mark.parametrize("away", [1, 8])
def test_neighbours_off_the_main_cone(spark, away):
    """A lone vector, or a few, opposite to all others fall into a small block at every start."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2600, 16)) * 0.003
    x[:, 0] += 4
    group = [1000 + 20 * i for i in range(away)]
    x[group, 0] -= 8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in neighbours.nearest(df, lambda c: c % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    hits = 0
    for q in range(0, 2600, 20):
        assert sorted(f[0] for f in got.get(q, [])) == list(range(1, 21)), q
        best = [i for i in np.lexsort((np.arange(len(x)), -(x @ x[q]))) if i != q][:20]
        hits += len(set(best) & {f[1] for f in got[q]})
        if q in group:  # the others of the group come first
            assert {f[1] for f in got[q] if f[0] < away} == set(group) - {q}
    assert hits >= 0.9 * 20 * len(got)


def test_neighbours_complete_short_lists(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 4))
    nodes = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "node long, body binary").repartition(3)
    no_edges = spark.createDataFrame([], neighbours.GRAPH)
    out = neighbours.search(nodes.filter("node < 270").select("node"), nodes, no_edges, Stage(spark, "test"), 4)
    best = Window.partitionBy("node").orderBy(F.desc("s"))
    rows = out.withColumn("nth", F.row_number().over(best)).filter("nth <= 21").collect()
    got = {}
    for r in rows:
        got.setdefault(r.node, []).append(r.w)
    assert len(got) == 270 and all(set(w) == set(np.argsort(-(x @ x[q]))[:21].tolist()) for q, w in got.items())


def plain_trigrams(text):
    """Trigrams of lower-cased letters, runs of anything else being one blank, as one dictionary of counts."""
    t = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in t:
        t = t.replace("  ", " ")
    return [t[i : i + 3] for i in range(len(t) - 2)] if t.strip() else []


def test_language_equals_brute_force(spark):
    """Counts, expectation-maximisation run out, and every set of languages that growing could reach."""
    rnd = random.Random(6)
    alphabets = {"xx": "abcde fgh", "yy": "abcfgh klm", "zz": "kmnop qab"}
    make = lambda k, n: "".join(rnd.choice(alphabets[k]) for _ in range(n))
    learn = [(i, make(k, rnd.randint(40, 400)), k) for i, k in enumerate(list(alphabets) * 12)]
    df = spark.createDataFrame(learn + [(900, None, "xx"), (901, "abc", None)], "doc_id long, text string, lang string").repartition(3)
    names, model = language.fit(df)
    assert names == sorted(alphabets)
    counts = np.full((3, language.BUCKETS), language.ALPHA)
    for _, t, k in learn:
        for h in (language.trigrams(t)):
            counts[names.index(k), h] += 1
        assert len(language.trigrams(t)) == len(plain_trigrams(t))
    assert np.allclose(model, counts / counts.sum(axis=1, keepdims=True))

    def run_out(p, n):
        w = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(20_000):
            w = (n[:, None] * (p * w) / (p @ w)[:, None]).sum(axis=0) / n.sum()
        return w, float(n @ np.log(p @ w))

    for text in [make("xx", 300), make("xx", 200) + make("zz", 200), make("xx", 300) + make("yy", 300) + make("zz", 300), make("yy", 9), "ab", "?"]:
        h = language.trigrams(text)
        got = language.mixture(text, model.T)
        if not len(h):
            assert got == []
            continue
        at, n = np.unique(h, return_counts=True)
        p, n = model.T[at], n.astype(float)
        chosen, best = [], -np.inf
        while len(chosen) < 3:
            like, k = max((run_out(p[:, [*chosen, k]], n)[1], -k) for k in range(3) if k not in chosen)
            if chosen and like - best <= language.PENALTY * np.log(n.sum() + 1):
                break
            chosen, best = [*chosen, -k], like
        w = run_out(p[:, chosen], n)[0]
        assert {k for k, _ in got} == set(chosen)
        assert all(abs(share - w[chosen.index(k)]) < 0.01 for k, share in got) and abs(sum(s for _, s in got) - 1) < 1e-9


def test_language_edge_cases(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    fitted = language.fit(docs)
    rows = [(1, "le chat est sur la table " * 9000, "zz", 1), (1, "le chat est sur la table " * 9000, "zz", 1), (None, "12", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, shares int")
    out = language.predict(df, *fitted).collect()
    assert [r.lang_pred for r in sorted(out, key=lambda r: str(r.doc_id))] == ["fr", "fr", "und"] and all(0 <= r.score <= 1 for r in out)
    assert language.identify(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        language.predict(df.withColumnRenamed("shares", "Score"), *fitted)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = language.identify(docs).filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 !!", "en"), (4, "the cat", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language.predict(odd, *language.fit(docs)).collect() if r.doc_id < 4} == {1: "und", 2: "und", 3: "und"}
    assert {r.lang_pred for r in language.predict(odd, *language.fit(odd.limit(0))).collect()} == {"und"}
    names, model = language.fit(docs)
    de, fr = (docs.filter(f"lang = '{k}'").orderBy("doc_id").first().text for k in ("de", "fr"))
    assert {names[k] for k, _ in language.mixture(de[:1500] + " " + fr[:1500], model.T)} == {"de", "fr"}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = corpus_pipeline.run(spark, DATA).collect()
    keep = {d for d, _, c in classes(rows) if d == c}
    assert {r.doc_id for r in out} <= keep and len({r.doc_id for r in out}) > 0.8 * len(keep)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "private_data", "mixing", "encoding"]
    assert all(r.n_tokens == len(r.token_ids) // 4 for r in out)


def test_pipeline_edge_cases(spark, tmp_path):
    """Each stage's decision on nulls, empty and very long texts, repeated rows and clashing extra columns."""
    long = " ".join(f"the word number {i} of a very long english text" for i in range(9000))
    learn = [(100 + i, f"the cat sat on the mat number {i} and the dog ran home with it again", "en", "a", 1) for i in range(12)]
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "12 34 !!", "en", "a", 0), (4, long, None, None, 0), (5, "write to a@b.example now please, the mail is open", "en", "b", 0), (5, "write to a@b.example now please, the mail is open", "en", "b", 0), (None, "a text without an id is still a text of words", "en", "b", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node int, mix_pass int, entities string, token_ids int"
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in learn + rows], schema)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = df, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    ids = lambda name: sorted({r.doc_id for r in seen[name]}, key=str)
    assert {1, 2, 3}.isdisjoint(ids("language")) and {4, 5, None} <= set(ids("language")) and len([r for r in seen["language"] if r.doc_id == 5]) == 2
    assert len([r for r in seen["near_duplicates"] if r.doc_id == 5]) == 1 and {4, None} <= set(ids("near_duplicates"))
    assert any("[EMAIL]" in r.text for r in seen["private_data"]) and next(r for r in seen["private_data"] if r.doc_id == 4).text == long
    assert all(r.n_tokens == len(r.token_ids) // 4 > 0 for r in seen["encoding"]) and seen["encoding"][0].asDict().keys() == {"doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids"}
    empty = str(tmp_path / "empty")
    df.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_neighbours_clustered_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((30, 12)) * 2
    x = centres[rng.integers(0, 30, 1500)] + 0.3 * rng.standard_normal((1500, 12))
    x[200:700] = x[200]
    ids = [i if i != 41 else 40 for i in range(1500)]  # one id stands on two rows
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, score int").repartition(3)
    got = {}
    for r in neighbours.nearest(df, lambda c: c % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in [i for i in range(0, 1500, 20) if i != 40]:
        s = x @ x[q]
        best = sorted(((-s[j], i) for j, i in enumerate(ids) if i != q))[:20]
        assert [f[0] for f in sorted(got[q])] == list(range(1, 21))
        hits += len({round(-b[0], 9) for b in best} & {round(f[2], 9) for f in got[q]}) / len({round(-b[0], 9) for b in best})
    assert hits >= 0.9 * 74


def test_neighbours_with_hubs(spark, monkeypatch):
    """A few long vectors are near to all others: their pieces go to tasks beside the parts, and nothing is lost."""
    monkeypatch.setattr(neighbours, "LANE", 2)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2400, 10)) * np.exp(0.7 * rng.standard_normal((2400, 1)))
    x[:4] *= 30
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in neighbours.nearest(df, lambda c: c % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & set([i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:20])) for q in range(0, 2400, 20))
    assert hits >= 0.9 * 20 * 120


def test_neighbours_parts_follow_the_bytes():
    assert neighbours._sized(neighbours.PART, 64) == neighbours.PART == neighbours._sized(neighbours.PART, 8)
    assert neighbours._sized(neighbours.PART, 1536) * 1536 <= neighbours.PART * 64 and neighbours._sized(256, 10**6) == 16
