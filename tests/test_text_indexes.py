"""Fuzzy keys against all pairs; ranked retrieval against the full sort, with its reads counted."""

import datetime
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import fuzzyindex, rankedindex, textindex


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_index_finds_all_pairs(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.choice([0, 1, 2, 3, 5, 7, 9, 11, 14, 18, 22])))
    queries = sorted({word() for _ in range(60)})

    def near(w):
        w = list(w)
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randint(0, len(w))
            w[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "x"])
        return "".join(w)

    terms = sorted({word() for _ in range(80)} | {near(q) for q in queries for _ in range(3)})
    one = lambda rows, name: spark.createDataFrame([(x,) for x in [*rows, None, rows[0]]], f"{name} string")
    stored = fuzzyindex.index(one(terms, "term"))
    got = {(r.term, r.query): r.distance for r in fuzzyindex.search(stored, one(queries, "query")).collect()}
    want = {(t, q): d for t in terms for q in queries if q and t and (d := edits(t, q)) <= max(2, int(len(q) * 0.3))}
    assert {k: v for k, v in got.items() if k[0] and k[1]} == want and len(want) > 150
    far = "z" * 9
    assert fuzzyindex.candidates(stored, one([far], "query")).filter("query = 'zzzzzzzzz'").count() == 0
    assert fuzzyindex.index(one(terms, "term").limit(0)).count() == 0


def test_ranked_reads_few_blocks(spark, tmp_path):
    rnd = random.Random(6)
    now = datetime.datetime(2024, 2, 1)
    files = [(f"/f{i}", " ".join(rnd.choices(["alpha", "beta", "gamma", "delta"], [1, 1 + i % 7, 9, 3], k=rnd.randint(1, 60)))) for i in range(600)]
    docs = spark.createDataFrame(files, "path string, content string")
    meta = docs.select("path", F.length("content").alias("n_chars"), F.length("content").alias("size"), F.when(F.crc32("path") % 9 > 0, F.date_sub(F.lit(now.date()), (F.crc32("path") % 120).cast("int"))).alias("modified"), F.when(F.crc32("path") % 3 == 0, "en").otherwise("fr").alias("language"))
    postings = textindex.postings(docs)
    index = rankedindex.Index(spark, f"file://{tmp_path}/index").save(postings, meta, size=8)
    for query, limit, language in (("alpha", 5, None), ("alpha beta", 12, "en"), ("gamma", 1, "fr"), ("alpha delta", 2000, None), ("missing", 3, None)):
        want = [tuple(r) for r in textindex.search(postings, meta, query, F.lit(now), language, limit).collect()]
        assert [tuple(r) for r in index.search(query, now, limit, language).collect()] == want
        if limit == 5:
            assert 0 < index.reads.blocks < index.reads.of / 3
        assert (index.reads.blocks == index.reads.of) or limit < 2000
    first = index.cached("alpha", now, 5).collect()
    assert index.cached("alpha", now, 5).collect() == first and (index.hits, index.misses) == (1, 1)
    index.cached("alpha", now, 6), index.cached("alpha", now + datetime.timedelta(days=1), 5)
    assert (index.hits, index.misses) == (1, 3)
    index.save(postings.filter("path <> '/f1'"), meta)
    assert index.version() == 2
    index.cached("alpha", now, 5, kept=2)
    assert (index.hits, index.misses) == (1, 4)
    assert len(list((tmp_path / "index" / "results").iterdir())) == 2


def test_a_frequent_term_is_many_cells(spark):
    postings = spark.range(2000).selectExpr("'w' AS term", "concat('/', id) AS path", "1 AS n")
    meta = spark.range(2000).selectExpr("concat('/', id) AS path", "10 + id % 5 AS n_chars", "100 AS size", "DATE '2024-01-01' AS modified", "'en' AS language")
    b = rankedindex.blocks(postings, meta, 4)
    assert b.agg(F.sum("filled"), F.max("filled"), F.count_distinct("block"), F.count("*")).first()[:2] == (2000, 4)
    assert b.select("block").distinct().count() == b.count() and b.filter("size(rows) <> filled").count() == 0


def test_postings_shuffle_texts_alone(spark):
    """F8 to F10: one exchange, by path; a path that comes twice is one file."""
    docs = spark.createDataFrame([("/a", "Alpha beta alpha"), ("/b", None), ("/a", "beta the of"), ("/c", "")], "path string, content string")
    p = textindex.postings(docs)
    assert {tuple(r) for r in p.collect()} == {("alpha", "/a", 2), ("beta", "/a", 2)}
    plan = textindex.postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(path" in plan


def test_blocks_are_made_where_files_lie(spark):
    """postings are neither shuffled nor sorted by term, from postings as from texts; both give the same postings."""
    rnd = random.Random(7)
    odd = [("/a", "Alpha beta ALPHA"), ("/a", "beta_1 the of"), ("/b", None), ("/c", ""), ("/d", "gamma"), ("/e", "gammagamma"), (None, "gamma delta"), ("/f", "naïve stra\u00dfe 日本語abc xyz9 ab \u212aelvin I\u0307"), ("/g", "a an of  "), ("/h", "\n\tone--two__three...one")]
    files = odd + [(f"/r{i}", "".join(rnd.choices("abé _-9Z", k=rnd.randint(0, 300)))) for i in range(300)]
    docs = spark.createDataFrame(files, "path string, content string")
    meta = docs.select("path").distinct().select("path", (F.crc32("path") % 50).cast("int").alias("n_chars"), F.when(F.crc32("path") % 5 > 0, F.crc32("path") % 20000).alias("size"), F.lit(datetime.date(2024, 1, 1)).alias("modified"), F.lit(None).cast("string").alias("language"))
    of = lambda b: b.select("term", "bound", "filled", F.explode("rows").alias("r")).select("term", "bound", "filled", "r.*")
    postings = textindex.postings(docs)
    by_file, by_posting = rankedindex.blocks_of_files(docs, meta, 4), rankedindex.blocks(postings, meta, 4)
    want = sorted(map(tuple, postings.filter("path IS NOT NULL").select("path", "term", "n").collect()))
    for b in by_file, by_posting:
        assert b.schema == by_file.schema
        rows = of(b).withColumn("impact", rankedindex.impact()).collect()
        assert sorted((r.path, r.term, r.n) for r in rows) == want and len(want) > 500
        assert all((r.impact is None or r.impact <= r.bound) and r.filled <= 4 for r in rows)
        assert b.count() == b.select("block").distinct().count() and b.filter("size(rows) <> filled").count() == 0
        plan = b._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(term" not in plan and "Window" not in plan and "Sort " not in plan
    assert {r.term: r.n for r in of(by_file).filter("path = '/a'").collect()} == {"alpha": 2, "beta": 1, "beta_1": 1}


def test_runs_keep_all_files_in_order(monkeypatch):
    """files are cut into runs by bytes, the largest alone; no word goes over the end of a text."""
    monkeypatch.setattr(rankedindex, "TEXTS", 20)
    texts = ["", "abc abc", "x" * 30, "", "de", "f g", "é" * 9, "last", ""]
    batch = pa.record_batch([pa.array(texts)], names=["content"])
    parts = list(rankedindex._cut(batch))
    assert [x for b, _ in parts for x in b["content"].to_pylist()] == texts
    assert all(n == sum(len(x.encode()) for x in b["content"].to_pylist()) and (n <= 20 or b.num_rows == 1) for b, n in parts)
    runs = list(rankedindex._runs(iter(parts), 20))
    got = []
    for t in runs:
        words, file = rankedindex._words(t["content"].combine_chunks())
        got += [(t["content"][int(f)].as_py(), w) for w, f in zip(words.to_pylist(), file)]
    assert got == [(x, w) for x in texts for w in re.findall(r"[0-9A-Za-z_]+", x)]


def test_postings_without_an_impact_come_last(spark, tmp_path):
    """A file of unknown length has no score; it is found after all others, and only with room for it."""
    now = datetime.datetime(2024, 2, 1)
    docs = spark.createDataFrame([(f"/f{i}", "alpha " * (i + 1)) for i in range(20)], "path string, content string")
    meta = docs.select("path", F.when(F.col("path") != "/f3", F.length("content") + F.crc32("path") % 9).alias("n_chars"), F.length("content").alias("size"), F.lit(now.date()).alias("modified"), F.lit("en").alias("language"))
    index = rankedindex.Index(spark, f"file://{tmp_path}/index").save_files(docs, meta, size=2)
    for limit in (5, 19, 20, 30):
        want = [tuple(r) for r in textindex.search(textindex.postings(docs), meta, "alpha", F.lit(now), None, limit).collect()]
        assert [tuple(r) for r in index.search("alpha", now, limit).collect()] == want
