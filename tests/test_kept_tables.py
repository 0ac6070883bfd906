"""Block checksums, prefix tables and table functions against plain Python."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import blockhash, chunking, prefixindex
from tessera.sources import tablefunctions


def tree(data, size, fan):
    h = [hashlib.sha256(data[i : i + size]).hexdigest() for i in range(0, max(1, len(data)), size)]
    n = len(h)
    while True:
        h = [hashlib.sha256("".join(h[i : i + fan]).encode()).hexdigest() for i in range(0, len(h), fan)]
        if len(h) == 1:
            return n, h[0]


def test_block_tree(spark):
    rnd = random.Random(1)
    texts = {f"/{i}": "".join(rnd.choices("aé\n😀", k=rnd.choice([0, 1, 5, 63, 64, 65, 700, 5000]))) for i in range(30)} | {"/null": None, "/long": "é" * 40_000}
    df = spark.createDataFrame(list(texts.items()), "path string, content string")
    stored = blockhash.blocks(df, 16)
    got = {r.path: (r.blocks, r.digest) for r in blockhash.digests(stored, 4).collect()}
    deepest = max(-(-len((t or "").encode()) // 16) for t in texts.values())
    levels = 1
    while 4**levels < deepest:
        levels += 1
    for p, t in texts.items():
        n, h = tree((t or "").encode(), 16, 4)
        more = levels - max(1, next(k for k in range(1, 30) if 4**k >= n))
        for _ in range(more):
            h = hashlib.sha256(h.encode()).hexdigest()
        assert got[p] == (n, h), p
    assert {r.path: r.digest for r in blockhash.digests(stored.repartition(7), 4).collect()} == {p: d for p, (_, d) in got.items()}


def test_only_changed_blocks(spark):
    old = spark.createDataFrame([("/a", "0123456789abcdef" * 4), ("/b", "same"), ("/c", "x" * 40)], "path string, content string")
    new = spark.createDataFrame([("/a", "0123456789abcdef" * 2 + "0123X56789abcdef" * 3), ("/b", "same"), ("/c", "x" * 16), ("/d", "new")], "path string, content string")
    stored = blockhash.blocks(old, 16)
    updated = blockhash.update(stored, new, 16)
    assert sorted(map(tuple, updated.select("path", "block", "quick", "hash").collect())) == sorted(map(tuple, blockhash.blocks(new, 16).collect()))
    assert {(r.path, r.block, r.change) for r in blockhash.changes(stored, updated).collect()} == {("/a", 2, "changed"), ("/a", 3, "changed"), ("/a", 4, "new"), ("/c", 1, "gone"), ("/c", 2, "gone")}


def test_prefix_updates_equal_a_new_table(spark):
    rnd = random.Random(2)
    uses = [rnd.choice(["", "Ab", "abc", "b"]) + rnd.choice(["", "x", "Xy", "é" * 30]) + rnd.choice(["", "1", "2"]) for _ in range(400)]
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows] + [(None,)], "query string")
    c = prefixindex.counts(frame(uses[:200]))
    i = prefixindex.build(c, 3)
    for a, b in ((200, 210), (210, 400)):
        i, c = prefixindex.update(i, c, frame(uses[a:b]), 3)
    assert sorted(map(tuple, i.collect())) == sorted(map(tuple, prefixindex.build(prefixindex.counts(frame(uses)), 3).collect()))
    n = Counter(u.lower() for u in uses if u)
    assert {r.query: r.n for r in c.collect()} == n
    for p in ("a", "AB", "abx" + "é" * 25, "none"):
        want = sorted(((q, k) for q, k in n.items() if q.startswith(p.lower())), key=lambda e: (-e[1], e[0]))[:3]
        assert [tuple(r) for r in prefixindex.suggest(i, p, 3).collect()] == (want if len(p) <= prefixindex.LONGEST else want[:3])


def test_table_functions(spark):
    rows = [("/a", "function f() {\n}\n\n\nclass B {\n}\n" + "x\n" * 120, "typescript"), ("/b", None, None), ("/c", " \n", "python")]
    files = spark.createDataFrame(rows, "path string, content string, language string")
    files.createOrReplaceTempView("tf_files")
    tablefunctions.register(spark)
    same = lambda sql, df, cols: sorted(map(str, spark.sql(sql).select(*cols).collect())) == sorted(map(str, df.select(*cols).collect()))
    spans = ["path", "idx", "start_line", "end_line", "content"]
    assert same("SELECT * FROM chunk_lines(TABLE(tf_files) PARTITION BY path, size => 10)", chunking.fixed_lines(files, 10), spans)
    assert same("SELECT * FROM chunk_boundaries(TABLE(tf_files))", chunking.at_boundaries(files), spans)
    assert same("SELECT * FROM chunk_tokens(TABLE(tf_files), 20)", chunking.packed_lines(files, 20), ["path", "idx", "start_line", "end_line", "tokens"])
    assert same("SELECT * FROM declarations(TABLE(tf_files) PARTITION BY path)", chunking.parse(files), ["path", "kind", "name", "signature", "start_line", "end_line", "parent", "error"])
    for wrong in ("chunk_lines(TABLE(tf_files), size => 0)", "declarations(TABLE(SELECT path, content FROM tf_files))"):
        with pytest.raises(Exception, match="1 or more|no column language"):
            spark.sql(f"SELECT * FROM {wrong}").collect()
    assert spark.sql("SELECT * FROM chunk_lines(TABLE(SELECT * FROM tf_files WHERE false))").select(F.count("*")).first()[0] == 0
