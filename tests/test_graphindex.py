"""The graph index against exact search: recall, removal, errors, stored form."""

import numpy as np
import pytest

from tessera.operators import graphindex as g


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<float>")


def exact(vectors, queries, k, gone=()):
    v, q = g.unit(vectors.astype(float)), g.unit(queries.astype(float))
    s = q @ v.T
    s[:, list(gone)] = -9
    return [set(x) for x in np.argsort(-s, axis=1, kind="stable")[:, :k].tolist()]


def recall(rows, want, k):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.id)
    return sum(len(got.get(i, set()) & w) for i, w in enumerate(want)) / (k * len(want))


@pytest.mark.parametrize("shape", ["random", "clusters", "uneven"])
def test_recall(spark, shape):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((3000, 24)).astype(np.float32)
    if shape == "clusters":
        v = (rng.standard_normal((60, 24))[rng.integers(0, 60, 3000)] + 0.05 * v).astype(np.float32)
    if shape == "uneven":
        v *= np.exp(rng.standard_normal((3000, 1))).astype(np.float32)
        v[:300] = v[0]
    q = rng.standard_normal((40, 24)).astype(np.float32) if shape == "random" else v[::75] + 0.01
    index = g.build(frame(spark, v), 24, shard_bytes=3000 * 24 * 2)
    assert index.select("shard").distinct().count() == 2
    rows = g.search(index, frame(spark, q).withColumnRenamed("id", "query_id"), 10).collect()
    if shape == "uneven":
        s = g.unit(q.astype(float)) @ g.unit(v.astype(float)).T
        least = -np.sort(-s, axis=1)[:, 9]
        assert sum(r.score >= least[r.query_id] - 1e-6 for r in rows) >= 0.9 * 400
    else:
        assert recall(rows, exact(v, q, 10), 10) >= 0.9
    assert all(abs(r.score - float(g.unit(q[r.query_id : r.query_id + 1].astype(float))[0] @ g.unit(v[r.id : r.id + 1].astype(float))[0])) < 1e-6 for r in rows)


def test_remove_add_compact_and_store(spark, tmp_path):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((400, 8)).astype(np.float32)
    v[7] = 0
    index = g.build(frame(spark, v[:300]), 8, "accurate")
    index = g.add(index, frame(spark, v[300:], 300), 8, "accurate")
    assert index.select("shard").distinct().count() == 2
    index = g.remove(index, frame(spark, v[:100]))
    g.save(index, str(tmp_path / "i"))
    index = g.load(spark, str(tmp_path / "i"))
    q = frame(spark, v[:20]).withColumnRenamed("id", "query_id")
    want = exact(v, v[:20], 5, range(100))
    for i in (index, g.compact(index, "accurate")):
        rows = g.search(i, q.filter("query_id <> 7"), 5, preset="accurate").collect()
        assert all(r.id >= 100 for r in rows)
        assert recall(rows, [w for w in want], 5) >= 0.9 * 19 / 20
        assert tuple(g.stats(i, "accurate").first()) == (300, 8, 32, 100, 300 * (8 * 4 + 150))
    assert g.compact(index, "accurate").count() == 300
    assert g.search(index, q, 500).filter("query_id = 7 AND score = 0").count() == 300
    assert g.remove(index, frame(spark, v[:1], 9999)).filter("dead").count() == 100


def test_errors(spark):
    rows = frame(spark, np.eye(4, dtype=np.float32))
    index = g.build(rows, 4)
    for broken in (lambda: g.build(rows, 5).count(), lambda: g.build(rows.unionByName(rows), 4).count(), lambda: g.add(index, rows.limit(1), 4).count(), lambda: g.search(index, rows.selectExpr("id AS query_id", "slice(embedding, 1, 3) AS embedding")).count(), lambda: g.build(rows.selectExpr("id", "CAST(NULL AS array<float>) AS embedding"), 4).count()):
        with pytest.raises(Exception, match="dimensions expected|duplicate id"):
            broken()
    assert g.build(rows.limit(0), 4).count() == 0
    assert g.search(index, rows.withColumnRenamed("id", "query_id"), 1).filter("query_id = id").count() == 4


def test_exact_check_finds_what_the_graph_misses(spark):
    """random vectors in many dimensions, of which the graph misses some; copies, removed rows and few rows."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((4000, 64)).astype(np.float32)
    v[100:130] = v[50]
    index = g.remove(g.build(frame(spark, v), 64, "fast", shard_bytes=4000 * 64 * 2), frame(spark, v[:40]))
    q = frame(spark, v[::50]).selectExpr("id * 50 AS query_id", "embedding")
    want = exact(v, v[::50], 10, range(40))
    found = lambda **how: {i: [(x.id, x.score) for x in sorted((r for r in rows if r.query_id == i), key=lambda r: r.rank)] for rows in [g.search(index, q, 10, preset="fast", **how).collect()] for i in range(0, 4000, 50)}
    graph, checked = found(), found(exact=True)
    assert any({x for x, _ in graph[i * 50]} != w for i, w in enumerate(want))
    copies = [50, *range(100, 109)]
    for i, w in enumerate(want):
        got = [x for x, _ in checked[i * 50]]
        assert got == copies if i * 50 in (50, 100) else set(got) == w
        assert [s for _, s in checked[i * 50]] == sorted((s for _, s in checked[i * 50]), reverse=True)
    assert g.search(index, q.limit(1), 5000, preset="fast", exact=True).count() == 3960
