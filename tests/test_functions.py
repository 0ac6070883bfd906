"""Scalar functions against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.config import EngineError, Settings, merged
from tessera.functions import paths, text, tokens, vectors


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize("t, prose, code, by_bytes", [("", 0, 0, 1), ("abcd", 1, 2, 1), ("abcde", 2, 2, 1), ("é" * 8, 2, 3, 4)])
def test_token_estimates(spark, t, prose, code, by_bytes):
    c = F.lit(t)
    assert one(spark, F.array(tokens.estimate_tokens(c), tokens.estimate_code_tokens(c), tokens.estimate_tokens_from_bytes(c))) == [prose, code, by_bytes]


def test_token_estimate_kinds(spark):
    code = "const a = 1;\nfunction f() { return a; } // note"
    assert one(spark, tokens.is_code(F.lit(code))) and not one(spark, tokens.is_code(F.lit("plain words here")))
    k, o, s, c = 3, 8, 0, len("// note")
    base = math.ceil(len(code) / 3)
    operators = sum(ch in "{}();[]<>+-*/%=!&|,:." for ch in code)
    want = max(1, base - math.ceil((k * 8 + operators * 2 + s * 20) / 4) + k + operators + math.ceil(c / 4))
    assert one(spark, tokens.code_tokens(F.lit(code))) == want
    url = "see https://example.com/a/long/path now"
    assert one(spark, tokens.text_tokens(F.lit(url))) == math.ceil(len(url) / 4) - math.ceil(31 / 4) + math.ceil(31 / 20)
    assert one(spark, tokens.estimate(F.lit("  \n"))) == 0 and one(spark, tokens.estimate(F.lit(None).cast("string"))) == 0


def test_paths(spark):
    p = F.lit("/a/b.d/c.test.TS")
    assert one(spark, F.array(paths.extension(p), paths.file_name(p), paths.directory(p), paths.language(p))) == ["ts", "c.test.TS", "/a/b.d", "typescript"]
    assert one(spark, paths.extension(F.lit("/a.b/c"))) == ""
    assert one(spark, paths.relative(F.lit("/a/b"), F.lit("/a/c/d"))) == "../c/d"
    near = [one(spark, paths.proximity(F.lit("/a/b/c.ts"), F.lit(o))) for o in ("/a/b/c.ts", "/a/b/d.ts", "/a/x/y/d.ts", "z.ts")]
    assert near == pytest.approx([1.0, 0.8, 0.8 - 0.5, 0.05])
    globs = {"**/*.ts": True, "*.ts": False, "/a/**/c.ts": True, "/a/?/c.ts": True, "/a/b/*.js": False}
    assert {g: one(spark, paths.matches_glob(F.lit("/a/b/c.ts"), g)) for g in globs} == globs
    safe = {"a/b": True, "../a": False, "/a": False, "~/a": False, "C:\\a": False, "": False}
    assert {s: one(spark, paths.is_safe(F.lit(s))) for s in safe} == safe


def test_text(spark):
    assert one(spark, text.symbol_score(F.lit("getUser"), F.lit("getuser"))) == 1.0
    assert one(spark, text.symbol_score(F.lit("getUserName"), F.lit("user"))) == 0.8
    assert one(spark, text.symbol_score(F.lit("abcd"), F.lit("abxx"))) == pytest.approx(0.3)
    assert one(spark, text.symbol_score(F.lit("abc"), F.lit(""))) == 0.8  # an empty name is contained in any
    assert one(spark, text.positions(F.lit("aXaxa.x"), F.lit("x"))) == [1, 3, 6]
    assert one(spark, text.terms(F.lit("The big red dog"))) == ["big", "red", "dog", "big red", "red dog", "big red dog"]
    assert one(spark, text.lines_around(F.lit("1\n2\n3\n4\n5"), F.lit(2), 1, 1)) == ["1", "2", "3"]
    h = 0
    for ch in "hello world, hello hash":
        h = (h * 31 + ord(ch) + 2**31) % 2**32 - 2**31
    digits, n = "", abs(h)
    while n:
        digits, n = "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36] + digits, n // 36
    assert one(spark, text.hash_string(F.lit("hello world, hello hash"))) == digits


def test_time(spark):
    t = lambda s: F.to_timestamp(F.lit(s))
    now = t("2024-02-01")
    got = one(spark, F.array(text.recency(t("2024-01-02"), now), text.recency(t("2024-03-01"), now), text.recency(F.lit(None).cast("timestamp"), now), text.recency(t("2020-01-01"), now)))
    assert got == pytest.approx([0.5, 1.0, 0.5, 0.1])
    ages = [one(spark, text.format_age(t(s), now)) for s in ("2024-01-31 23:50:00", "2024-01-31 22:00:00", "2024-01-31", "2024-01-20", "2023-11-01", "2020-01-01")]
    assert ages == ["just now", "2 hours ago", "1 day ago", "1 week ago", "3 months ago", "4 years ago"]
    assert [one(spark, text.format_duration(F.lit(x))) for x in (5.4, 65.0, 3725.0)] == ["5s", "1m 5s", "1h 2m"]


def test_vectors(spark):
    a, b, z = (F.array(*map(F.lit, v)) for v in ([3.0, 4.0], [4.0, 3.0], [0.0, 0.0]))
    assert one(spark, vectors.cosine(a, b)) == pytest.approx(0.96) and one(spark, vectors.similarity(a, z)) == 0.0
    assert one(spark, vectors.normalize(z)) == [0.0, 0.0] and one(spark, vectors.euclidean(a, b)) == pytest.approx(math.sqrt(2))
    assert one(spark, vectors.similarity(a, F.array(F.lit(1.0)))) == 0.0
    with pytest.raises(Exception, match="differ in length"):
        one(spark, vectors.cosine(a, F.array(F.lit(1.0))))
    hashes = vectors.running_hash([ord(c) for c in "ab"], 31, 0)
    p = one(spark, vectors.placeholder_embedding(F.lit("ab")))
    n = math.hypot(*(h % 1000 / 1000 for h in hashes))
    assert p[:3] == pytest.approx([97 / 1000 / n, 105 / 1000 / n, 0]) and hashes == [97, 3105]
    h = one(spark, vectors.hash_embedding(F.lit("abc")))
    assert len(h) == 384 and sum(x * x for x in h) == pytest.approx(1)
    blob = one(spark, vectors.to_blob(F.lit([1.5, -2.0])))
    assert len(blob) == 8 and one(spark, vectors.from_blob(F.lit(bytes(7)))) is None


def test_settings():
    assert merged(Settings(), {"limit": 5}).limit == 5
    for bad in ({"nope": 1}, {"limit": 0}, {"weights": {"semantic": 0.5}}):
        with pytest.raises(EngineError):
            merged(Settings(), bad)
