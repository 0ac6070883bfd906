"""Text, hashing and time functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words left out of the text index.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
#: The edge of a word of ASCII letters, digits and underscores, as `\b` is in most engines; Java's takes other letters too.
WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def exact_match(a: Column, b: Column) -> Column:
    return F.when(F.lower(a) == F.lower(b), 1.0).otherwise(0.0)


def contains_match(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    return F.when(F.contains(x, y) | F.contains(y, x), 0.8).otherwise(0.0)


def symbol_score(name: Column, wanted: Column) -> Column:
    """1 equal, 0.8 contained either way, else 0.6 of the edit similarity."""
    return F.greatest(exact_match(name, wanted), contains_match(name, wanted), 0.6 * levenshtein_similarity(F.lower(name), F.lower(wanted)))


def ascii_edges(pattern: str) -> str:
    """The pattern with `\\b` as the edge of an ASCII word."""
    return pattern.replace(r"\b", WORD_EDGE)


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\W+"), lambda w: w != "")


def terms(c: Column) -> Column:
    """Index terms: distinct words beyond two letters and no stop words, then their pairs and triples."""
    found = F.filter(words(c), lambda x: (F.length(x) > 2) & ~x.isin(*STOP_WORDS))
    # Bound once: the words would be split again for each pair.
    run = lambda w, k: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, k)]))
    return F.get(F.transform(F.array(found), lambda w: F.concat(F.array_distinct(w), run(w, 2), run(w, 3))), F.lit(0))


def positions(c: Column, needle: Column) -> Column:
    """0-based offsets of non-overlapping occurrences; split lengths add up to them."""
    parts = F.split(F.lower(c), F.concat(F.lit("\\Q"), F.lower(needle), F.lit("\\E")), -1)
    step = lambda acc, p: F.struct((acc["at"] + F.length(p) + F.length(needle)).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(p))).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.slice(F.aggregate(parts, start, step, lambda acc: acc["out"]), F.lit(1), F.size(parts) - 1)


def lines_around(c: Column, line: Column, before: int = 5, after: int = 5) -> Column:
    """Lines around a 1-based line."""
    ls = F.split(c, "\n")
    a = F.greatest(line - before, F.lit(1))
    return F.slice(ls, a, F.greatest(F.least(line + after, F.size(ls)) - a + 1, F.lit(0)))


def overlap_score(query: Column, c: Column) -> Column:
    """Share of the query's words that occur in a text; null with no words."""
    q = words(query)
    return F.try_divide(F.size(F.filter(q, lambda w: F.array_contains(words(c), w))), F.size(q))


def sanitize_query(c: Column, most: int = 1000) -> Column:
    """A query without outer blanks, at most ``most`` characters."""
    return F.substring(F.trim(c), 1, most)


def checksum(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def chunk_checksum(path: Column, start: Column, end: Column, c: Column) -> Column:
    return F.sha2(F.concat(path, F.lit(":"), start, F.lit("-"), end, F.lit(":"), c), 256)


def metadata_checksum(size: Column, mtime_ms: Column) -> Column:
    return F.sha2(F.concat_ws(":", size, mtime_ms), 256)


def short_hash(c: Column) -> Column:
    return F.left(checksum(c), F.lit(16))


def hash_string(c: Column) -> Column:
    """31 h + code point in wrapped 32-bit arithmetic, absolute value in base 36."""
    step = lambda h, x: F.pmod(h * 31 + F.ascii(x) + 2147483648, F.lit(4294967296)) - 2147483648
    h = F.aggregate(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""), F.lit(0).cast("long"), step)
    return F.lower(F.conv(F.abs(h).cast("string"), 10, 36))


def age_days(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / 86_400_000_000


def decay(age: Column, half_life: float = 30.0, floor: float = 0.1) -> Column:
    """0.5 ^ (age / half-life), not below ``floor``; 1 for a future time."""
    return F.when(age < 0, 1.0).otherwise(F.greatest(F.lit(floor), F.pow(F.lit(0.5), age / half_life)))


def recency(ts: Column, now: Column, half_life: float = 30.0, floor: float = 0.1) -> Column:
    """``decay`` of the age; 0.5 where the time is missing or 0."""
    return F.when(ts.isNull() | (F.unix_micros(ts) == 0), 0.5).otherwise(decay(age_days(ts, now), half_life, floor))


def format_age(ts: Column, now: Column) -> Column:
    d = age_days(ts, now)
    n = lambda x, unit: F.concat(F.floor(x).cast("string"), F.lit(f" {unit}"), F.when(F.floor(x) == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(d < 1 / 24, "just now").when(d < 1, n(d * 24, "hour")).when(d < 7, n(d, "day")).when(d < 30, n(d / 7, "week")).when(d < 365, n(d / 30, "month")).otherwise(n(d / 365, "year"))


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds + 0.5).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(s % 3600 / 60).cast("string"), F.lit("m")))


def next_midnight(ts: Column) -> Column:
    """Next midnight; the session's time zone is UTC."""
    return F.date_trunc("day", ts) + F.expr("interval 1 day")


def indent(c: Column, by: int = 2) -> Column:
    return F.regexp_replace(c, "(?m)^", " " * by)
