"""Token estimates.  Column in, column out; null counts as empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tessera.functions.text import ascii_edges

# The patterns by which code is told from prose and adjusted for.
KEYWORDS = ascii_edges(r"\b(function|const|let|var|if|else|for|while|return|import|export|class|interface|type|async|await)\b")
OPERATORS = r"[{}();\[\]<>+\-*/%=!&|,:.]"
STRINGS = r"([\"'`])(?:(?!\1)[^\\]|\\.)*+\1"
COMMENTS = r"(?m)(//.*$|/\*[\s\S]*?\*/)"
URLS = r"https?://[^\s]+"
EMAILS = ascii_edges(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b")
CODE_SIGNS = (
    r"(function|class|interface|type|const|let|var)\s+\w+",
    r"(import|export)\s+.*from\s+['\"].+['\"]",
    r"\{\s*\n.*\n\s*\}",
    r"(\[[\s\S]*\]|\{[\s\S]*\})",
    r"[=+\-*/<>!&|]{2,}",
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _long(c: Column) -> Column:
    return c.cast("long")


def estimate_tokens(c: Column) -> Column:
    """Four characters a token, rounded up; empty is 0."""
    return _long(F.ceil(F.length(_text(c)) / 4))


def estimate_code_tokens(c: Column) -> Column:
    """Three characters a token, rounded up; empty is 0."""
    return _long(F.ceil(F.length(_text(c)) / 3))


def estimate_tokens_from_bytes(c: Column) -> Column:
    """Four bytes a token, rounded down, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.octet_length(_text(c)) / 4).cast("long"))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(_text(c), F.lit(pattern))


def is_code(c: Column) -> Column:
    """Whether two or more signs of code occur."""
    total = count(c, CODE_SIGNS[0])
    for sign in CODE_SIGNS[1:]:
        total = total + count(c, sign)
    return total >= 2


def _total_length(c: Column, pattern: str) -> Column:
    return F.aggregate(F.regexp_extract_all(_text(c), F.lit(pattern), F.lit(0)), F.lit(0), lambda acc, m: acc + F.length(m))


def _adjusted(c: Column, sign: str, pattern: str, worth: Callable[[Column], Column]) -> Column:
    """What matches of a pattern count beyond a quarter of their characters; looked for once, and only where ``sign`` occurs."""
    length = lambda found: F.aggregate(found, F.lit(0), lambda acc, m: acc + F.length(m))
    found = F.array(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    return F.when(F.contains(c, F.lit(sign)), F.get(F.transform(found, lambda m: worth(m) - F.ceil(length(m) / 4)), F.lit(0))).otherwise(F.lit(0))


def text_tokens(c: Column) -> Column:
    """Prose estimate; a URL counts a token for each 20 characters, an e-mail address two."""
    t = _text(c)
    urls = _adjusted(t, "://", URLS, lambda found: F.aggregate(found, F.lit(0).cast("long"), lambda acc, m: acc + F.ceil(F.length(m) / 20)))
    emails = _adjusted(t, "@", EMAILS, lambda found: (2 * F.size(found)).cast("long"))
    return _long(F.greatest(F.lit(1), estimate_tokens(c) + urls + emails))


def code_tokens(c: Column) -> Column:
    """Code estimate adjusted for keywords, operators, strings and comments."""
    k, o, s = count(c, KEYWORDS), count(c, OPERATORS), count(c, STRINGS)
    over = F.ceil((k * 8 + o * 2 + s * 20) / 4)
    return _long(F.greatest(F.lit(1), estimate_code_tokens(c) - over + k + o + F.ceil(s * 20 / 4) + F.ceil(_total_length(c, COMMENTS) / 4)))


def estimate(c: Column) -> Column:
    """Code or prose estimate, whichever the text looks like; blank is 0."""
    return F.when(F.trim(F.regexp_replace(_text(c), r"\s+", " ")) == "", F.lit(0).cast("long")).when(is_code(c), code_tokens(c)).otherwise(text_tokens(c))


def breakdown(c: Column) -> Column:
    """total, type, characters, base, adjustments."""
    base = F.when(is_code(c), estimate_code_tokens(c)).otherwise(estimate_tokens(c))
    return F.struct(estimate(c).alias("total"), F.when(is_code(c), "code").otherwise("text").alias("type"), F.length(_text(c)).cast("long").alias("characters"), base.alias("base"), (estimate(c) - base).alias("adjustments"))


def estimate_json_tokens(c: Column) -> Column:
    return estimate(F.to_json(c))
