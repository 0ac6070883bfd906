"""Fuzzy lookup of terms by keys that near terms must share, with edits counted only for those.

A query of n characters allows d = max(2, 30 % of n) edits.  Up to three edits two terms share
a string that is left of each one's first d + 5 characters when at most d are deleted: where
a prefix of one is matched with the other, each edit costs either side one character at most.
So both sides' deletions are keys, and an equi-join proposes all pairs.  Beyond three edits
the term is cut into d + 1 pieces, one of which must stand unchanged in the query, no more
than d places off; its keys are (length, piece, text), and the query's are its substrings
there.  The keys of a term are bounded by its length, the index is a table like any other,
and queries come as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RATIO, LEAST = 0.3, 2
#: Edits up to which deletions are the keys, and characters of the prefix beyond them.
DELETED, PREFIX = 3, 5


def allowed(length: Column) -> Column:
    return F.greatest(F.lit(LEAST), F.floor(length * RATIO)).cast("int")


def _deletions(word: Column, d: int) -> Column:
    """All that is left of the first d + 5 characters with at most d of them deleted."""
    out = F.array(F.substring(word, 1, d + PREFIX))
    for _ in range(d):
        less = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, less))))
    return out


def _cuts(length: Column, d: Column) -> Column:
    """(piece, first character, characters) of the d + 1 pieces of a word; the last ones are one longer where it does not divide."""
    small, odd = F.floor(length / (d + 1)).cast("int"), F.pmod(length, d + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), d), lambda i: F.struct(i.alias("piece"), (i * small + F.greatest(F.lit(0), i - (d + 1 - odd)) + 1).alias("at"), (small + (i >= d + 1 - odd).cast("int")).alias("size")))


def _key(*parts: Column) -> Column:
    return F.concat_ws("\x00", *(p.cast("string") for p in parts))


def _short(word: Column) -> Column:
    """Keys of a word for up to three edits: their number and what deletions leave."""
    out = F.lit(None).cast("array<string>")
    for d in range(LEAST, DELETED + 1):
        out = F.when(F.col("d") == d, F.transform(_deletions(word, d), lambda x: _key(F.col("d"), x))).otherwise(out)
    return out


def _queries_of(length: Column) -> Column:
    """Edits that some query allows from which a term of this length is no further than that."""
    reach = F.sequence(F.lit(1), F.ceil((length + LEAST) / (1 - RATIO)).cast("int") + 1)
    return F.array_distinct(F.transform(F.filter(reach, lambda n: F.abs(n - length) <= allowed(n)), allowed))


def index(terms: DataFrame, term: str = "term") -> DataFrame:
    """key, term: each distinct term by the keys under which it is found."""
    t = terms.select(F.col(term).alias("term")).filter("term IS NOT NULL").distinct()
    w = F.col("term")
    by_edits = t.select("term", F.explode(_queries_of(F.length(w))).alias("d"))
    short = _short(w)
    long = F.transform(_cuts(F.length(w), F.col("d")), lambda c: _key(F.col("d"), F.length(w), c["piece"], F.substr(w, c["at"], c["size"])))
    keys = F.when(F.col("d") <= DELETED, short).otherwise(long)
    return by_edits.select(F.explode(F.array_distinct(keys)).alias("key"), "term")


def _asked(queries: DataFrame, query: str) -> DataFrame:
    q = queries.select(F.col(query).alias("query")).filter("query IS NOT NULL").distinct().withColumn("d", allowed(F.length("query")))
    w, n = F.col("query"), F.length("query")
    short = _short(w)
    lengths = F.sequence(F.greatest(F.lit(1), n - F.col("d")), n + F.col("d"))
    places = lambda c: F.filter(F.sequence(c["at"] - F.col("d"), c["at"] + F.col("d")), lambda at: (at >= 1) & (at + c["size"] - 1 <= n))
    of = lambda size: F.flatten(F.transform(_cuts(size, F.col("d")), lambda c: F.transform(places(c), lambda at: _key(F.col("d"), size, c["piece"], F.substr(w, at, c["size"])))))
    keys = F.when(F.col("d") <= DELETED, short).otherwise(F.flatten(F.transform(lengths, of)))
    return q.select("query", "d", F.explode(F.array_distinct(keys)).alias("key"))


def candidates(stored: DataFrame, queries: DataFrame, query: str = "query") -> DataFrame:
    """query, d, term: distinct pairs that share a key and are of like length."""
    pairs = _asked(queries, query).join(stored, "key").filter(F.abs(F.length("term") - F.length("query")) <= F.col("d"))
    return pairs.select("query", "d", "term").distinct()


def search(stored: DataFrame, queries: DataFrame, query: str = "query") -> DataFrame:
    """term, query, distance, score of all terms within the edits that each query allows."""
    near = candidates(stored, queries, query).withColumn("distance", F.levenshtein("term", "query")).filter(F.col("distance") <= F.col("d"))
    return near.select("term", "query", "distance", (1 - F.col("distance") / F.greatest(F.length("term"), F.length("query"), F.lit(1))).alias("score"))
