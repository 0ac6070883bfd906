"""Text compression: comments, white space, signatures, bodies, truncation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.functions.tokens import estimate_code_tokens, estimate_tokens

# Comment patterns by language.
COMMENTS = {
    "typescript": (r"(?m)//.*$", r"/\*[\s\S]*?\*/"),
    "javascript": (r"(?m)//.*$", r"/\*[\s\S]*?\*/"),
    "python": (r"(?m)#.*$", r"'''[\s\S]*?'''", r'"""[\s\S]*?"""'),
    "rust": (r"(?m)//.*$", r"/\*[\s\S]*?\*/"),
    "go": (r"(?m)//.*$", r"/\*[\s\S]*?\*/"),
}
METHOD_LINE = r"^(public |private |protected |static )?(async )?\w+\("


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def light(c: Column) -> Column:
    """Without // and /* */ comments and blank lines."""
    return _strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?m)//.*$", ""), r"/\*[\s\S]*?\*/", ""), r"(?m)^\s*[\r\n]", ""))


def collapse(c: Column) -> Column:
    """Runs of blanks to one, three or more line ends to two, no blanks at line ends."""
    return _strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"(?m)[ \t]+$", ""))


def medium(c: Column) -> Column:
    return collapse(light(c))


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def imports(c: Column) -> Column:
    return F.filter(_lines(c), lambda x: F.startswith(F.ltrim(x), F.lit("import ")) | F.startswith(F.ltrim(x), F.lit("require(")))


def type_definitions(c: Column) -> Column:
    return F.filter(_lines(c), lambda x: F.startswith(F.ltrim(x), F.lit("type ")) | F.startswith(F.ltrim(x), F.lit("interface ")))


def structure(c: Column, kind: Column) -> Column:
    """Method lines of a class, branch and loop lines of a function."""
    branch = lambda x: F.ltrim(x).rlike("^(if|for|while|switch) ")
    none = F.expr("cast(array() as array<string>)")
    return F.when(kind == "class", F.filter(_lines(c), lambda x: F.trim(x).rlike(METHOD_LINE))).when(kind.isin("function", "method"), F.filter(_lines(c), branch)).otherwise(none)


def signature_lines(c: Column, kind: Column) -> Column:
    """Lines up to the first that opens a body, six at most."""
    opens = (
        F.when(kind.isin("function", "method"), F.array(F.lit(r"\{|=>"))).when(kind == "class", F.array(F.lit(r"\{|extends"))).otherwise(F.array(F.lit(r"=|:|;\s*$")))
    )
    ls = _lines(c)
    hit = F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: F.regexp_like(F.get(ls, i - 1), F.get(opens, F.lit(0))))
    return F.slice(ls, F.lit(1), F.least(F.coalesce(F.get(hit, F.lit(0)), F.size(ls)), F.lit(6)))


def aggressive(c: Column, kind: Column, signature: Column) -> Column:
    """Signature, imports, types, then ``...`` and key structure."""
    sig = F.when(F.coalesce(signature, F.lit("")) != "", F.array(signature)).otherwise(signature_lines(c, kind))
    s = structure(c, kind)
    tail = F.when(F.size(s) > 0, F.concat(F.array(F.lit("...")), s)).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_join(F.concat(sig, imports(c), type_definitions(c), tail), "\n")


def signature_only(c: Column, kind: Column, signature: Column) -> Column:
    sig = F.when(F.coalesce(signature, F.lit("")) != "", F.array(signature)).otherwise(signature_lines(c, kind))
    return F.array_join(F.concat(imports(c), sig), "\n")


def truncate(c: Column, target: Column) -> Column:
    """Lines until nine tenths of the target are reached; the line that reaches it stays."""
    step = lambda acc, x: F.when(acc["done"], acc).otherwise(
        F.struct(F.concat(acc["out"], F.array(x)).alias("out"), (acc["n"] + F.length(x) + 1).alias("n"), (F.ceil((acc["n"] + F.length(x)) / 3) >= target * 0.9).alias("done"))
    )
    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    return F.array_join(F.aggregate(_lines(c), start, step, lambda acc: acc["out"]), "\n")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compress(df: DataFrame, target: int | Column) -> DataFrame:
    """Add compressed, level, original_tokens, compressed_tokens, ratio.  In: content, kind, signature.

    The first level that fits is kept; when none does, the signature is truncated.
    """
    target = F.lit(target) if isinstance(target, int) else target
    c, kind, sig = F.coalesce("content", F.lit("")), F.col("kind"), F.col("signature")
    fits = lambda x: estimate_code_tokens(x) <= target
    kept = lambda level, x: F.struct(F.lit(level).alias("level"), x.alias("text"))
    # Each level is computed once, and only where those before it do not fit.
    last = lambda s: F.when(fits(s), kept("signature-only", s)).otherwise(kept("signature-only", truncate(s, target)))
    fourth = lambda a: F.when(fits(a), kept("aggressive", a)).otherwise(_let(signature_only(c, kind, sig), last))
    third = lambda m: F.when(fits(m), kept("medium", m)).otherwise(_let(aggressive(c, kind, sig), fourth))
    second = lambda x: F.when(fits(x), kept("light", x)).otherwise(_let(collapse(x), third))
    out = df.withColumn("_kept", F.when(fits(c), kept("light", c)).otherwise(_let(light(c), second)))
    out = out.withColumn("compressed", F.col("_kept.text")).withColumn("level", F.col("_kept.level")).drop("_kept")
    out = out.withColumn("original_tokens", estimate_code_tokens(c)).withColumn("compressed_tokens", estimate_code_tokens(F.col("compressed")))
    return out.withColumn("ratio", F.try_divide(F.col("original_tokens"), F.col("compressed_tokens")))


def compress_to_budget(df: DataFrame, budget: int, count: int) -> DataFrame:
    """An equal share for each chunk; the light result where it beats a ratio under 1.1."""
    out = compress(df, budget // max(count, 1))
    plain = light(F.coalesce("content", F.lit("")))
    better = (F.col("ratio") < 1.1) & (estimate_code_tokens(plain) < F.col("compressed_tokens"))
    return out.withColumn("compressed", F.when(better, plain).otherwise(F.col("compressed"))).withColumn("compressed_tokens", F.when(better, estimate_code_tokens(plain)).otherwise(F.col("compressed_tokens")))


def without_comments(c: Column, language: Column) -> Column:
    """Comments removed by language; // and /* */ for languages not listed."""
    out = F.regexp_replace(F.regexp_replace(c, COMMENTS["go"][0], ""), COMMENTS["go"][1], "")
    python = c
    for p in COMMENTS["python"]:
        python = F.regexp_replace(python, p, "")
    return F.when(language == "python", python).otherwise(out)


def clean(c: Column) -> Column:
    """Without blank lines."""
    return _strip(F.array_join(F.filter(_lines(c), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != ""), "\n"))


def collapsed_body(code: str, most: int) -> str:
    """Lines of brace bodies beyond ``most`` are dropped; where a body closes, a note or its first lines stand."""
    lines, out, depth, start = code.split("\n"), [], None, 0
    for i, line in enumerate(lines):
        if not line:
            continue
        opened, closed = line.count("{"), line.count("}")
        if depth is None:
            out.append(line)
            if opened:
                depth, start = opened - closed, i
            continue
        depth += opened - closed
        inner = i - start - 1
        if depth == 0 and closed:
            if inner > most:
                out.append(f"{line[: len(line) - len(line.lstrip())]}// ... {inner} lines collapsed ...")
            else:
                out.extend(lines[start + 1 : i])
            out.append(line)
            depth = None
        elif inner + 1 <= most:
            out.append(line)
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def _collapse_3(code: pd.Series) -> pd.Series:
    return code.map(lambda c: None if c is None else collapsed_body(c, 3))


@F.pandas_udf(T.StringType())
def _collapse_6(code: pd.Series) -> pd.Series:
    return code.map(lambda c: None if c is None else collapsed_body(c, 6))


def compress_by_language(df: DataFrame, level: str = "medium") -> DataFrame:
    """Add compressed, original_tokens, estimated_tokens, ratio, lines_removed.  In: content, language."""
    c = collapse(without_comments(F.coalesce("content", F.lit("")), F.col("language")))
    body = {"light": lambda x: x, "medium": _collapse_6, "aggressive": _collapse_3}[level]
    out = df.withColumn("compressed", clean(body(c)))
    out = out.withColumn("original_tokens", estimate_tokens(F.col("content"))).withColumn("estimated_tokens", estimate_tokens(F.col("compressed")))
    return out.withColumn("ratio", F.try_divide(F.col("original_tokens"), F.col("estimated_tokens"))).withColumn("lines_removed", F.size(_lines(F.col("content"))) - F.size(_lines(F.col("compressed"))))


def collapse_bodies(df: DataFrame, most: int, column: str = "content") -> DataFrame:
    """``collapsed_body`` over a column, Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[column] = [None if c is None else collapsed_body(c, most) for c in b[column]]
            yield b

    return df.mapInPandas(run, df.schema)
