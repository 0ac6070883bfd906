"""Packing chunks into a token budget: density order, greedy fold, diversity, prompt."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessera.functions import tokens

OVERAGE, STOP_AT, HIGH_SCORE = 1.1, 0.95, 0.8
PAGE = 4096


def with_density(df: DataFrame, content: str = "content", score: str = "score") -> DataFrame:
    """tokens and score by token; a chunk of no tokens counts a thousandfold."""
    n = tokens.estimate_code_tokens(F.col(content))
    return df.withColumn("tokens", n).withColumn("density", F.when(F.col("tokens") == 0, F.col(score) * 1000).otherwise(F.col(score) / F.col("tokens")))


def diverse(rows: list, budget: float) -> list:
    """Chosen rows spread over files, if they come from few: the best of each file, files with fewest rows first, then the others in order while they fit."""
    files: dict = {}
    for r in rows:
        files.setdefault(r.path, []).append(r)
    if len(rows) < 2 or len(files) >= min(len(rows), 5):
        return rows
    kept, spent = [], 0
    for best in (max(f, key=lambda r: r.score) for f in sorted(files.values(), key=len)):
        if spent + best.tokens <= budget:
            kept.append(best)
            spent += best.tokens
    for r in [r for r in rows if r not in kept]:
        if spent + r.tokens <= budget:
            kept.append(r)
            spent += r.tokens
        if spent >= budget * STOP_AT:
            break
    return kept


def select_within(df: DataFrame, budget: int, by: str | None = None, min_score: float = 0.0, max_chunks: int | None = None, diversity: bool = False) -> DataFrame:
    """Greedy choice by density for each query (``by``): id, path, score, tokens, density in.

    A chunk is taken if it fits, or if its score is high and it exceeds the budget by no more
    than a tenth; at 95 % of the budget choosing ends; at least one chunk is taken.  ``pos``
    ranks the chosen by score.  With ``by`` queries are spread over the cluster, a query's
    candidates being one array; without it there may be any number of candidates, and they
    are taken in pages (``_paged``).
    """
    if not by:
        return _paged(df, budget, min_score, max_chunks, diversity)
    order = F.struct("density", F.negative("tokens"), F.negative("id"))
    judged = df.select(by, "id", "path", "score", "tokens", "density").withColumn("_ok", F.col("score") >= min_score)
    best = judged.groupBy(by).agg(F.max(order).alias("_best"), (~F.max("_ok")).alias("_none"))
    both = judged.join(best, by)
    both = both.withColumn("_first", F.col("_best") == order)
    usable = both.filter(F.when(F.col("_none"), F.col("_first")).otherwise(F.col("_ok") & ((F.col("tokens") <= budget * OVERAGE) | F.col("_first"))))
    row = F.struct(F.negative("density").alias("minus"), "tokens", "id", "path", "score", "density")
    item_type = "array<struct<minus:double,tokens:bigint,id:bigint,path:string,score:double,density:double>>"
    most = F.lit(max_chunks if max_chunks is not None else 2**31 - 1)

    def step(acc: Column, x: Column) -> Column:
        spent, done = acc["spent"], acc["done"]
        fits = spent + x["tokens"] <= budget
        over = (spent + x["tokens"] <= budget * OVERAGE) & (x["score"] > HIGH_SCORE)
        take = ~done & (fits | over)
        now = F.when(take, spent + x["tokens"]).otherwise(spent)
        picked = F.when(take, F.concat(acc["out"], F.array(x))).otherwise(acc["out"])
        return F.struct(now.alias("spent"), picked.alias("out"), (done | (now >= budget * STOP_AT) | (F.size(picked) >= most)).alias("done"))

    start = F.struct(F.lit(0).cast("long").alias("spent"), F.expr(f"cast(array() as {item_type})").alias("out"), F.lit(False).alias("done"))
    grouped = usable.withColumn("_row", row).groupBy(by).agg(F.array_sort(F.collect_list("_row")).alias("items"))
    folded = grouped.select(by, F.col("items"), F.aggregate("items", start, step, lambda acc: acc["out"]).alias("out"))
    final = F.when(F.size("out") > 0, F.col("out")).otherwise(F.slice("items", 1, 1))
    chosen = folded.select(by, F.posexplode(final).alias("nth", "c")).select(by, "nth", "c.id", "c.path", "c.score", "c.tokens", "c.density")
    if diversity:  # what a query chose is bounded by its budget

        def spread(t: pd.DataFrame) -> pd.DataFrame:
            kept = diverse(list(t.sort_values("nth").itertuples(index=False)), budget)
            return pd.DataFrame(kept, columns=t.columns).assign(nth=range(len(kept)))

        chosen = chosen.groupBy(by).applyInPandas(spread, chosen.schema)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "nth"))
    return chosen.select(by, rank.alias("pos"), "id", "path", "score", "tokens", "density")


def _paged(df: DataFrame, budget: int, min_score: float, max_chunks: int | None, diversity: bool) -> DataFrame:
    """The same for one query over a whole table: the best ``PAGE`` in order, folded on the driver, then the
    next that still fit, until the budget is spent.  Each page is a distributed top-n; what was chosen and one page are all the driver holds."""
    spark, columns = df.sparkSession, ["id", "path", "score", "tokens", "density"]
    judged = df.select(*columns)
    place = [F.negative("density"), F.col("tokens"), F.col("id")]
    usable = judged.filter(F.col("score") >= min_score)
    chosen, spent, after, done = [], 0, None, False
    while not done:
        room = F.col("tokens") + spent
        left = usable.filter((room <= budget) | (room <= budget * OVERAGE) & (F.col("score") > HIGH_SCORE))
        if after is not None:
            left = left.filter(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(place)]) > F.struct(*[F.lit(x).alias(f"k{i}") for i, x in enumerate(after)]))
        page = left.orderBy(*place).limit(PAGE).collect()
        for r in page:
            if spent + r.tokens <= budget or spent + r.tokens <= budget * OVERAGE and r.score > HIGH_SCORE:
                chosen.append(r)
                spent += r.tokens
                if spent >= budget * STOP_AT or max_chunks is not None and len(chosen) >= max_chunks:
                    done = True
                    break
        done |= len(page) < PAGE
        after = (-page[-1].density, page[-1].tokens, page[-1].id) if page else None
    if not chosen:  # the densest of the usable ones, else of all
        best = lambda d: d.orderBy(F.desc("density"), "tokens", "id").limit(1).collect()
        chosen = best(usable) or best(judged)
    chosen = sorted(diverse(chosen, budget) if diversity else chosen, key=lambda r: -r.score)
    rows = [(i, *(r[c] for c in columns)) for i, r in enumerate(chosen, 1)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("pos", T.IntegerType()), *(judged.schema[c] for c in columns)]))


def best_per_file(df: DataFrame) -> DataFrame:
    """The best chunk of each file."""
    return df.groupBy("path").agg(F.max_by(F.struct("id", "score"), F.struct("score", F.negative("id"))).alias("b")).select("path", "b.id", "b.score")


def stats(selected: DataFrame, total: int) -> DataFrame:
    return selected.agg(F.count("*").alias("selected"), (F.count("*") / total).alias("rate"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"))


def prompt(selected: DataFrame, by: str | None = None) -> DataFrame:
    """Chosen chunks as markdown, grouped by file in order of first appearance.  In: pos, path, content, language, start_line, end_line."""
    key = [by] if by else []
    block = F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.col("content"), F.lit("\n```"))
    files = selected.groupBy(*key, "path").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", block.alias("block")))).alias("blocks"))
    section = F.concat(F.lit("## "), F.col("path"), F.lit("\n"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n"))
    return files.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("first", section.alias("section")))).alias("s")).select(*key, F.array_join(F.transform("s", lambda x: x["section"]), "\n\n").alias("prompt"))


def savings(original: Column, optimized: Column, price_per_million: float = 3.0) -> Column:
    """Tokens, percentage, ratio and cost saved."""
    saved = original - optimized
    return F.struct(saved.alias("saved"), F.coalesce(F.try_divide(saved * 100, original), F.lit(0.0)).alias("percent"), F.try_divide(original, optimized).alias("ratio"), (saved / 1_000_000 * price_per_million).alias("cost"))


def allocate(budget: Column) -> Column:
    """Shares of a budget: system 5 %, user 10 %, context 50 %, reply 35 %."""
    part = lambda p: F.floor(budget * p).cast("long")
    return F.struct(part(0.05).alias("system"), part(0.10).alias("user"), part(0.50).alias("context"), part(0.35).alias("reply"))
