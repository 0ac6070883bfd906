"""Rule classifiers of prompts, complexity, model choice and daily budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.functions.text import ascii_edges

# Intents with keywords and weights in order of precedence; base budgets and chunks.
INTENTS = (
    ("bug_fix", 1.0, ("bug", "error", "fix", "broken", "crash", "issue", "problem", "not working", "fail", "debug")),
    ("feature_add", 1.0, ("add", "implement", "create", "build", "new", "support", "feature", "functionality")),
    ("explain", 1.0, ("how", "what", "why", "explain", "describe", "tell me", "show me", "understand")),
    ("refactor", 1.0, ("refactor", "improve", "optimize", "clean", "reorganize", "restructure", "better")),
    ("test", 1.0, ("test", "spec", "verify", "validate", "check", "assert", "coverage")),
    ("search", 0.8, ("find", "search", "look for", "where", "locate", "show me", "list")),
)
BUDGET = {"bug_fix": 8000, "feature_add": 10000, "explain": 5000, "refactor": 7000, "test": 6000, "search": 3000, "general": 4000}
CHUNKS = {"bug_fix": 20, "feature_add": 30, "explain": 10, "refactor": 25, "test": 15, "search": 50, "general": 15}
SCOPE_FACTOR = {"current_file": 0.5, "current_dir": 0.75, "project": 1.0, "global": 1.5}
ENTITY_WORDS = ("function", "class", "method", "variable", "interface", "type", "component")
TECHNICAL = ("algorithm", "architecture", "pattern", "design", "implementation")
MULTI_STEP = ("and then", "after that", "also", "additionally", "plus")
BACK_REFERENCE = ("it", "that", "this", "they", "those", "the previous", "the above", "again", "also", "too", "similarly", "what about")
HIGH = ("architecture", "design pattern", "refactor", "optimize", "security", "performance", "scalability", "algorithm", "data structure", "async", "await", "concurrent", "distributed", "microservice", "testing", "debug", "troubleshoot", "error handling", "implement", "integration")
MEDIUM = ("function", "class", "component", "api", "endpoint", "database", "query", "validation", "authentication", "authorization", "interface", "type", "method", "property", "module", "package")
LOW = ("what is", "how to", "explain", "example", "syntax", "basic", "simple", "show", "list", "find", "where", "when", "which", "can you", "help me")
PATTERNS = (
    r"(?i)\b(async|await|promise|observable|future|task|thread)\b",
    r"(?i)\b(tree|graph|heap|hash map|linked list|stack|queue|map|set)\b",
    r"(?i)\b(singleton|factory|observer|strategy|decorator|adapter|proxy)\b",
    r"(?i)\b(sort|search|traverse|recursive|iterate|merge|split)\b",
    r"(?i)\b(try|catch|throw|error|exception|handle|validate)\b",
    r"(?i)\b(test|spec|mock|stub|assert|expect|verify)\b",
)
#: A line of one word or of brackets; only a line feed ends a line.
ONE_WORD_LINE = r"(?md)^[ \t\n\f\r]*[\w{}();]+[ \t\n\f\r]*$"
VAGUE = ("something", "anything", "somehow", "maybe", "possibly", "probably")
SPECIFIC = ("function", "class", "method", "variable", "file", "line", "column")
MODELS = {"local": ("local", 0.0, 0.0), "edge": ("edge", 0.0, 0.0), "small": ("cloud", 0.25, 1.25), "medium": ("cloud", 3.0, 15.0), "large": ("cloud", 15.0, 75.0)}
UNITS_PER_MILLION = 8239
DAILY_UNITS, ALERT_AT = 10_000, 0.9


def _has(c: Column, *words: str) -> Column:
    out = F.contains(c, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(c, F.lit(w))
    return out


def _count(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + F.contains(c, F.lit(w)).cast("int")
    return out


def normalized(prompt: Column) -> Column:
    return F.trim(F.lower(F.coalesce(prompt, F.lit(""))))


def intent(q: Column) -> Column:
    """Most keyword weight; ties go to the earlier intent; ``general`` without any."""
    scores = [F.struct((_count(q, words) * weight).alias("score"), F.lit(-i).alias("minus"), F.lit(name).alias("name")) for i, (name, weight, words) in enumerate(INTENTS)]
    top = F.array_max(F.array(*scores))
    return F.when(top["score"] > 0, top["name"]).otherwise("general")


def entities(q: Column) -> Column:
    """Quoted symbols, file names, words named as kinds, as array of (type, value, confidence)."""
    e = lambda kind, conf: lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(conf).alias("confidence"))
    quoted = F.transform(F.regexp_extract_all(q, F.lit("`[^`]+`|\"[^\"]+\"|'[^']+'"), F.lit(0)), lambda m: F.regexp_replace(m, "[`'\"]", ""))
    files = F.array_except(F.regexp_extract_all(q, F.lit(r"(?i)[\w.-]+\.[a-z]{2,4}"), F.lit(0)), quoted)
    kinds = F.filter(F.array(*map(F.lit, ENTITY_WORDS)), lambda w: F.contains(q, w))
    return F.concat(F.transform(quoted, e("symbol", 0.9)), F.transform(files, e("file", 0.7)), F.transform(kinds, e("keyword", 0.6)))


def scope(q: Column, found: Column) -> Column:
    is_ = lambda kind: F.exists(found, lambda e: e["type"] == kind)
    return (
        F.when(_has(q, "in this file", "current file"), "current_file").when(_has(q, "in this dir", "current directory", "here"), "current_dir")
        .when(_has(q, "in the project", "project-wide") | is_("file"), "project").when(is_("symbol"), "current_dir").otherwise("project")
    )


def prompt_complexity(q: Column, found: Column, history: Column) -> Column:
    flag = lambda cond, v: F.when(cond, v).otherwise(0.0)
    words = F.size(F.split(q, " "))
    total = F.least(F.lit(0.3), words / 50) + F.least(F.lit(0.3), F.size(found) * F.lit(0.1)) + flag(_has(q, *TECHNICAL), 0.2) + flag(_has(q, *MULTI_STEP), 0.2) + flag(history > 3, 0.1)
    return F.least(F.lit(1.0), total)


def detect(df: DataFrame, prompt: str = "prompt", history: Column | None = None) -> DataFrame:
    """Add intent, entities, scope, complexity, needs_history, budget, max_chunks, level, diverse."""
    h = F.lit(0) if history is None else history
    pick = lambda table, c: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)
    d = df.withColumn("_q", normalized(F.col(prompt))).withColumn("intent", intent(F.col("_q"))).withColumn("entities", entities(F.col("_q")))
    d = d.withColumn("scope", scope(F.col("_q"), F.col("entities"))).withColumn("complexity", prompt_complexity(F.col("_q"), F.col("entities"), h))
    d = d.withColumn("needs_history", _has(F.col("_q"), *BACK_REFERENCE))
    d = d.withColumn("budget", F.floor(pick(BUDGET, F.col("intent")) * pick(SCOPE_FACTOR, F.col("scope")) * (1 + F.col("complexity")) + 0.5).cast("long"))
    d = d.withColumn("max_chunks", pick(CHUNKS, F.col("intent"))).withColumn("level", F.when(F.col("complexity") > 0.7, "aggressive").when(F.col("complexity") < 0.3, "light").otherwise("medium"))
    return d.withColumn("diverse", F.col("scope") == "project").drop("_q")


def factors(query: Column, current_file: Column | None = None, n_chunks: Column | None = None) -> dict[str, Column]:
    """length, keywords, structure, dependencies, ambiguity, each within 0..1.

    All but the length are added up in whole hundredths, so that sums are exact and thresholds
    and rounded scores do not hang on the order of additions.
    """
    c, low = F.coalesce(query, F.lit("")), F.lower(F.coalesce(query, F.lit("")))
    flag = lambda cond, v: F.when(cond, v).otherwise(0)
    n = lambda p: F.regexp_count(c, F.lit(ascii_edges(p)))
    has = lambda p: c.rlike(ascii_edges(p))
    structure = F.lit(0)
    for p in PATTERNS:
        structure = structure + flag(has(p), 10)
    structure = structure + F.least(F.lit(20), n(r"\?") * 10) + flag(has("```") | has(ONE_WORD_LINE), 15) + flag(has(r"[\w/]+\.(ts|js|py|rs|go|java|cpp|c)"), 10)
    depends = F.least(F.lit(20), n(r"[\w/\\.]+") * 5) + flag(has(r"\b(import|require|from|include)\b"), 15)
    if current_file is not None:
        name = F.lower(F.substring_index(current_file, "/", -1))
        depends = depends + flag((name != "") & F.contains(low, name), 10)
    if n_chunks is not None:
        depends = depends + flag(n_chunks > 100, 10)
    vague = _count(low, VAGUE) * 15 + F.least(F.lit(20), n(r"(?i)\bor\b") * 10) + flag(has(r"(?i)\b(if|when|unless|depending|whether)\b"), 10) + flag(~_has(low, *SPECIFIC) & (F.length(c) > 50), 20)
    keywords = _count(low, HIGH) * 30 + _count(low, MEDIUM) * 15 - _count(low, LOW) * 10 + 30
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return {"length": unit((F.length(c) - 100) / 400), "keywords": unit(keywords / 100), "structure": unit(structure / 100), "dependencies": unit(depends / 100), "ambiguity": unit(vague / 100)}


def analyze(df: DataFrame, query: str = "prompt") -> DataFrame:
    """Add the five factors, the score and its reasoning."""
    for name, c in factors(F.col(query)).items():
        df = df.withColumn(f"f_{name}", c)
    score = F.col("f_length") * 0.2 + F.col("f_keywords") * 0.3 + F.col("f_structure") * 0.2 + F.col("f_dependencies") * 0.15 + F.col("f_ambiguity") * 0.15
    df = df.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    said = (("keywords", "complex keywords detected"), ("structure", "complex code patterns"), ("dependencies", "multiple dependencies"), ("ambiguity", "ambiguous requirements"), ("length", "lengthy query"))
    parts = F.concat_ws(", ", *[F.when(F.col(f"f_{k}") > 0.5, v) for k, v in said])
    head = F.concat(F.when(F.col("score") < 0.3, "simple query").when(F.col("score") < 0.6, "moderately complex").otherwise("highly complex"), F.concat(F.lit(" ("), F.format_number("score", 2), F.lit(")")))
    return df.withColumn("reasoning", F.when(parts == "", head).otherwise(F.concat_ws(": ", head, parts)))


def cost(tokens: Column, model: Column) -> Column:
    """70 % of the tokens at the input price, 30 % at the output price, a million each."""
    price = lambda i: F.element_at(F.create_map(*[x for k, v in MODELS.items() for x in (F.lit(k), F.lit(v[i]))]), model)
    return tokens * 0.7 / 1_000_000 * price(1) + tokens * 0.3 / 1_000_000 * price(2)


def route(tokens: Column, complexity: Column, affordable: Column) -> Column:
    """Tier by tokens and complexity; the edge tier only while its daily budget lasts."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), complexity))
    return F.when((tokens < 8000) & (c < 0.6), "local").when(affordable & (tokens < 50000) & (c < 0.7), "edge").when((tokens < 50000) & (c < 0.6), "small").when(tokens < 100000, "medium").otherwise("large")


def route_simple(tokens: Column) -> Column:
    return F.when(tokens < 8000, "local").when(tokens < 50000, "small").otherwise("medium")


def route_cli(tokens: Column, complexity: Column, local: Column) -> Column:
    return F.when(local & (tokens < 16000), "local").when((tokens < 20000) & (complexity < 0.5), "small").when(tokens < 100000, "medium").otherwise("large")


def units(tokens: Column, per_million: Column | None = None) -> Column:
    return (F.lit(UNITS_PER_MILLION) if per_million is None else per_million) * tokens / 1_000_000


def daily_budget(requests: DataFrame, limit: float = DAILY_UNITS, by: list[str] | None = None) -> DataFrame:
    """For each request by time and id: units, used after it, remaining_before, affordable, alert.

    A request is billed only if what remains of its UTC day covers it, so each depends on all
    before it.  Days (and ``by``, such as shards of the limit or tenants) are spread over the
    cluster; inside one, sorted rows stream past a single running sum.
    """
    keys = [*(by or []), "day"]
    r = requests.withColumn("day", F.to_date("ts")).withColumn("units", units(F.col("tokens")))
    out = T.StructType([*r.schema.fields, *(T.StructField(n, T.DoubleType()) for n in ("used", "remaining_before")), *(T.StructField(n, T.BooleanType()) for n in ("affordable", "alert"))])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, used = None, 0.0
        for b in batches:
            rows = []
            for at, cost in zip(b[keys].itertuples(index=False, name=None), b["units"].tolist()):
                if at != last:
                    last, used = at, 0.0
                left = max(0.0, limit - used)
                fits = cost <= left
                used += cost if fits else 0.0
                rows.append((used, left, fits, used > limit * ALERT_AT))
            yield b.assign(**dict(zip(("used", "remaining_before", "affordable", "alert"), map(list, zip(*rows))))) if rows else b.assign(used=0.0, remaining_before=0.0, affordable=False, alert=False)

    return r.repartition(*keys).sortWithinPartitions(*keys, "ts", "id").mapInPandas(fold, out)


def preferred_model(tasks: DataFrame, preferences: DataFrame, available: DataFrame) -> DataFrame:
    """First preference of a task that an available model's name contains.  Dimension tables."""
    hit = tasks.join(preferences, "task").join(available, F.contains(F.col("model"), F.col("pattern")))
    return hit.groupBy("task").agg(F.min_by("model", F.struct("rank", "model")).alias("model"))


def capabilities(models: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered capabilities, else by the model's name."""
    n = F.lower("model")
    guess = F.when(F.contains(n, F.lit("code")), F.array(F.lit("code"), F.lit("chat"))).when(F.contains(n, F.lit("embed")), F.array(F.lit("embedding"))).when(F.contains(n, F.lit("vision")) | F.contains(n, F.lit("llava")), F.array(F.lit("vision"), F.lit("chat"))).otherwise(F.array(F.lit("chat")))
    return models.join(registry, "model", "left").withColumn("capabilities", F.coalesce("capabilities", guess))


def messages(system: Column, prompt: Column, provider: str) -> Column:
    """A request body as struct: chat messages, a single prompt, or a system field apart."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    if provider == "prompt":
        return F.struct(F.concat_ws("\n\n", system, prompt).alias("prompt"))
    if provider == "system_apart":
        return F.struct(system.alias("system"), F.array(m("user", prompt)).alias("messages"))
    return F.struct(F.array(m("system", system), m("user", prompt)).alias("messages"))


def project_kind(files: DataFrame) -> DataFrame:
    """Language of each project by marker files, first rule first.  In: project, name."""
    rules = (("package.json", "javascript"), ("requirements.txt", "python"), ("pyproject.toml", "python"), ("Cargo.toml", "rust"), ("go.mod", "go"), ("pom.xml", "java"), ("tsconfig.json", "typescript"))
    table = F.create_map(*[x for i, (m, k) in enumerate(rules) for x in (F.lit(m), F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind")))])
    return files.withColumn("rule", F.element_at(table, F.col("name"))).groupBy("project").agg(F.min("rule").alias("rule")).select("project", F.coalesce("rule.kind", F.lit("unknown")).alias("kind"))
