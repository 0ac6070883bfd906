"""Queries of scalar functions, scoring features, classifiers and compression."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import paths, text, tokens, vectors
from tessera.operators import compression, routing, scoring, search
from tessera.sources.files import split_valid
from tessera.plans.common import CHUNKS, FILES, NOW_SQL, chunks, files, now, prompts, r6, table, usage, vector_rows

PROMPTS = "prompts AS (SELECT conv_id * 1000 + turn AS id, text AS prompt FROM conversations WHERE role = 'user')"


def token_estimates(s, d):
    c = F.col("text")
    return table(s, d, "documents").select("doc_id", tokens.estimate_tokens(c).alias("tokens"), tokens.estimate_code_tokens(c).alias("code_tokens"), tokens.estimate_tokens_from_bytes(c).alias("byte_tokens"))


def token_text(s, d):
    return table(s, d, "documents").select("doc_id", tokens.text_tokens(F.col("text")).alias("tokens"), tokens.is_code(F.col("text")).alias("is_code"))


def token_breakdown(s, d):
    return table(s, d, "documents").select("doc_id", tokens.breakdown(F.col("text")).alias("b")).select("doc_id", "b.*")


def checksums(s, d):
    f = files(s, d)
    return f.select("doc_id", text.checksum(F.col("content")).alias("checksum"), text.short_hash(F.col("content")).alias("short_hash"), text.chunk_checksum(F.col("path"), F.lit(1), F.lit(50), F.col("content")).alias("chunk_checksum"), text.metadata_checksum(F.length("content"), F.lit(0)).alias("meta_checksum"))


def hash_strings(s, d):
    return table(s, d, "part").select("p_partkey", text.hash_string(F.col("p_name")).alias("hash"))


def path_parts(s, d):
    p = F.col("path")
    return files(s, d).select("doc_id", paths.extension(p).alias("extension"), paths.file_name(p).alias("file_name"), paths.directory(p).alias("directory"), paths.language(p).alias("language"), paths.is_absolute(p).alias("is_absolute"), F.size(paths.segments(p)).cast("long").alias("depth"))


def path_distance(s, d):
    p, c = F.col("path"), F.lit("/repo/src1/en/1.txt")
    return files(s, d).select("doc_id", paths.distance(p, c).cast("long").alias("distance"), paths.same_directory(p, c).alias("same_directory"), paths.common_ancestor(p, c).alias("ancestor"), r6(paths.proximity(p, c)).alias("proximity"), paths.relative(F.lit("/repo/src1"), p).alias("relative"))


def path_globs(s, d):
    p = F.col("path")
    return files(s, d).select("doc_id", paths.matches_glob(p, "**/en/*1.txt").alias("glob"), paths.matches_patterns(p, ["**/src1/**"], ["**/fr/**"]).alias("kept"), paths.is_safe(F.substring(p, 2, 1000)).alias("safe"))


def url_paths(s, d):
    u = F.regexp_replace("url", r"\?.*$", "")
    return table(s, d, "pages").select("page_id", paths.file_name(u).alias("name"), paths.directory(u).alias("folder"), F.size(paths.segments(u)).cast("long").alias("depth"))


def name_similarity(s, d):
    n, w = F.lower("p_name"), F.lit("red widget")
    return table(s, d, "part").select("p_partkey", r6(text.levenshtein_similarity(n, w)).alias("edit"), text.exact_match(n, w).alias("exact"), text.contains_match(n, w).alias("contains"), r6(text.symbol_score(n, w)).alias("symbol"))


def recency(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    at = F.to_timestamp(F.lit("1998-12-01 00:00:00"))
    return o.select("o_orderkey", r6(text.recency(F.col("ts"), at)).alias("recency"), r6(text.decay(text.age_days(F.col("ts"), at), 365.0, 0.01)).alias("slow"), text.format_age(F.col("ts"), at).alias("age"), text.next_midnight(F.col("ts")).cast("timestamp_ntz").alias("next_midnight"))


def vector_arithmetic(s, d):
    a, b = F.col("embedding"), F.reverse("embedding")
    v = vector_rows(s, d)
    return v.select("id", r6(vectors.magnitude(a)).alias("norm"), r6(vectors.dot(a, b)).alias("dot"), r6(vectors.euclidean(a, b)).alias("distance"), r6(F.get(vectors.add(a, b), F.lit(3))).alias("sum3"), r6(F.get(vectors.subtract(a, b), F.lit(3))).alias("diff3"), r6(F.get(vectors.scale(a, 2.5), F.lit(3))).alias("scaled3"), r6(F.get(vectors.normalize(vectors.scale(a, 3.0)), F.lit(3))).alias("unit3"), r6(vectors.similarity(a, b)).alias("similarity"))


def vector_blobs(s, d):
    v = vector_rows(s, d).withColumn("back", vectors.from_blob(vectors.to_blob(F.col("embedding"))))
    return v.select("id", (F.col("back") == F.col("embedding")).alias("same"))


def hash_vectors(s, d):
    v = table(s, d, "benchmark").select("item_id", vectors.placeholder_embedding(F.col("text")).alias("p"), vectors.hash_embedding(F.col("text")).alias("h"))
    return v.select("item_id", F.size("p").alias("dimensions"), r6(vectors.magnitude(F.col("p"))).alias("norm"), r6(F.get("p", F.lit(5))).alias("p5"), r6(F.get("h", F.lit(5))).alias("h5"))


def usage_scores(s, d):
    return scoring.usage_stats(usage(s, d)).select("chunk_id", "total", "helpful", r6(F.col("helpful_ratio")).alias("helpful_ratio"), r6(F.col("boost")).alias("boost"), r6(F.col("frequency")).alias("frequency"))


def usage_recent(s, d):
    return scoring.recent_usage(usage(s, d), now(), 10).groupBy("chunk_id").agg(F.count("*").alias("n"))


def relevance(s, d):
    """All five features and their weighted sum."""
    c = chunks(s, d).withColumn("name", F.concat(F.lit("doc_"), "chunk_id")).withColumn("modified", F.expr("timestamp '2024-02-01 00:00:00' - make_interval(0, 0, 0, int(chunk_id % 90))"))
    q = F.array(*[F.lit(1.0 if i % 2 else -1.0) for i in range(64)])
    ents = F.array(F.struct(F.lit("symbol").alias("type"), F.lit("doc_1").alias("value")))
    u = usage(s, d)
    f = scoring.features(c, q, F.lit("/repo/src1/en/1.txt"), ents, now(), u)
    out = f.withColumn("score", scoring.weighted())
    return out.select("chunk_id", *[r6(F.col(k)).alias(k) for k in ("semantic", "proximity", "symbol", "recency", "frequency", "score")])


def relevance_top(s, d):
    """The best twenty by the composite score, with rank."""
    best = relevance(s, d).select(F.col("chunk_id").alias("id"), "score").orderBy(F.desc("score"), "id").limit(20)
    return search.ranked(best).select("id", "score", F.col("rank").cast("long").alias("rank"))


def store_scores(s, d):
    c = chunks(s, d)
    age, sem = (F.col("chunk_id") % 90).cast("double"), F.lit(0.5)
    return c.select("chunk_id", r6(scoring.memory_store_score(sem, F.col("path"), age, F.col("chunk_id"))).alias("memory"), r6(scoring.table_store_score(sem, F.col("path"), F.col("label"), age)).alias("tables"))


def registered_scorers(s, d):
    r = scoring.ScorerRegistry()
    r.register("length", lambda: F.least(F.lit(1.0), F.length("content") / 5000), 2.0)
    r.register("label", lambda: F.col("label") / 10, 1.0)
    return r.score(chunks(s, d)).select("chunk_id", r6(F.col("score")).alias("score"))


def intents(s, d):
    return routing.detect(prompts(s, d)).select("id", "intent", F.size("entities").cast("long").alias("n_entities"), "scope", r6(F.col("complexity")).alias("complexity"), "needs_history", "budget", F.col("max_chunks").cast("long").alias("max_chunks"), "level", "diverse")


def complexity(s, d):
    return routing.analyze(prompts(s, d)).select("id", *[r6(F.col(f"f_{k}")).alias(k) for k in ("length", "keywords", "structure", "dependencies", "ambiguity")], r6(F.col("score")).alias("score"), "reasoning")


def routes(s, d):
    li = table(s, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("tokens"), (F.col("o_custkey") % 100 / 100).alias("c"))
    t = F.col("tokens")
    return li.select("o_orderkey", routing.route(t, F.col("c"), F.col("o_orderkey") % 2 == 0).alias("model"), routing.route_simple(t).alias("simple"), routing.route_cli(t, F.col("c"), F.col("o_orderkey") % 3 == 0).alias("cli"), r6(routing.cost(t, F.lit("medium"))).alias("cost"))


def budget_running(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.floor("value") * 100).cast("long").alias("tokens"))
    b = routing.daily_budget(e, 100)
    return b.select("id", r6(F.col("units")).alias("units"), r6(F.col("used")).alias("used"), r6(F.col("remaining_before")).alias("remaining_before"), "affordable", "alert")


def model_for_task(s, d):
    """Brands as tasks, which prefer names with the first word of their parts, small sizes first; all names are there."""
    p = table(s, d, "part")
    prefs = p.select(F.col("p_brand").alias("task"), F.col("p_size").alias("rank"), F.substring_index("p_name", " ", 1).alias("pattern")).distinct()
    return routing.preferred_model(p.select(F.col("p_brand").alias("task")).distinct(), prefs, p.select(F.col("p_name").alias("model")).distinct())


def compress_light(s, d):
    return table(s, d, "documents").select("doc_id", compression.light(F.col("text")).alias("light")).select("doc_id", F.sha2("light", 256).alias("light"), F.length("light").cast("long").alias("n"))


def compress_levels(s, d):
    c = table(s, d, "documents").select("doc_id", F.col("text").alias("content"), F.lit("function").alias("kind"), F.lit(None).cast("string").alias("signature"))
    return compression.compress(c, 300).select("doc_id", "level", "original_tokens", "compressed_tokens", r6(F.col("ratio")).alias("ratio"), F.sha2("compressed", 256).alias("compressed"))


def compress_language(s, d):
    c = table(s, d, "documents").select("doc_id", F.col("text").alias("content"), F.lit("typescript").alias("language"))
    return compression.compress_by_language(c, "medium").select("doc_id", "original_tokens", "estimated_tokens")


def validated(s, d):
    """Both outcomes of the payload check, by its own rules, and each text as a query."""
    good, bad = split_valid(files(s, d).withColumn("path", F.substring("path", 2, 1000)))
    both = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)).drop("reason"))
    return both.select("doc_id", "valid", F.sha2(text.sanitize_query(F.col("content")), 256).alias("clean"))


_DOT = "list_inner_product(CAST(embedding AS DOUBLE[]), CAST({} AS DOUBLE[]))"
_REV = "list_reverse(embedding)"
_HAS = lambda words: " OR ".join(f"contains(q, '{w}')" for w in words)
_SUM = lambda words, col="q": " + ".join(f"CAST(contains({col}, '{w}') AS INT)" for w in words)


def _intent_sql() -> str:
    scores = ", ".join(f"({_SUM(words)}) * {weight} AS s{i}" for i, (_, weight, words) in enumerate(routing.INTENTS))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(routing.INTENTS))) + ")"
    pick = " ".join(f"WHEN s{i} = best THEN '{name}'" for i, (name, _, _) in enumerate(routing.INTENTS))
    lookup = lambda table, col: "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"
    return f"""
WITH {PROMPTS}, a AS (SELECT id, trim(lower(coalesce(prompt, ''))) AS q FROM prompts),
b AS (SELECT id, q, {scores},
  list_transform(regexp_extract_all(q, '`[^`]+`|"[^"]+"|''[^'']+'''), lambda m: regexp_replace(m, '[`''"]', '', 'g')) AS quoted,
  regexp_extract_all(q, '(?i)[\\w.-]+\\.[a-z]{{2,4}}') AS named, {_SUM(routing.ENTITY_WORDS)} AS kinds FROM a),
c AS (SELECT *, {best} AS best, list_distinct(list_filter(named, lambda f: NOT list_contains(quoted, f))) AS fs FROM b),
e AS (SELECT *, CASE WHEN best = 0 THEN 'general' {pick} END AS intent, len(quoted) + len(fs) + kinds AS n_entities FROM c),
f AS (SELECT *, CASE WHEN {_HAS(("in this file", "current file"))} THEN 'current_file' WHEN {_HAS(("in this dir", "current directory", "here"))} THEN 'current_dir'
  WHEN {_HAS(("in the project", "project-wide"))} OR len(fs) > 0 THEN 'project' WHEN len(quoted) > 0 THEN 'current_dir' ELSE 'project' END AS scope,
  least(1.0, least(0.3, len(string_split(q, ' ')) / 50.0) + least(0.3, n_entities * 0.1) + CASE WHEN {_HAS(routing.TECHNICAL)} THEN 0.2 ELSE 0 END + CASE WHEN {_HAS(routing.MULTI_STEP)} THEN 0.2 ELSE 0 END)::DOUBLE AS complexity FROM e)
SELECT id, intent, CAST(n_entities AS BIGINT) AS n_entities, scope, round(complexity, 6) AS complexity, {_HAS(routing.BACK_REFERENCE)} AS needs_history,
  CAST(floor(({lookup(routing.BUDGET, "intent")})::DOUBLE * ({lookup(routing.SCOPE_FACTOR, "scope")})::DOUBLE * (1 + complexity) + 0.5) AS BIGINT) AS budget,
  CAST({lookup(routing.CHUNKS, "intent")} AS BIGINT) AS max_chunks, CASE WHEN complexity > 0.7 THEN 'aggressive' WHEN complexity < 0.3 THEN 'light' ELSE 'medium' END AS level, scope = 'project' AS diverse
FROM f"""


def _proximity(col: str = "path", current: str = "'/repo/src1/en/1.txt'") -> str:
    a, b = f"string_split({col}, '/')", f"string_split({current}, '/')"
    same = f"coalesce(list_position(list_transform(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] = {b}[i]), false) - 1, least(len({a}), len({b})))"
    return a, b, same


_A, _B, _M = _proximity()
_PROX = f"CASE WHEN path = '/repo/src1/en/1.txt' THEN 1.0 WHEN {_M} = 0 THEN 0.05 WHEN len({_A}) = len({_B}) AND {_M} = len({_A}) - 1 THEN 0.8 ELSE greatest(0.1, 0.8 - (len({_A}) + len({_B}) - 2 * {_M}) * 0.1) END"
_LEV = lambda a, b: f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE END"
_SYMBOL = lambda a, b: f"greatest(CASE WHEN {a} = {b} THEN 1.0 ELSE 0 END, CASE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.8 ELSE 0 END, 0.6 * ({_LEV(a, b)}))"
_DECAY = lambda age, half, floor: f"CASE WHEN {age} < 0 THEN 1.0 ELSE greatest({floor}, pow(0.5, {age} / {half})) END"
_USAGE = "usage AS (SELECT user_id % 50 AS chunk_id, count(*) AS total, count(*) FILTER (event_type IN ('click', 'purchase')) AS helpful FROM events GROUP BY 1)"
_AGE = "(epoch_us(TIMESTAMP '1998-12-01') - epoch_us(o_orderdate)) / 86400000000.0"
_AGO = lambda x, unit: f"CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) || ' {unit}' || CASE WHEN floor({x}) = 1 THEN '' ELSE 's' END || ' ago'"
_LIGHT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)//.*$', '', 'g'), '/\*[\s\S]*?\*/', '', 'g'), '(?m)^\s*[\r\n]', '', 'g'), '^\s+|\s+$', '', 'g')"

_N = "len(regexp_extract_all(text, {}))"
_LEN = "coalesce(list_sum(list_transform(regexp_extract_all(text, {}), lambda x: length(x))), 0)"
_K, _O = r"'\b(function|const|let|var|if|else|for|while|return|import|export|class|interface|type|async|await)\b'", r"'[{}();\[\]<>+\-*/%=!&|,:.]'"
_S = r"""'"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|`(?:[^`\\]|\\.)*`'"""
_C, _U, _E = r"'(?m)(//.*$|/\*[\s\S]*?\*/)'", r"'https?://[^\s]+'", r"'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'"
_SIGNS = (r"'(function|class|interface|type|const|let|var)\s+\w+'", r"""'(import|export)\s+.*from\s+[''"].+[''"]'""", r"'\{\s*\n.*\n\s*\}'", r"'(\[[\s\S]*\]|\{[\s\S]*\})'", r"'[=+\-*/<>!&|]{2,}'")
_BREAKDOWN = (
    f"WITH a AS (SELECT doc_id, text, {' + '.join(_N.format(x) for x in _SIGNS)} >= 2 AS code, {_N.format(_K)} AS k, {_N.format(_O)} AS o, {_N.format(_S)} AS s, {_LEN.format(_C)} AS c, {_LEN.format(_U)} AS u, coalesce(list_sum(list_transform(regexp_extract_all(text, {_U}), lambda x: ceil(length(x) / 20.0))), 0) AS un, {_LEN.format(_E)} AS e, {_N.format(_E)} AS en FROM documents),"
    " b AS (SELECT *, CAST(CASE WHEN code THEN ceil(length(text) / 3.0) ELSE ceil(length(text) / 4.0) END AS BIGINT) AS base FROM a),"
    r" t AS (SELECT *, CAST(CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 WHEN code THEN greatest(1, base - ceil((k * 8 + o * 2 + s * 20) / 4.0) + k + o + ceil(s * 20 / 4.0) + ceil(c / 4.0)) ELSE greatest(1, base - ceil(u / 4.0) + un - ceil(e / 4.0) + 2 * en) END AS BIGINT) AS total FROM b)"
    " SELECT doc_id, total, CASE WHEN code THEN 'code' ELSE 'text' END AS type, length(text) AS characters, base, total - base AS adjustments FROM t"
)

def _complexity_sql():
    """The five factors by the same published rules, as arithmetic over counts of matches."""
    r = routing
    count = lambda words: "(" + " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in words) + ")"
    any_of = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"
    n = lambda p: f"len(regexp_extract_all(c, '{p}'))"
    flag = lambda p, v: f"CASE WHEN regexp_matches(c, '{p}') THEN {v} ELSE 0 END"
    unit = lambda x: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({x})::DOUBLE))"
    code = flag("```", 0.15).replace("THEN", r"OR regexp_matches(c, '(?m)^\s*[\w{}();]+\s*$') THEN")
    structure = " + ".join([*(flag(p, 0.1) for p in r.PATTERNS), f"least(0.2, {n(r'\?')} * 0.1)", code, flag(r"[\w/]+\.(ts|js|py|rs|go|java|cpp|c)", 0.1)])
    depends = f"least(0.2, {n(r'[\w/\\.]+')} * 0.05) + {flag(r'\b(import|require|from|include)\b', 0.15)}"
    vague = f"{count(r.VAGUE)} * 0.15 + least(0.2, {n(r'(?i)\bor\b')} * 0.1) + {flag(r'(?i)\b(if|when|unless|depending|whether)\b', 0.1)} + CASE WHEN NOT {any_of(r.SPECIFIC)} AND length(c) > 50 THEN 0.2 ELSE 0 END"
    keywords = f"{count(r.HIGH)} * 0.3 + {count(r.MEDIUM)} * 0.15 - {count(r.LOW)} * 0.1 + 0.3"
    said = "concat_ws(', ', CASE WHEN keywords > 0.5 THEN 'complex keywords detected' END, CASE WHEN structure > 0.5 THEN 'complex code patterns' END, CASE WHEN dependencies > 0.5 THEN 'multiple dependencies' END, CASE WHEN ambiguity > 0.5 THEN 'ambiguous requirements' END, CASE WHEN length > 0.5 THEN 'lengthy query' END)"
    return f"""WITH {PROMPTS}, t AS (SELECT id, coalesce(prompt, '') AS c, lower(coalesce(prompt, '')) AS low FROM prompts),
 f AS (SELECT id, {unit('(length(c) - 100) / 400.0')} AS length, {unit(keywords)} AS keywords, {unit(structure)} AS structure, {unit(depends)} AS dependencies, {unit(vague)} AS ambiguity FROM t),
 s AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, length * 0.2::DOUBLE + keywords * 0.3::DOUBLE + structure * 0.2::DOUBLE + dependencies * 0.15::DOUBLE + ambiguity * 0.15::DOUBLE)) AS sc, {said} AS said FROM f),
 h AS (SELECT *, CASE WHEN sc < 0.3 THEN 'simple query' WHEN sc < 0.6 THEN 'moderately complex' ELSE 'highly complex' END || printf(' (%.2f)', sc) AS head FROM s)
SELECT id, round(length, 6) AS length, round(keywords, 6) AS keywords, round(structure, 6) AS structure, round(dependencies, 6) AS dependencies, round(ambiguity, 6) AS ambiguity, round(sc, 6) AS score,
 CASE WHEN said = '' THEN head ELSE head || ': ' || said END AS reasoning FROM h"""


_TOK = "CAST(ceil(length({}) / 3.0) AS BIGINT)"
_LEVELS = f"""WITH p AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), li AS (SELECT doc_id, text AS c, {_LIGHT} AS l, string_split(text, chr(10)) AS ls FROM p),
 me AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS m FROM li),
 pa AS (SELECT *, ls[1:least(coalesce(list_min(list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '\\{{|=>'))), len(ls)), 6)] AS sig, list_filter(ls, lambda x: starts_with(ltrim(x, ' '), 'import ') OR starts_with(ltrim(x, ' '), 'require(')) AS im,
  list_filter(ls, lambda x: starts_with(ltrim(x, ' '), 'type ') OR starts_with(ltrim(x, ' '), 'interface ')) AS ty, list_filter(ls, lambda x: regexp_matches(ltrim(x, ' '), '^(if|for|while|switch) ')) AS st FROM me),
 al AS (SELECT *, array_to_string(list_concat(sig, im, ty, CASE WHEN len(st) > 0 THEN list_concat(['...'], st) ELSE [] END), chr(10)) AS a, array_to_string(list_concat(im, sig), chr(10)) AS g FROM pa),
 gl AS (SELECT doc_id, unnest(string_split(g, chr(10))) AS line, generate_subscripts(string_split(g, chr(10)), 1) AS i FROM al),
 gs AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM gl),
 gd AS (SELECT *, coalesce(bool_or(ceil((n + length(line)) / 3.0) >= 270) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM gs),
 gt AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS cut FROM gd WHERE NOT done GROUP BY doc_id),
 ch AS (SELECT doc_id, c, CASE WHEN {_TOK.format('c')} <= 300 OR {_TOK.format('l')} <= 300 THEN 'light' WHEN {_TOK.format('m')} <= 300 THEN 'medium' WHEN {_TOK.format('a')} <= 300 THEN 'aggressive' ELSE 'signature-only' END AS level,
  CASE WHEN {_TOK.format('c')} <= 300 THEN c WHEN {_TOK.format('l')} <= 300 THEN l WHEN {_TOK.format('m')} <= 300 THEN m WHEN {_TOK.format('a')} <= 300 THEN a WHEN {_TOK.format('g')} <= 300 THEN g ELSE cut END AS x FROM al JOIN gt USING (doc_id))
SELECT doc_id, level, {_TOK.format('c')} AS original_tokens, {_TOK.format('x')} AS compressed_tokens, round({_TOK.format('c')} / nullif({_TOK.format('x')}, 0)::DOUBLE, 6) AS ratio, sha256(x) AS compressed FROM ch"""


QUERIES = {
    "token_estimates": (token_estimates, "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(ceil(length(text) / 3.0) AS BIGINT) AS code_tokens, CAST(greatest(1, strlen(text) // 4) AS BIGINT) AS byte_tokens FROM documents"),
    "token_text": (
        token_text,
        r"""WITH a AS (SELECT doc_id, text, regexp_extract_all(text, 'https?://[^\s]+') AS u, regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b') AS e FROM documents)
SELECT doc_id, CAST(greatest(1, ceil(length(text) / 4.0) - ceil(coalesce(list_sum(list_transform(u, lambda x: length(x))), 0) / 4.0) + coalesce(list_sum(list_transform(u, lambda x: ceil(length(x) / 20.0))), 0)
  - ceil(coalesce(list_sum(list_transform(e, lambda x: length(x))), 0) / 4.0) + 2 * len(e)) AS BIGINT) AS tokens,
  len(regexp_extract_all(text, '(function|class|interface|type|const|let|var)\s+\w+')) + len(regexp_extract_all(text, '(import|export)\s+.*from\s+[''"].+[''"]')) + len(regexp_extract_all(text, '\{\s*\n.*\n\s*\}'))
  + len(regexp_extract_all(text, '(\[[\s\S]*\]|\{[\s\S]*\})')) + len(regexp_extract_all(text, '[=+\-*/<>!&|]{2,}')) >= 2 AS is_code FROM a""",
    ),
    "token_breakdown": (token_breakdown, _BREAKDOWN),
    "checksums": (checksums, f"WITH {FILES} SELECT doc_id, sha256(content) AS checksum, left(sha256(content), 16) AS short_hash, sha256(path || ':1-50:' || content) AS chunk_checksum, sha256(length(content) || ':0') AS meta_checksum FROM files"),
    "hash_strings": (hash_strings, "WITH a AS (SELECT p_partkey, list_transform(list_filter(string_split(p_name, ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT)) AS c FROM part), b AS (SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, c), lambda h, x: ((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM a) SELECT p_partkey, lower(to_base(abs(h), 36)) AS hash FROM b"),
    "path_parts": (path_parts, f"WITH {FILES} SELECT doc_id, 'txt' AS extension, regexp_extract(path, '[^/]*$') AS file_name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, 'text' AS language, starts_with(path, '/') AS is_absolute, CAST(len(string_split(path, '/')) AS BIGINT) AS depth FROM files"),
    "path_distance": (
        path_distance,
        f"WITH {FILES} SELECT doc_id, CAST(len({_A}) + len({_B}) - 2 * {_M} AS BIGINT) AS distance, regexp_extract(path, '^(.*)/[^/]*$', 1) = '/repo/src1/en' AS same_directory, array_to_string(({_A})[1:{_M}], '/') AS ancestor, round(CAST({_PROX} AS DOUBLE), 6) AS proximity,"
        " CASE WHEN starts_with(path, '/repo/src1/') THEN substr(path, 12) ELSE '../' || substr(path, 7) END AS relative FROM files",
    ),
    "path_globs": (path_globs, f"WITH {FILES} SELECT doc_id, regexp_matches(path, '/en/[^/]*1\\.txt$') AS glob, contains(path, '/src1/') AND NOT contains(path, '/fr/') AS kept, true AS safe FROM files"),
    "url_paths": (url_paths, r"WITH u AS (SELECT page_id, regexp_replace(url, '\?.*$', '') AS u FROM pages) SELECT page_id, regexp_extract(u, '[^/]*$') AS name, regexp_extract(u, '^(.*)/[^/]*$', 1) AS folder, CAST(len(string_split(u, '/')) AS BIGINT) AS depth FROM u"),
    "name_similarity": (
        name_similarity,
        f"WITH a AS (SELECT p_partkey, lower(p_name) AS n, 'red widget' AS w FROM part) SELECT p_partkey, round({_LEV('n', 'w')}, 6) AS edit, CASE WHEN n = w THEN 1.0 ELSE 0.0 END::DOUBLE AS exact, CASE WHEN contains(n, w) OR contains(w, n) THEN 0.8 ELSE 0.0 END::DOUBLE AS contains, round(({_SYMBOL('n', 'w')})::DOUBLE, 6) AS symbol FROM a",
    ),
    "recency": (
        recency,
        f"WITH a AS (SELECT o_orderkey, o_orderdate, {_AGE} AS d FROM orders) SELECT o_orderkey, round(CAST({_DECAY('d', 30.0, 0.1)} AS DOUBLE), 6) AS recency, round(CAST({_DECAY('d', 365.0, 0.01)} AS DOUBLE), 6) AS slow,"
        f" CASE WHEN d < 1 / 24.0 THEN 'just now' WHEN d < 1 THEN {_AGO('d * 24', 'hour')} WHEN d < 7 THEN {_AGO('d', 'day')} WHEN d < 30 THEN {_AGO('d / 7', 'week')} WHEN d < 365 THEN {_AGO('d / 30', 'month')} ELSE {_AGO('d / 365', 'year')} END AS age,"
        " CAST(date_trunc('day', o_orderdate) + INTERVAL 1 DAY AS TIMESTAMP) AS next_midnight FROM a",
    ),
    "vector_arithmetic": (
        vector_arithmetic,
        f"SELECT vec_id AS id, round(sqrt({_DOT.format('embedding')}), 6) AS norm, round({_DOT.format(_REV)}, 6) AS dot, round(list_distance(CAST(embedding AS DOUBLE[]), CAST({_REV} AS DOUBLE[])), 6) AS distance,"
        " round(embedding[4]::DOUBLE + embedding[-4]::DOUBLE, 6) AS sum3, round(embedding[4]::DOUBLE - embedding[-4]::DOUBLE, 6) AS diff3, round(embedding[4]::DOUBLE * 2.5, 6) AS scaled3,"
        f" round(embedding[4]::DOUBLE / sqrt({_DOT.format('embedding')}), 6) AS unit3, round(least(1.0, greatest(0.0, {_DOT.format(_REV)} / {_DOT.format('embedding')})), 6) AS similarity FROM embeddings",
    ),
    "vector_blobs": (vector_blobs, "SELECT vec_id AS id, true AS same FROM embeddings"),
    "hash_vectors": (hash_vectors, None),
    "usage_frequency_score": (usage_scores, f"WITH {_USAGE} SELECT chunk_id, total, helpful, round(helpful / total::DOUBLE, 6) AS helpful_ratio, round(least(1.0, total / 10.0)::DOUBLE, 6) AS boost, round((helpful / total::DOUBLE * least(1.0, total / 10.0))::DOUBLE, 6) AS frequency FROM usage"),
    "usage_recent": (usage_recent, f"SELECT user_id % 50 AS chunk_id, count(*) AS n FROM events WHERE ts >= {NOW_SQL} - INTERVAL 10 DAY GROUP BY 1"),
    "score_relevance": (
        relevance,
        f"WITH {CHUNKS}, {_USAGE}, q AS (SELECT list_transform(range(64), lambda i: CASE WHEN i % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE) AS q), f AS (SELECT c.chunk_id, least(1.0, greatest(0.0, {_DOT.format('q')} / (sqrt({_DOT.format('embedding')}) * 8.0))) AS semantic, CAST({_PROX} AS DOUBLE) AS proximity,"
        f" CAST({_SYMBOL(chr(39) + 'doc_' + chr(39) + ' || c.chunk_id', chr(39) + 'doc_1' + chr(39))} AS DOUBLE) AS symbol, CAST({_DECAY('(c.chunk_id % 90)', 30.0, 0.1)} AS DOUBLE) AS recency, coalesce(helpful / total::DOUBLE * least(1.0, total / 10.0), 0)::DOUBLE AS frequency FROM chunks c CROSS JOIN q LEFT JOIN usage u ON u.chunk_id = c.chunk_id)"
        " SELECT chunk_id, round(semantic, 6) AS semantic, round(proximity, 6) AS proximity, round(symbol, 6) AS symbol, round(recency, 6) AS recency, round(frequency, 6) AS frequency, round(0.40 * semantic + 0.20 * proximity + 0.25 * symbol + 0.10 * recency + 0.05 * frequency, 6) AS score FROM f",
    ),
    "score_stores": (
        store_scores,
        f"WITH {CHUNKS} SELECT chunk_id, round((0.2 + 0.25 * 0.5 + 0.10 * exp(-0.1 * (chunk_id % 90)::DOUBLE) + 0.05 * least(chunk_id / 100.0, 1.0))::DOUBLE, 6) AS memory, round((0.2 + 0.25 * 0.8 + 0.20 * CASE WHEN label > 0 THEN 1.0 ELSE 0.5 END + 0.10 * greatest(0.1, pow(0.9, (chunk_id % 90) / 30.0)) + 0.025)::DOUBLE, 6) AS tables FROM chunks",
    ),
    "score_registered": (registered_scorers, f"WITH {CHUNKS} SELECT chunk_id, round(((least(1.0, length(content) / 5000.0) * 2 + label / 10.0) / 3.0)::DOUBLE, 6) AS score FROM chunks"),
    "intent_classify": (intents, _intent_sql()),
    "complexity_score": (complexity, _complexity_sql()),
    "route_model": (
        routes,
        "WITH a AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS t, (o_custkey % 100) / 100.0 AS c FROM orders) SELECT o_orderkey, CASE WHEN t < 8000 AND c < 0.6 THEN 'local' WHEN o_orderkey % 2 = 0 AND t < 50000 AND c < 0.7 THEN 'edge' WHEN t < 50000 AND c < 0.6 THEN 'small' WHEN t < 100000 THEN 'medium' ELSE 'large' END AS model,"
        " CASE WHEN t < 8000 THEN 'local' WHEN t < 50000 THEN 'small' ELSE 'medium' END AS simple, CASE WHEN o_orderkey % 3 = 0 AND t < 16000 THEN 'local' WHEN t < 20000 AND c < 0.5 THEN 'small' WHEN t < 100000 THEN 'medium' ELSE 'large' END AS cli, round((t * 0.7 / 1000000 * 3.0 + t * 0.3 / 1000000 * 15.0)::DOUBLE, 6) AS cost FROM a",
    ),
    "budget_running": (
        budget_running,
        "WITH RECURSIVE a AS (SELECT event_id AS id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS nth, 8239 * (CAST(floor(value) AS BIGINT) * 100) / 1000000.0::DOUBLE AS units FROM events),"
        " r AS (SELECT day, 0::BIGINT AS nth, NULL::BIGINT AS id, 0.0::DOUBLE AS units, 0.0::DOUBLE AS used, 0.0::DOUBLE AS remaining_before, false AS affordable FROM (SELECT DISTINCT day FROM a)"
        " UNION ALL SELECT a.day, a.nth, a.id, a.units, CASE WHEN a.units <= greatest(0.0, 100 - r.used) THEN r.used + a.units ELSE r.used END, greatest(0.0, 100 - r.used), a.units <= greatest(0.0, 100 - r.used) FROM r JOIN a ON a.day = r.day AND a.nth = r.nth + 1)"
        " SELECT id, round(units, 6) AS units, round(used, 6) AS used, round(remaining_before, 6) AS remaining_before, affordable, used > 90 AS alert FROM r WHERE nth > 0",
    ),
    "model_for_task": (model_for_task, "WITH prefs AS (SELECT DISTINCT p_brand AS task, p_size AS rank, string_split(p_name, ' ')[1] AS pattern FROM part), have AS (SELECT DISTINCT p_name AS model FROM part) SELECT task, first(model ORDER BY rank, model) AS model FROM prefs JOIN have ON contains(model, pattern) GROUP BY task"),
    "compress_light": (compress_light, f"WITH a AS (SELECT doc_id, {_LIGHT} AS l FROM documents) SELECT doc_id, sha256(l) AS light, length(l)::BIGINT AS n FROM a"),
    "compress_levels": (compress_levels, _LEVELS),
    "compress_language": (compress_language, None),
    "content_validation": (validated, "SELECT doc_id, strlen(text) > 0 AND strlen(text) <= 10485760 AS valid, sha256(substr(trim(text), 1, 1000)) AS clean FROM documents"),
}
QUERIES["score_relevance_top"] = (relevance_top, f"SELECT chunk_id AS id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM ({QUERIES['score_relevance'][1]}) ORDER BY score DESC, chunk_id LIMIT 20")
