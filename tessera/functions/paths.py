"""Path functions and glob predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Language by file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp",
    "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "md": "markdown",
    "json": "json", "yaml": "yaml", "yml": "yaml", "html": "html", "css": "css", "sql": "sql", "sh": "shell", "txt": "text",
}
SKIPPED = ("node_modules", ".git", "dist", "build", ".next", "coverage", "__pycache__", "target")


def normalize(p: Column) -> Column:
    return F.regexp_replace(p, r"\\", "/")


def file_name(p: Column) -> Column:
    return F.substring_index(normalize(p), "/", -1)


def extension(p: Column) -> Column:
    """Lower-case extension without dot; empty where the last dot stands before the last slash."""
    return F.lower(F.regexp_extract(file_name(p), r"\.([^.]*)$", 1))


def directory(p: Column) -> Column:
    return F.regexp_extract(normalize(p), r"^(.*)/[^/]*$", 1)


def join(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("/", *parts), "/{2,}", "/")


def is_absolute(p: Column) -> Column:
    return p.rlike(r"^(/|[A-Za-z]:[\\/])")


def make_absolute(p: Column, base: str) -> Column:
    return F.when(is_absolute(p), p).otherwise(join(F.lit(base), p))


def language(p: Column, default: str = "text") -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(table, extension(p)), F.lit(default))


def is_source(p: Column) -> Column:
    return extension(p).isin(*LANGUAGES)


def segments(p: Column) -> Column:
    return F.split(normalize(p), "/")


def common_length(a: Column, b: Column) -> Column:
    """How many leading segments two paths share."""
    same = F.zip_with(segments(a), segments(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda acc, s: F.struct((acc["n"] + F.when(acc["go"] & s, 1).otherwise(0)).alias("n"), (acc["go"] & s).alias("go")), lambda acc: acc["n"])


def distance(a: Column, b: Column) -> Column:
    return F.size(segments(a)) + F.size(segments(b)) - 2 * common_length(a, b)


def same_directory(a: Column, b: Column) -> Column:
    return directory(a) == directory(b)


def common_ancestor(a: Column, b: Column) -> Column:
    return F.array_join(F.slice(segments(a), F.lit(1), common_length(a, b)), "/")


def relative(frm: Column, to: Column) -> Column:
    """Path from a directory to a path: up by ``..``, then down."""
    up = F.array_repeat(F.lit(".."), F.size(segments(frm)) - common_length(frm, to))
    down = F.slice(segments(to), common_length(frm, to) + 1, F.size(segments(to)))
    return F.array_join(F.concat(up, down), "/")


def proximity(p: Column, current: Column) -> Column:
    """1 the same file, 0.8 the same directory, then less by distance, not below 0.1; 0.05 with nothing in common."""
    n, c, m = F.size(segments(p)), F.size(segments(current)), common_length(p, current)
    return (
        F.when(normalize(p) == normalize(current), 1.0).when(m == 0, 0.05).when((n == c) & (m == n - 1), 0.8)
        .otherwise(F.greatest(F.lit(0.1), F.lit(0.8) - (n + c - 2 * m) * F.lit(0.1)))
    )


def glob_regex(glob: str) -> str:
    """``**`` any path, ``*`` within a segment, ``?`` one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return out


def matches_glob(p: Column, glob: str, anchored: bool = True) -> Column:
    rx = glob_regex(glob)
    return p.rlike(f"^{rx}$" if anchored else f"(?i){rx}")


def matches_patterns(p: Column, include: list[str], exclude: list[str]) -> Column:
    """No include pattern means all; an exclude pattern wins."""
    ok, out = F.lit(not include), F.lit(False)
    for g in include:
        ok = ok | matches_glob(p, g)
    for g in exclude:
        out = out | matches_glob(p, g)
    return ok & ~out


def is_skipped(p: Column, parts: tuple[str, ...] = SKIPPED) -> Column:
    out = F.lit(False)
    for s in parts:
        out = out | F.contains(p, F.lit(s))
    return out


def is_safe(p: Column) -> Column:
    """No parent step, home, absolute path, drive or NUL."""
    return p.isNotNull() & (p != "") & ~F.contains(p, F.lit("..")) & ~F.contains(p, F.lit("~")) & ~is_absolute(p) & ~F.contains(p, F.lit("\0"))


def first_star_removed(pattern: str) -> str:
    return pattern.replace("*", "", 1)
