"""What a source file declares: functions, classes, imports and syntax errors.

A language is a row of patterns.  Comments and strings are blanked, which leaves lines and
columns as they are; then one walk over brackets keeps a stack of those that are open.  What
stands between the last statement's end and an opening brace is the head of its block, and a
head that fits a pattern makes the block a declaration.  A bracket that does not fit is an
error, after which the walk goes on: closing one that was opened further out ends those
inside it, any other is passed over.  Python files are read by Python's own parser.

Not modelled: templates nested in templates, nested block comments, and preprocessor branches
that open a block twice.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

#: kind, name, signature, first and last line, enclosing class, error.
Declared = tuple[str, str | None, str | None, int, int, str | None, str | None]

# Words that begin blocks but name nothing.
CONTROL = frozenset("if for while switch catch with return function else do try match loop synchronized sizeof new throw await typeof".split())
_STRING = r'"(?:[^"\\\n]|\\.)*(?P<s1>"|$)'
_BLOCK, _LINE = r"/\*.*?(?P<c1>\*/|\Z)", r"//[^\n]*"


@dataclass(frozen=True)
class Language:
    """Patterns of one language; ``blank`` finds comments and strings, the others read heads and lines without them."""

    blank: re.Pattern
    function: re.Pattern
    cls: re.Pattern
    imports: re.Pattern
    method: re.Pattern | None = None
    #: Whether the method pattern holds outside classes too.
    anywhere: bool = False


def _language(blank: list[str], function: str, cls: str, imports: str, method: str | None = None, anywhere: bool = False) -> Language:
    start = r"^[ \t]*"
    of = lambda p: re.compile(start + p, re.M)
    return Language(re.compile("|".join(blank), re.S | re.M), of(function), of(cls), of(imports), of(method) if method else None, anywhere)


_NAME = r"([A-Za-z_$][\w$]*)"
_TYPESCRIPT = _language(
    [_BLOCK, _LINE, _STRING, r"'(?:[^'\\\n]|\\.)*(?P<s2>'|$)", r"`(?:[^`\\]|\\.)*(?P<s3>`|\Z)", r"(?<=[=(,:!&|?{};])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"],
    rf"(?:export\s+|default\s+|declare\s+|async\s+)*(?:function\b\s*\*?\s*{_NAME}|(?:const|let|var)\s+{_NAME}(?:\s*:[^=;]*)?\s*=\s*(?:async\s*)?(?=(?:\([^;]*\)|[\w$]+)\s*(?::[^=;]*)?=>\s*\Z|function\b))",
    rf"(?:export\s+|default\s+|declare\s+|abstract\s+|const\s+)*(?:class|interface|enum|namespace)\s+{_NAME}",
    r"(?:import\b|export\s+(?:\*|\{[^}]*\})\s*from\b)[^;\n{]*(?:\{[^}]*\}[^;\n]*)?",
    rf"(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*\*?\s*(#?[A-Za-z_$][\w$]*)\s*(?:<[^>{{]*>)?\s*(?=\()",
)
_LANGUAGES = {
    "typescript": _TYPESCRIPT,
    "rust": _language(
        [_BLOCK, _LINE, r'\bb?r(?P<h>#*)".*?"(?P=h)', _STRING, r"'(?:\\[^\n]{1,9}?|[^'\\\n])'"],
        rf'(?:pub(?:\([^)]*\))?\s+|default\s+|async\s+|const\s+|unsafe\s+|extern\s+(?:"[^"]*"\s+)?)*fn\s+{_NAME}',
        rf"(?:pub(?:\([^)]*\))?\s+|unsafe\s+)*(?:(?:struct|enum|trait|union)\s+{_NAME}|impl\b\s*(?:<[^{{]*?>\s*)?(?:[\w:<>,' &]+\s+for\s+)?&?(?:\w+::)*{_NAME})",
        r"(?:pub(?:\([^)]*\))?\s+)?use\s+[^;]*",
    ),
    "go": _language(
        [_BLOCK, _LINE, _STRING, r"`[^`]*(?P<s3>`|\Z)", r"'(?:\\[^\n]{1,9}?|[^'\\\n])'"],
        rf"func\s*(?:\([^)]*\)\s*)?{_NAME}", rf"(?:type\s+)?{_NAME}(?:\[[^\]]*\])?\s+(?:struct|interface)\b", r"import\b[ \t]*(?:\([^)]*\)|[^\n]*)",
    ),
    "java": _language(
        [_BLOCK, _LINE, r'"""(?:[^\\]|\\.)*?(?P<s3>"""|\Z)', _STRING, r"'(?:\\[^\n]{1,9}?|[^'\\\n])'"],
        r"(?!)", rf"(?:@\w+(?:\([^)]*\))?\s+|public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+|sealed\s+|non-sealed\s+)*(?:class|@?interface|enum|record)\s+{_NAME}", r"import\b[^;]*",
        rf"(?:@\w+(?:\([^)]*\))?\s+)*(?:[\w<>\[\],.?&]+\s+)*{_NAME}\s*(?=\()",
    ),
    "cpp": _language(
        [_BLOCK, _LINE, r'R"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)"', _STRING, r"'(?:\\[^\n]{1,9}?|[^'\\\n])'", r"^[ \t]*#(?!\s*include)(?:[^\n\\]|\\.)*"],
        r"(?!)", rf"(?:template\s*<[^;{{]*>\s*|typedef\s+|static\s+)*(?:enum\s+(?:class\s+)?|class\s+|struct\s+|union\s+)(?:alignas\([^)]*\)\s*)?{_NAME}", r"#\s*include\b[^\n]*|(?:using|import)\s+[^;{]*",
        r"(?!(?:public|private|protected)\s*:)(?:template\s*<[^;{]*>\s*)?(?:[\w:<>,*&~\[\]]+[\s*&]+)*((?:[A-Za-z_]\w*(?:<[^<>]*>)?::)*(?:~?[A-Za-z_]\w*|operator\s*[^\s\w(]{1,3}))\s*(?=\()", anywhere=True,
    ),
}
_LANGUAGES |= {"javascript": _TYPESCRIPT, "c++": _LANGUAGES["cpp"]}
#: Settings that all languages share: preferred characters of a chunk and its most lines.
PREFERRED_CHUNK_SIZE, MAX_LINES = 512, 200
SUPPORTED = ("typescript", "javascript", "python", "rust", "go", "java", "cpp")
_BRACKET = re.compile(r"[(){}\[\];]")
_PAIRS = {")": "(", "]": "[", "}": "{"}


def language(name: str | None) -> Language:
    """Patterns by name; an unknown language is read like TypeScript."""
    return _LANGUAGES.get(name or "", _TYPESCRIPT)


def _blanked(code: str, lang: Language) -> tuple[str, list[tuple[int, str]]]:
    """The code with comments and strings as spaces, and where one does not end."""
    errors: list[tuple[int, str]] = []

    def blank(m: re.Match) -> str:
        groups = m.groupdict()
        if groups.get("c1") == "":
            errors.append((m.start(), "comment does not end"))
        if any(groups.get(g) == "" for g in ("s1", "s2", "s3")):
            errors.append((m.start(), "string does not end"))
        return re.sub(r"[^\n]", " ", m[0])

    return lang.blank.sub(blank, code), errors


def _whole(head: str) -> bool:
    """Whether parentheses in a head are closed and no control word follows the last."""
    if head.count("(") != head.count(")"):
        return False
    return not CONTROL.intersection(re.findall(r"\w+", head[head.rfind(")") + 1 :] if ")" in head else ""))


def _named(pattern: re.Pattern | None, head: str) -> tuple[str, int] | None:
    """Name and offset of the last line in a head that a declaration begins at."""
    found = None
    for m in pattern.finditer(head) if pattern else ():
        name = next((g for g in m.groups() if g), None)
        if name and name not in CONTROL and _whole(head[m.start() :]):
            found = name, m.end() - len(m[0].lstrip())
    return found


def braced(code: str, name: str | None) -> Iterator[Declared]:
    """Declarations of a file in a language of braces, as they end."""
    lang = language(name)
    blank, errors = _blanked(code, lang)
    breaks = [m.start() for m in re.finditer("\n", blank)]
    line = lambda at: bisect_right(breaks, at - 1) + 1
    stack: list[list] = [["", 0, 0, None]]  # bracket, offset, where the statement began, declaration

    def enclosing() -> str | None:
        return next((f[3][1] for f in reversed(stack) if f[3] and f[3][0] == "class"), None)

    def ended(frame: list, at: int) -> Iterator[Declared]:
        if frame[3]:
            kind, own, start = frame[3]
            yield kind, own, code[start : frame[1]].strip(), line(start), line(at), enclosing(), None

    for m in lang.imports.finditer(blank):
        text = code[m.start() : m.end()].strip()
        yield "import", None, text, line(m.end() - len(m[0].lstrip())), line(m.start() + len(m[0].rstrip()) - 1), None, None
    for m in _BRACKET.finditer(blank):
        sign, at = m[0], m.start()
        if sign == ";":
            stack[-1][2] = at + 1
        elif sign in "({[":
            made = None
            if sign == "{":
                head = blank[stack[-1][2] : at]
                inside = stack[-1][3]
                if hit := _named(lang.cls, head):
                    made = ("class", hit[0], stack[-1][2] + hit[1])
                elif hit := _named(lang.function, head) or (_named(lang.method, head) if (inside and inside[0] == "class") or (lang.anywhere and not inside) else None):
                    made = ("function", hit[0], stack[-1][2] + hit[1])
            stack.append([sign, at, at + 1, made])
        elif any(f[0] == _PAIRS[sign] for f in stack):
            while stack[-1][0] != _PAIRS[sign]:
                errors.append((stack[-1][1], f"{stack[-1][0]} is not closed"))
                yield from ended(stack.pop(), at)
            yield from ended(stack.pop(), at)
            if sign == "}":
                stack[-1][2] = at + 1
        else:
            errors.append((at, f"{sign} closes nothing"))
    while len(stack) > 1:
        errors.append((stack[-1][1], f"{stack[-1][0]} is not closed"))
        yield from ended(stack.pop(), len(blank))
    for at, what in errors:
        yield "error", None, None, line(at), line(at), None, what


def python(code: str) -> Iterator[Declared]:
    """The same of a Python file."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError) as e:
        at = getattr(e, "lineno", None) or 1
        yield "error", None, None, at, at, None, getattr(e, "msg", None) or str(e)
        return
    lines = code.split("\n")
    queue: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while queue:
        node, parent = queue.pop()
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "function"
                yield kind, n.name, lines[n.lineno - 1].strip(), n.lineno, n.end_lineno, parent, None
                queue.append((n, n.name if kind == "class" else parent))
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                yield "import", None, lines[n.lineno - 1].strip(), n.lineno, n.end_lineno, parent, None
            else:
                queue.append((n, parent))


def declared(code: str | None, name: str | None) -> list[Declared]:
    """All of a file, by line."""
    found = python(code or "") if name == "python" else braced(code or "", name)
    return sorted(found, key=lambda d: (d[3], -d[4], d[0], d[1] or "", d[2] or ""))
