"""Source files into chunks: functions, methods and classes' heads, and what lies between.

Python's structure comes from the standard library's parser. Languages with braces are read by a scanner that knows
strings and comments, which is an approximation of a parser. Other languages give one chunk a file.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from quarry.schema import CHUNK, SUFFIXES

#: Languages by suffix.
LANGUAGES = {
    ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hh": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".cs": "csharp", ".dart": "dart", ".ex": "elixir", ".exs": "elixir", ".go": "go",
    ".java": "java", ".js": "javascript", ".cjs": "javascript", ".mjs": "javascript", ".jsx": "javascript", ".kt": "kotlin", ".kts": "kotlin", ".lua": "lua", ".m": "objc", ".mm": "objc", ".php": "php",
    ".py": "python", ".pyi": "python", ".rb": "ruby", ".rs": "rust", ".scala": "scala", ".sc": "scala", ".swift": "swift", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".ts": "typescript", ".tsx": "tsx", ".zig": "zig",
}


#: What ends a line for Python's parser.
_LINE_END = re.compile(rb"\r\n|\r|\n")


@dataclass
class Item:
    """Something with a name in a source; offsets in bytes."""

    kind: str
    name: str
    start: int
    end: int
    inside: list[Item] = field(default_factory=list)


def python_items(source: str) -> list[Item]:
    """Top-level and nested definitions; none of a source that isn't Python, or is nested too deeply for its parser."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the parser tells of a full stack by MemoryError
        return []
    lines = [0, *(m.end() for m in _LINE_END.finditer(source.encode("utf-8", "replace")))]

    def walk(body: list[ast.stmt]) -> list[Item]:
        out = []
        for node in body:
            span = (lines[node.lineno - 1] + node.col_offset, lines[node.end_lineno - 1] + node.end_col_offset)
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append(Item("function", node.name, *span))
            elif isinstance(node, ast.ClassDef):
                out.append(Item("class", node.name, *span, walk(node.body)))
            else:
                for name in ("body", "orelse", "finalbody"):
                    out += walk(getattr(node, name, []))
                for handler in getattr(node, "handlers", []):
                    out += walk(handler.body)
        return out

    return walk(tree.body)


#: What the brace scanner skips: comments and strings.
_SKIP = re.compile(rb"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_CLASS = re.compile(rb"(?:^|[;{}\n])[ \t]*(?:(?:export|default|public|private|protected|abstract|final|static|sealed|data|open|pub(?:\([^)]*\))?)\s+)*(?P<w>class|interface|struct|trait|enum|impl)\s+(?P<n>[A-Za-z_]\w*)[^;{}]*\{")
_FUNCTION = re.compile(rb"(?:^|[;{}\n])[ \t]*(?:(?:export|default|async|public|private|protected|static|override|pub(?:\([^)]*\))?)\s+)*(?:function\b\s*\*?|func\b(?:\s*\([^)]*\))?|fn\b|fun\b)\s*(?P<n>[A-Za-z_]\w*)[^;{}]*\{")
_ARROW = re.compile(rb"(?:^|[;{}\n])[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<n>[A-Za-z_]\w*)\s*=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*=>\s*\{")
_METHOD = re.compile(rb"(?:^|[;{}\n])[ \t]*(?:[\w<>\[\],.?]+\s+)*(?P<n>[A-Za-z_]\w*)\s*\([^;{}]*\)[^;{}()]*\{")
_WORDS = {b"if", b"for", b"while", b"switch", b"catch", b"return", b"else", b"do", b"function", b"with", b"match", b"unless"}


def brace_items(source: str) -> list[Item]:
    raw = source.encode()
    bare = _SKIP.sub(lambda m: re.sub(rb"[^\n]", b" ", m[0]), raw)
    close, opened = {}, []
    for m in re.finditer(rb"[{}]", bare):
        if m[0] == b"{":
            opened.append(m.start())
        elif opened:
            close[opened.pop()] = m.end()

    def found(a: int, b: int, in_class: bool) -> list[Item]:
        out, at = [], a
        patterns = [("class", _CLASS), ("function", _FUNCTION), ("function", _ARROW)] + [("method", _METHOD)] * in_class
        while True:
            hits = [(m.start("n"), kind, m) for kind, p in patterns if (m := _next(p, bare, at, b))]
            if not hits:
                return out
            _, kind, m = min(hits, key=lambda x: (x[2].end(), x[0]))
            begin = m.start() + len(m[0]) - len(m[0].lstrip(b";{}\n \t"))
            end = min(close.get(m.end() - 1, b), b)
            item = Item(kind, m["n"].decode(), begin, end)
            if kind == "class":
                item.inside = found(m.end() - 1, end - 1, True)
            out.append(item)
            at = end - 1 if end > m.end() else m.end()

    return found(0, len(bare), False)


def _next(pattern: re.Pattern[bytes], bare: bytes, at: int, end: int) -> re.Match[bytes] | None:
    while m := pattern.search(bare, at, end):
        if m["n"] not in _WORDS:
            return m
        at = m.end() - 1
    return None


#: A language's structure; others have none.
PROVIDERS: dict[str, Callable[[str], list[Item]]] = {"python": python_items} | dict.fromkeys(("javascript", "typescript", "tsx", "jsx", "java", "kotlin", "go", "rust", "c", "cpp", "csharp", "swift", "dart", "php", "scala"), brace_items)


def _line_start(raw: bytes, at: int) -> int:
    return raw.rfind(b"\n", 0, at) + 1


def _with_decorators(raw: bytes, at: int) -> int:
    """The start of the line, or of the first of the lines right above that begin with @."""
    at = _line_start(raw, at)
    while at and raw[(before := _line_start(raw, at - 1)) : at].strip().startswith(b"@"):
        at = before
    return at


def _spans(items: list[Item], raw: bytes, classes: tuple[str, ...]) -> Iterator[tuple[int, int, str, str]]:
    for x in items:
        if x.kind in ("function", "method"):
            kind = "method" if classes or x.kind == "method" else "function"
            yield _with_decorators(raw, x.start), x.end, kind, ".".join((*classes, x.name))
        else:
            inner = min((_with_decorators(raw, y.start) for y in x.inside), default=x.end)
            if raw[x.start : (end := inner if inner > x.start else x.end)].strip():
                yield x.start, end, "class", x.name
            yield from _spans(x.inside, raw, (*classes, x.name))


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return name[dot:].lower() if 0 < dot < len(name) - 1 else ""


def chunk_source(source: str, file_path: str, language: str | None = None) -> list[tuple]:
    """The chunks of a source as rows of CHUNK: none of a blank source or an unknown suffix, the whole file where no structure is found."""
    suffix = suffix_of(file_path)
    if not source.strip() or suffix not in SUFFIXES:
        return []
    language = language.lower() if language else LANGUAGES.get(suffix)
    raw = source.encode("utf-8", "replace")
    try:
        spans = sorted(_spans(PROVIDERS[language](source), raw, ())) if language in PROVIDERS else []
    except RecursionError:  # nested too deeply for us: as a file without structure
        spans = []

    def row(a: int, b: int, kind: str, name: str | None) -> tuple:
        line = lambda at: raw.count(b"\n", 0, at) + 1
        return raw[a:b].decode("utf-8", "replace"), file_path, line(a), line(max(a, b - 1)), kind, name, language

    if not spans:
        return [row(0, len(raw), "file", None)]
    out, at = [], 0
    for a, b, kind, name in spans:
        if a > at and raw[at:a].strip():
            out.append(row(at, a, "module", None))
        out.append(row(a, b, kind, name))
        at = max(at, b)
    if raw[at:].strip():
        out.append(row(at, len(raw), "module", None))
    return out


def chunk_files(files: DataFrame) -> DataFrame:
    """file_ord, nth and CHUNK of each file's chunks. files: file_ord, content, file_path."""
    names = [x.split(" ")[0] for x in CHUNK.split(", ")]

    def run(given: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in given:
            rows = [(o, n, *r) for o, c, p in zip(frame["file_ord"], frame["content"], frame["file_path"]) for n, r in enumerate(chunk_source(c or "", p))]
            yield pd.DataFrame(rows, columns=["file_ord", "nth", *names])

    return files.select("file_ord", "content", "file_path").mapInPandas(run, f"file_ord long, nth long, {CHUNK}")
