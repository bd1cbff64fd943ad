"""Secret scans: assignments are lexed into names and literals, constants are followed, and names say which literals are secrets."""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import batches, texts

#: The base patterns, by kind in their order, and how long what they find must be.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "named")
#: A run of 32 hexadecimal digits holds a whole aligned block of 16; this finds them without trying at each letter.
HEX_RUN = re.compile(r"[0-9a-f]{32,}")

#: Points for the parts of a target's name. A literal is a secret from SECRET points on.
NAME_POINTS = {
    "password": 5, "passwd": 5, "pwd": 5, "pass": 3, "passphrase": 5, "secret": 5, "token": 4, "apikey": 5, "credential": 5, "credentials": 5, "privatekey": 5, "accesskey": 5,
    "auth": 3, "authorization": 4, "bearer": 4, "private": 2, "access": 2, "api": 2, "key": 2, "client": 1, "session": 2, "signing": 2, "encryption": 2, "signature": 2, "connection": 1, "salt": 3, "cookie": 2,
}
#: Parts of a name that say it holds no secret itself.
NAME_MINUS = {"public": 4, "path": 3, "file": 3, "url": 2, "name": 3, "id": 1, "type": 3, "length": 5, "len": 5, "count": 5, "size": 5, "max": 3, "min": 3, "expires": 4, "limit": 4, "field": 3, "label": 3, "prompt": 4}
SECRET = 6
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|_+|0+|none|null|nil|true|false|undefined|todo|changeme|change_me|example.*|dummy.*|sample.*|placeholder.*|your.*|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|\$\w+)$")

OPERATOR = re.compile(r"[:=]+>?")
NAME_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.$-")
SPACES = re.compile(r"[\x20\t]*")
STRING = re.compile(r"(?:[rbfuRBFU]{0,2})(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`)")
QUOTES = frozenset("rbfuRBFU\"'`")
QUOTE = re.compile(r"[rbfuRBFU]{0,2}([\"'`])")
#: What the lexer stops at: a comment's start, an element with text, a string, an operator. A quote after a letter or digit is an apostrophe, unless the letters are a string's prefix.
STOP = re.compile(r"(?P<comment>(?<!\S)(?:#+|//+|/\*+|<!--|--)(?=[\s\w]))|(?P<tag><(?=[A-Za-z_]))|(?P<quote>(?:(?<![A-Za-z0-9_])[rbfuRBFU]{1,2}|(?<![A-Za-z0-9_]))[\"'`])|(?P<op>[:=]+>?)")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)([^<>]*)>([^<>]*)</")
NAMING = re.compile(r"\b(?:name|key|id)=[\"']([^\"'<>]*)[\"']")
WORD = re.compile(r"[A-Za-z0-9+/_.\-@$!%^&*~]+")
PADDING = re.compile(r"={1,2}(?![^\s,;\"')\]}])")
IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*$")
JOIN = re.compile(r"[\x20\t]*(?:\\?\n[\x20\t]*)?(?:\+|\.\.?|(?<=[\x20\t])&(?=[\x20\t]))(?:[\x20\t]*\\?\n)?[\x20\t]*(?=[\"'`A-Za-z_$])")
#: Strings after one another are one, as in C and Python.
ADJACENT = re.compile(r"[\x20\t]*(?:\\\n[\x20\t]*)?(?=[rbfuRBFU]{0,2}[\"'])")
BLOCK = re.compile(r"[|>][+\-0-9]{0,2}[\x20\t]*\n")
LINE = re.compile(r"([\x20\t]*)([^\n]*)(?:\n|$)")
#: A joined value is judged by so many characters of each part; its spans are whole.
MOST_JOINED = 4096
#: A declared type and its `=`: `: str =`, `: Optional[str] =`, `: &'static str =`, `: String? =`, `: a.B<C> | null =`. Without a space before `=`, the type is a known one and a string follows.
_ATOM = r"&?(?:'[a-z_]+[\x20\t]+)?(?:(?:mut|dyn|const|readonly)[\x20\t]+)?[*&]*[A-Za-z_][\w.]*(?:::\w+)*(?:<[^<>=:;\n]*(?:<[^<>=:;\n]*>[^<>=:;\n]*)*>|\[[^\[\]=:;\n]*(?:\[[^\[\]=:;\n]*\][^\[\]=:;\n]*)*\])*+[?!*]*"
_KNOWN = "str|string|String|bytes|Bytes|char|any|Any|object|Text|SecretStr|CharSequence|NSString"
TYPED = re.compile(rf"[\x20\t]*(?:{_ATOM}(?:[\x20\t]*[|&][\x20\t]*{_ATOM})*[\x20\t]+=(?![=>~])|(?:{_KNOWN})\??=(?=[rbfuRBFU]{{0,2}}[\"'`]))")
#: `name type =`: what stands before a type, and the types that are known without `var`.
LAST_TYPE = re.compile(r"(?:\[\d*\]|\*|map\[\w+\])*([A-Za-z_][\w.]*)$")
TYPES = frozenset(_KNOWN.split("|")) | {"byte", "rune", "error", "interface"}
DECLARES = frozenset("var let const val static final public private protected readonly mut unsigned signed export default def auto local my our global".split())
TRIPLE = re.compile(r"[rbfuRBFU]{0,2}(\"\"\"|\'\'\')")
#: What is called, or made with brackets, and names of calls whose first string is a key.
CALL = re.compile(r"(?:(?:new|await)[\x20\t]+)?&?(?:\[\d*\])*([A-Za-z_$][\w$.]*(?:(?:::|->|\?\.)[A-Za-z_$][\w$.]*)*)(?:!(?=[\[({])|(?:<[^<>=\n]*>)?(?:\[\])?(?=[({]))")
LOOKUP = re.compile(r"(?i)(?:get|env|lookup|fetch|read|load|find|resolve|param|input|prompt|ask)[a-z]*$")
OPENS = re.compile(r"&?(?:\[\d*\](?=\{))?(?=[\[({])")
VALUE_KEYS = frozenset(("value", "default", "fallback"))
BLANK = re.compile(r"\s+")
BARE = re.compile(r"[A-Za-z0-9_$+/][A-Za-z0-9+/_.$@%^&*~\-]*")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


class Pair(NamedTuple):
    """A name and what is assigned to it: values, one of which it has, each of joined parts; a part is a literal's span or a name."""

    name: str
    values: tuple[tuple[tuple[int, int] | str, ...], ...]


@dataclass
class Cell:
    """What a name holds: values of joined parts, each a literal's span or another cell, and the most points with which it has been looked at. No value is copied, so names that add to themselves stay cheap."""

    values: list[list[tuple[int, int] | Cell]]
    points: int = 0
    text: str = ""  # of its only value, as far as it is needed to judge what it is joined to


def base_spans(text: str) -> list[Span]:
    """The matches of the base patterns that are long enough; each pattern's are leftmost and don't overlap."""
    found = []
    if "=" in text or ":" in text:
        found += [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [Span("hex", *m.span()) for m in HEX_RUN.finditer(text)]
    return found


def _name_before(text: str, at: int, floor: int) -> str:
    """The name that ends before the operator at `at`, not reaching back beyond floor: quotes, brackets and spaces between are skipped.

    In `name type =` it is the first, if the second is a known type or `var` stands before.
    """
    end = at
    if text[at] == ":" and end > floor and text[end - 1] in "?!":
        end -= 1
    while end > floor and text[end - 1] in " \t":
        end -= 1
    while end > floor and text[end - 1] in "\"'])":
        end -= 1
    start = end
    while start > floor and text[start - 1] in NAME_LETTERS:
        start -= 1
    name = text[start:end].strip(".-$")
    if text[at] == "=" and name and start > floor:
        *_, how, first, second = ["", "", "", *text[max(floor, text.rfind("\n", floor, at) + 1) : at].split()]
        if IDENTIFIER.match(first) and first not in DECLARES and first not in TYPES and (last := LAST_TYPE.match(second)) and (how == "var" or last[1] in TYPES):
            return first
    return name


class Lexer:
    """Assignments of a text, lexed from left to right; what has been read as a value isn't read again.

    Strings are whole: operators in them assign nothing here, but a string that holds assignments itself (a connection
    string, say) is lexed as a text of its own. A comment's start ends what stands before it; its words are lexed.
    """

    def __init__(self, text: str, start: int = 0, end: int | None = None, nested: bool = False) -> None:
        self.text, self.start, self.end, self.nested = text, start, len(text) if end is None else end, nested
        self.open: dict[str, int] = {}  # up to where no string of a quote ends
        self.strings: list[tuple[int, int]] = []

    def string(self, at: int) -> tuple[tuple[int, int], int] | None:
        """A string at a place: the span of what it holds (of triple quotes, without spaces around), and its end."""
        text = self.text
        if t := TRIPLE.match(text, at, self.end):
            if self.open.get(t[1], 0) <= at and (end := text.find(t[1], t.end(), self.end)) >= 0:
                inner = text[t.end() : end]
                start = t.end() + len(inner) - len(inner.lstrip())
                return (start, max(start, t.end() + len(inner.rstrip()))), end + 3
            self.open[t[1]] = self.end
        if not (q := QUOTE.match(text, at, self.end)) or self.open.get(quote := q[1], 0) > at:
            return None
        if s := STRING.match(text, at, self.end):
            span = s.span(s.lastindex or 1)
            if any(c in "=:" for c in text[slice(*span)]):
                self.strings.append(span)
            return span, s.end()
        line = text.find("\n", at, self.end) if quote != "`" else -1
        self.open[quote] = line if line >= 0 else self.end
        return None

    def inside(self, at: int, callee: str) -> tuple[list[tuple], int]:
        """The values in the brackets that open at a place, over lines, up to their end or the next assignment in them.

        A string that a call looks up, or that itself says a secret's name, is a key. Words without quotes are literals in lists.
        """
        text, values, depth, first, here, joined = self.text, [], [], True, at, False
        while here < self.end:
            c = text[here]
            if m := BLANK.match(text, here, self.end):
                here = m.end()
                continue
            before, joined = joined, False
            if c in "[({":
                depth.append(c)
                here += 1
            elif c in "])}":
                depth.pop()
                here += 1
                if not depth:
                    break
            elif found := self.string(here):
                span, end = found
                value = text[slice(*span)]
                if text.startswith((":", "=>"), SPACES.match(text, end, self.end).end()):
                    break
                here = end
                key = callee and (first and LOOKUP.search(callee) or name_points(value) > 0 and not any(x.isdigit() for x in value))
                if not key and before and values:
                    values[-1] += (span,)
                elif not key:
                    values.append((span,))
                joined, first = not key, False
            elif m := BARE.match(text, here, self.end):
                word, end = m[0], m.end()
                after = SPACES.match(text, end, self.end).end()
                if m2 := OPERATOR.match(text, after, self.end):
                    to = SPACES.match(text, m2.end(), self.end).end()
                    if word not in VALUE_KEYS or text[after] not in "=:" or not STRING.match(text, to, self.end):
                        break
                    here = to
                    continue
                here = end
                if IDENTIFIER.match(word):
                    values.append((word,))
                    if depth[-1] == "[" and not callee and text[after : after + 1] in (",", "]"):
                        values.append((m.span(),))
                elif depth[-1] == "[" and not callee:
                    values.append((m.span(),))
            elif OPERATOR.match(text, here, self.end):
                break
            else:
                joined = before and c in "+&."
                here += 1
        return values, here

    def value(self, here: int) -> tuple[list[tuple], int]:
        """What is assigned: joined strings and names, what brackets hold, or what a call is given; and up to where it has been read for good."""
        text, parts = self.text, ()
        read = here
        while True:
            c = text[here : here + 1]
            if c in QUOTES and (s := self.string(here)):
                parts += (s[0],)
                end = read = s[1]
                more = JOIN.match(text, end, self.end) or ADJACENT.match(text, end, self.end)
            elif (call := CALL.match(text, here, self.end)) or c in "&[({" and (o := OPENS.match(text, here, self.end)):
                values, end = self.inside((call or o).end(), call[1] if call and text[call.end()] == "(" else "")
                return ([parts] if parts else []) + values, end
            elif s := WORD.match(text, here, self.end):
                word = s[0].rstrip(".")
                end = here + len(word)
                if (p := PADDING.match(text, end, self.end)) and len(word) >= 8 and (len(word) + len(p[0])) % 4 == 0:
                    end = p.end()
                elif OPERATOR.match(text, s.end(), self.end) and "&" in word:  # of a=x&b=y, the first
                    end = here + word.index("&")
                    word = text[here:end]
                more = JOIN.match(text, end, self.end)
                if IDENTIFIER.match(text, here, end):
                    parts += (word,) if more or parts else ((here, end),)  # alone, it is a literal unless a name before stands for it
                else:
                    parts += ((here, end),)
                    read = end
            else:
                break
            if not more:
                break
            here = more.end()
        return [parts] if parts else [], read

    def block(self, at: int, indent: int) -> tuple[list[tuple], int]:
        """The lines from a place on that are indented more, each a value."""
        values = []
        while at < self.end:
            m = LINE.match(self.text, at, self.end)
            words = m[2].strip()
            if words and len(m[1]) <= indent:
                break
            if words:
                values.append(((m.start(2), m.start(2) + len(m[2].rstrip())),))
            at = max(m.end(), at + 1)
        return values, at

    def pairs(self) -> Iterator[Pair]:
        text, floor, at, line, key = self.text, self.start, self.start, self.start, ""
        looked = self.start  # up to where line has been looked for
        while m := STOP.search(text, at, self.end):
            here = m.start()
            at = m.end()
            if m["comment"]:
                floor = at
            elif m["tag"]:
                if e := ELEMENT.match(text, here, self.end):
                    inner = e[3].strip()
                    start = e.start(3) + e[3].find(inner)
                    names = " ".join([key, e[1], *NAMING.findall(e[2])])
                    key = inner if e[1] == "key" else ""
                    if inner and e[1] != "key" and not any(c.isspace() for c in inner):
                        yield Pair(names, (((start, start + len(inner)),),))
                    if not e[2]:  # without attributes, all is read
                        floor = at = e.end(3)
            elif m["quote"]:
                if found := self.string(here):
                    at = found[1]
            else:
                op = m["op"]
                name = _name_before(text, here, floor)
                typed = TYPED.match(text, at, self.end) if name and op == ":" else None
                floor = at = (typed or m).end()
                if not name or op not in ("=", ":", ":=", "=>", "::=") or here and text[here - 1] in "!<>" and not typed:
                    continue
                begin = SPACES.match(text, at, self.end).end()
                if op == ":" and (b := BLOCK.match(text, begin, self.end)):
                    if (new := text.rfind("\n", looked, here)) >= 0:
                        line = new + 1
                    looked = here
                    values, at = self.block(b.end(), len(LINE.match(text, line, self.end)[1]))
                else:
                    values, read = self.value(begin)
                    at = max(at, read)
                floor = max(floor, at)
                yield Pair(name, tuple(values))
        if not self.nested:
            for a, b in self.strings:
                yield from Lexer(text, a, b, True).pairs()


def pairs(text: str) -> Iterator[Pair]:
    """The assignments of a text: `name = "x"`, `name: x`, `"name": "x"`, `name => 'x'`, `NAME=x`, `a["name"] = x`, `<name>x</name>`, block scalars.

    `name: type = x` and `name type = x` are one assignment to the name; joined strings are one value. `==`, `!=`, `<=` and
    `>=` compare. The text is gone through once, and once more in its strings, so the work is in proportion to it.
    """
    return Lexer(text).pairs()


@functools.lru_cache(4096)
def name_points(name: str) -> int:
    """How much a name says that it holds a secret; neighbouring parts also count as one (`api_key`)."""
    parts = [x.lower() for x in PARTS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    return max((NAME_POINTS.get(x, 0) for x in parts + joined), default=0) + sum(1 for x in parts if NAME_POINTS.get(x, 0) >= 2) - sum(NAME_MINUS.get(x, 0) for x in parts)


def literal_points(value: str) -> int:
    """How much a literal looks like a secret: length, kinds of characters, entropy; words and placeholders lose."""
    if len(value) < 8 or PLACEHOLDER.match(value) or "://" in value and "@" not in value or any(c.isspace() for c in value):
        return -10
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    return (kinds >= 2) + (kinds >= 3) + (entropy >= 2.5) + (entropy >= 3.5) - 3 * (kinds == 1 and not value.isdigit() and len(value) < 20)


def _spans_of(value: list[tuple[int, int] | Cell]) -> Iterator[tuple[int, int]]:
    """The spans of all that a value is joined of."""
    todo, seen = list(value), set()
    while todo:
        x = todo.pop()
        if not isinstance(x, Cell):
            yield x
        elif id(x) not in seen:
            seen.add(id(x))
            todo += (y for v in x.values for y in v)


def named_spans(text: str) -> list[Span]:
    """Literals that reach a name which says it's a secret, over constants as well: `a = "x"`, then `password = a`.

    A name holds what was last assigned to it before; a literal that names assigned before stand for isn't a literal. Of
    joined parts, constants among them, the whole is judged, and all parts are reported; so is a part that is a secret alone.
    """
    held: dict[str, Cell] = {}
    out = set()

    def part(x: tuple[int, int] | str) -> tuple[int, int] | Cell | None:
        return held.get(x) if isinstance(x, str) else held.get(text[slice(*x)], x)

    def said(x: tuple[int, int] | Cell) -> str:
        return x.text if isinstance(x, Cell) else text[x[0] : min(x[1], x[0] + MOST_JOINED)]

    for name, values in pairs(text):
        cell = Cell([v for v in ([y for y in map(part, value) if y is not None] for value in values) if v])
        if len(cell.values) == 1:
            cell.text = "".join(map(said, cell.values[0]))[:MOST_JOINED]
        held[name] = cell
        if (points := name_points(name)) > 0:
            todo = [cell]
            while todo:
                if (cell := todo.pop()).points >= points:
                    continue
                cell.points = points
                for value in cell.values:
                    todo += (x for x in value if isinstance(x, Cell))
                    out.update(Span("named", *x) for x in value if not isinstance(x, Cell) and points + literal_points(text[slice(*x)]) >= SECRET)
                    if len(value) > 1 and points + literal_points("".join(map(said, value))) >= SECRET:
                        out.update(Span("named", *x) for x in _spans_of(value) if x[0] < x[1])
    return sorted(out, key=lambda x: x[1:])


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans and all spans, both by start, then kind."""
    base = base_spans(text)
    order = lambda x: (x.start, KINDS.index(x.kind), x.end)
    more = named_spans(text) if "=" in text or ":" in text or "<" in text else []
    return sorted(base, key=order), sorted(base + more, key=order)


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with each run of spans replaced by the mark; of an assignment, the name stays."""
    spans = []
    for kind, start, end in scan(text)[1]:
        spans.append((ASSIGN.match(text, start).start(2) if kind == "assign" else start, end))
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def _said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_named.

    Spans are kind:start:end in code points. Whole texts are scanned; a null text is empty and has no spans. Repeated
    rows give repeated results, an empty table none; other columns don't matter.
    """
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long"

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(given, text):
            rows = [scan(x) for x in texts(batch, text)]
            count = lambda k, i=0: pa.array([sum(s.kind == k for s in r[i]) for r in rows], pa.int64())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), count("assign"), count("access"), count("hex"), pa.array([hashlib.sha256(_said(r[0]).encode()).hexdigest() for r in rows]), pa.array([_said(r[1]) for r in rows]), count("named", 1)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named"],
            )

    return docs.select(key, text).mapInArrow(run, schema)


def clean(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """All documents with their columns; secrets in the text are replaced by a mark, and the length goes with the text.

    A document without secrets, or with a null text, stays as it is, whatever its other columns hold. Rows are looked at one
    by one, whole texts at a time: repeated rows stay repeated, an empty table stays empty.
    """

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(given, text):
            old = batch.column(text).to_pylist()
            new = [x and redact(x) for x in old]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns[text] = pa.array(new, batch.schema.field(text).type)
            if length in columns:
                was = columns[length].to_pylist()
                columns[length] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, was)], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, docs.schema)
