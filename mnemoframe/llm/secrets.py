"""Secret scan: base patterns plus an assignment-aware lexer.

The lexer reads source and configuration syntax into statements of a name and its parts (literals and other names):
``name = "x" + other``, ``name += 'x'``, ``"name": 'x'``, ``name=x``, lists, strings over several lines, blocks
(``name: |``), calls (``put("name", "x")``), ``--name x`` and ``<name>x</name>``. A symbol table propagates constants:
a name stands for its last definition before, or else its first one after, the place where it is used. Literals are
scored by the names that they reach.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Span, span_digest, span_text

KINDS = ("assign", "access", "hex")
#: Kind of the spans that the lexer adds.
LEXED = "lexed"
ALL_KINDS = (*KINDS, LEXED)

ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Whole runs only, so the length can be part of the pattern without changing what is found.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: How sensitive a word of a name is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "apikey": 1.0,
    "token": 0.9, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0,
    "pass": 0.8, "auth": 0.7, "bearer": 0.8, "signature": 0.5, "salt": 0.5, "key": 0.5,
}
#: Literals that stand for a secret without being one.
PLACEHOLDERS = frozenset("changeme example placeholder none null true false undefined redacted todo".split())

_LITERAL = r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|'\'\'(?:[^\\]|\\.)*?'\'\'|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
_BARE = r"\$?\{?[^\s\"'`;,<>(){}\[\]+|]+\}?"
_VALUE = rf"(?:{_LITERAL}|{_BARE})"
_OPERATOR = r"[ \t]*(?P<operator>:=|=>|\+=|=(?!=)|:(?!:|//))[ \t]*"
#: A name begins where a word does, or long words would be read again from each character.
_NAME = r"(?P<quote>[\"']?)(?<![\w.\-])(?P<name>[A-Za-z_][\w.\-]*)(?P=quote)"
STATEMENT = re.compile(rf"{_NAME}{_OPERATOR}(?P<value>{_VALUE}(?:[ \t]*(?:\\?\n[ \t]*)?\+[ \t]*(?:\\?\n[ \t]*)?{_VALUE})*)", re.A | re.S)
LISTED = re.compile(rf"{_NAME}{_OPERATOR}[\[(]\s*(?P<value>(?:{_LITERAL})(?:\s*,\s*(?:{_LITERAL}))*)", re.A | re.S)
CALL = re.compile(rf"[(,]\s*(?P<quote>[\"'])(?P<name>[A-Za-z_][\w.\-]*)(?P=quote)\s*,\s*(?P<value>{_LITERAL})", re.A | re.S)
FLAG = re.compile(rf"(?<!\S)--(?P<name>[A-Za-z][\w\-]*)[ \t]+(?P<value>{_LITERAL}|[^\s\"'-][^\s\"']*)", re.A | re.S)
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.\-]*)>(?P<value>[^<>\n]+)</(?P=name)>", re.A)
BLOCK = re.compile(r"^(?P<indent>[ \t]*)(?P<name>[A-Za-z_][\w.\-]*):[ \t]*[|>][+-]?[ \t]*\n(?P<value>(?:(?P=indent)[ \t]+\S[^\n]*(?:\n|\Z))+)", re.A | re.M)
#: What a text needs for a statement of any syntax.
MARKS = ("=", ":", "--", "</", "('", '("', ", '", ', "')
PART = re.compile(_VALUE, re.A | re.S)
LITERAL = re.compile(_LITERAL, re.A | re.S)
REFERENCE = re.compile(r"\$?\{?([A-Za-z_][\w.]*)\}?", re.A)
LINE = re.compile(r"\S[^\n]*")
#: Longest text that can stand for a secret without being one.
_SHORT = 16
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def base_spans(text: str) -> list[Span]:
    """The fixed patterns: leftmost, non-overlapping within a kind, failing matches dropped."""
    spans: list[Span] = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans + [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]


def name_score(name: str) -> float:
    """The most sensitive word, or pair of neighbouring words, of a name in any case style."""
    words = [w.lower() for w in WORD.findall(name)]
    return max([SENSITIVE.get(w, 0.0) for w in [*words, *map("".join, zip(words, words[1:], strict=False))]], default=0.0)


@dataclass
class Held:
    """What is known of a value that is put together from literals: enough to score it without its text."""

    size: int = 0
    quoted: bool = False
    chars: Counter = field(default_factory=Counter)
    short: str = ""

    def add(self, other: Held) -> None:
        self.short = (self.short + other.short) if self.size + other.size <= _SHORT else ""
        self.size, self.quoted = self.size + other.size, self.quoted or other.quoted
        self.chars.update(other.chars)

    @classmethod
    def of(cls, value: str, quoted: bool) -> Held:
        return cls(len(value), quoted, Counter(value), value if len(value) <= _SHORT else "")

    def score(self) -> float:
        """0 to 1 by entropy and mix of characters; bare words need a digit, since prose has colons too."""
        if self.size < 8 or self.short.lower() in PLACEHOLDERS or " " in self.chars or len(self.chars) < 5:
            return 0.0
        digit, alpha = any(c.isdigit() for c in self.chars), any(c.isalpha() for c in self.chars)
        if not (digit and alpha) and not (self.quoted and alpha):
            return 0.0
        entropy = -sum(n / self.size * math.log2(n / self.size) for n in self.chars.values())
        return min(1.0, entropy / 3.0) * (1.0 if digit else 0.7)


def literal_score(value: str, quoted: bool) -> float:
    return Held.of(value, quoted).score()


Literal = tuple[int, int, bool]  # start, end, quoted


@dataclass
class Statement:
    name: str
    start: int
    parts: list[Literal | str] = field(default_factory=list)  # literals, or names that the value refers to
    places: list[Literal | None] = field(default_factory=list)  # of a name: where it stands, if it may be a literal


def _unquoted(text: str, start: int, end: int) -> Literal:
    width = 3 if end - start >= 6 and text[start : start + 3] in ('"""', "'''") else 1
    return (start + width, end - width, True)


def statements(text: str) -> list[Statement]:
    """All statements of a text, in order."""
    out = []
    for m in STATEMENT.finditer(text):
        new = Statement(m["name"], m.start())
        if m["operator"] == "+=":
            new.parts.append(m["name"])
            new.places.append(None)
        for v in PART.finditer(text, *m.span("value")):
            at, end = v.span()
            if text[at] in "\"'`" and end - at >= 2:
                new.parts.append(_unquoted(text, at, end))
                new.places.append(None)
            elif ref := REFERENCE.fullmatch(v[0]):
                new.parts.append(ref[1])
                new.places.append((at, end, False))
            else:
                new.parts.append((at, end, False))
                new.places.append(None)
        out.append(new)
    for pattern in (LISTED, CALL, FLAG, ELEMENT, BLOCK):
        for m in pattern.finditer(text):
            at, end = m.span("value")
            if pattern is BLOCK:
                found = [(v.start(), v.end(), True) for v in LINE.finditer(text, at, end)]
                out.append(Statement(m["name"], m.start(), found, [None] * len(found)))
                continue
            found = [_unquoted(text, *v.span()) for v in LITERAL.finditer(text, at, end)] if text[at] in "\"'`" else [(at, end, False)]
            out += [Statement(m["name"], m.start(), [x], [None]) for x in found]
    return sorted(out, key=lambda x: x.start)


def lexed_spans(text: str, threshold: float = 0.5) -> list[Span]:
    """Literals that reach a sensitive name, as spans of the literal's content. Linear in the statements: a value is
    summed up once, and each value that reaches a sensitive name is walked once."""
    if not any(x in text for x in MARKS):
        return []
    found = statements(text)
    scores: dict[str, float] = {}
    for x in found:
        if x.name not in scores:
            scores[x.name] = name_score(x.name)
    if not any(scores.values()):
        return []
    defined: dict[str, list[int]] = {}
    for i, x in enumerate(found):
        defined.setdefault(x.name, []).append(i)

    def definition(name: str, user: int) -> int | None:
        where = defined.get(name)
        if where is None:
            return None
        at = bisect_left(where, user)
        return where[at - 1] if at else next((i for i in where if i != user), None)

    # What each statement's parts are: literals, or the numbers of other statements.
    parts: list[list[Literal | int]] = []
    for i, x in enumerate(found):
        own: list[Literal | int] = []
        for part, place in zip(x.parts, x.places, strict=True):
            if not isinstance(part, str):
                own.append(part)
            elif (target := definition(part, i)) is not None:
                own.append(target)
            elif place is not None:
                own.append(place)
        parts.append(own)
    held: dict[int, Held] = {}
    for first in range(len(found)):
        todo, open_ = [first], set()
        while todo:  # depth first; what refers to itself counts as empty there
            i = todo[-1]
            if i in held:
                todo.pop()
                continue
            missing = [p for p in parts[i] if isinstance(p, int) and p not in held and p not in open_]
            if missing and i not in open_:
                open_.add(i)
                todo += missing
                continue
            total = Held()
            for p in parts[i]:
                if not isinstance(p, int):
                    total.add(Held.of(text[p[0] : p[1]], p[2]))
                elif p in held:
                    total.add(held[p])
            held[i] = total
            todo.pop()
    spans: set[tuple[int, int]] = set()
    todo = [i for i, x in enumerate(found) if scores[x.name] and scores[x.name] * held[i].score() >= threshold]
    seen = set(todo)
    while todo:
        for p in parts[todo.pop()]:
            if not isinstance(p, int):
                if p[1] > p[0]:
                    spans.add(p[:2])
            elif p not in seen:
                seen.add(p)
                todo.append(p)
    return [(s, e, LEXED) for s, e in sorted(spans)]


def scan_text(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, spans the lexer adds). A lexed span inside a base span adds nothing and is left out."""
    text = text or ""
    base = base_spans(text)
    starts, reach, top = [], [], 0
    for s, e, _ in sorted(base):
        top = max(top, e)
        starts.append(s)
        reach.append(top)

    def inside(x: Span) -> bool:
        at = bisect_right(starts, x[0])
        return at > 0 and reach[at - 1] >= x[1]

    return base, [x for x in lexed_spans(text) if not inside(x)]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, base digest, span string and the array of spans.

    Null and empty texts have no spans; repeated rows give repeated results; other columns are not read.
    Rows are independent, so the plan is one scan and one Arrow map without a shuffle.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                base, more = scan_text(text)
                kinds = Counter(k for *_, k in base)
                spans = sorted([*base, *more], key=lambda x: (x[0], ALL_KINDS.index(x[2])))
                rows.append((key, *(kinds[k] for k in KINDS), len(more), span_digest(base, KINDS), span_text(spans, ALL_KINDS), [{"kind": k, "start": s, "end": e} for s, e, k in spans]))
            yield pd.DataFrame(rows, columns=["id", "n_assign", "n_access", "n_hex", "n_lexed", "base_sha256", "spans", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, n_lexed long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(scan, schema).withColumnRenamed("id", id_col)
