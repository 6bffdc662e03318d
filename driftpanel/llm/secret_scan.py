"""Secret scan with assignment-aware lexing.

Two findings per text, both over the whole of it:

* the base patterns: values assigned to a few well-known names, access keys, long hex runs;
* the lexer: the text is read as source or configuration syntax into name-literal pairs
  (``name = "literal"``, ``name: literal``, ``"name": "literal"``, ``name => 'literal'``,
  ``export NAME=literal``), literals may be joined by ``+`` or stand side by side, and names that
  hold a constant may be used in their place. A value goes on over lines after an open bracket, an
  operator or a backslash, in triple quotes, quoted or bare PEM blocks and YAML block scalars;
  literals in calls, lists and maps count under the name they are assigned to, too. A bracket that
  is never closed reaches to the next empty line. A literal counts if its score, the sensitivity
  of the target name times the strength of the value, reaches ``CUTOFF``; a propagated constant is
  marked where it was written. Lines without ``=`` or ``:`` that continue no value are passed over.

Spans are in code points, end exclusive. Edge cases: null and empty texts have no findings; equal
rows have equal findings; two spans with the same place and kind are one.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftpanel.llm import words

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
#: Runs below the least length never match further in, so the length is part of the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Sensitivity of a target name that holds all words of the key.
SENSITIVE = {
    ("password",): 1.0,
    ("passwd",): 1.0,
    ("passphrase",): 1.0,
    ("pwd",): 0.9,
    ("secret",): 1.0,
    ("token",): 0.9,
    ("credential",): 0.9,
    ("credentials",): 0.9,
    ("api", "key"): 1.0,
    ("apikey",): 1.0,
    ("access", "key"): 1.0,
    ("private", "key"): 1.0,
    ("encryption", "key"): 1.0,
    ("signing", "key"): 1.0,
    ("auth",): 0.7,
    ("authorization",): 0.7,
    ("key",): 0.4,
    ("salt",): 0.5,
}
#: Values that stand for a secret without being one.
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "token", "none", "null", "true", "false"}
CUTOFF = 0.5

_LEX = re.compile(
    r"""(?P<triple>\"{3}(?:[^"\\]|\\.|"(?!""))*"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})"""
    r"""|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<quote>["'])|(?P<op>:=|=>|==|!=|<=|>=|=|:)"""
    r"""|(?P<plus>\+)|(?P<word>[A-Za-z_$][\w$]*(?:[.-][\w$]+)*(?![\w/+=-]))|(?P<bare>[^\s"'=:+,;(){}\[\]]+)"""
    r"""|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<end>[,;])|(?P<line>\n)""",
    re.ASCII | re.DOTALL,
)
#: Names that stand right before the operator, as in ``NAME=literal``, ``--name=literal``, ``*name = ""``.
_NAME = re.compile(r"[-*&@]*[A-Za-z_$][\w$.-]*", re.ASCII)
_KEY = re.compile(r"\s*(?::|=(?!=))")
_CALL = re.compile(r"[ \t]*[(\[]")
_PEM_HEAD = re.compile(r"[ \t]*(-----BEGIN [A-Z0-9 ]+-----)")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]+-----")
_EMPTY_LINE = re.compile(r"\n[ \t]*\r?(?=\n)")
_INDENT = re.compile(r"[^\S\n]*")
_SPACE = re.compile(r"\s*")
_LONG_TEXT = {q: re.compile(rf"{q}((?:[^{q}\\]|\\.)*){q}", re.DOTALL) for q in "\"'"}
_BLOCK = re.compile(r"[ \t]*[|>][+\-0-9]*[ \t]*(?:#[^\n]*)?\n")
_CLOSES = {")": "(", "]": "[", "}": "{"}
_SET = {"=", ":", ":=", "=>"}


@functools.lru_cache(1 << 14)
def name_score(name: str) -> float:
    parts = set(re.findall(r"[a-z]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower()))
    return max((s for key, s in SENSITIVE.items() if parts.issuperset(key)), default=0.0)


def value_score(value: str) -> float:
    """0 to 1: length and spread of characters; 0 for placeholders and references."""
    if len(value) < 6 or value.lower() in PLACEHOLDERS or re.match(r"[$<{%]|x{3,}|\*{3,}", value, re.I):
        return 0.0
    if " " in value.strip():
        return 0.0
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, len(value) / 12) * min(1.0, bits / 3) * min(1.0, 0.4 + 0.3 * classes)


def body(value: str) -> str:
    """A value of several lines as one, without the first and last lines of a PEM block."""
    if "\n" not in value and "-----" not in value:
        return value
    value = re.sub(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----", "\n", value.replace("\\n", "\n"))
    return "".join(line.strip() for line in value.split("\n"))


class _Value:
    """What ``value_score`` needs of a value that is put together from pieces, and a tree of the places
    that they come from. Joining costs the distinct characters, not the length, so constants that are
    made of constants many times over stay small."""

    __slots__ = ("text", "length", "counts", "head", "inner", "before", "after", "pem", "places")

    def __init__(self, text: str = "", start: int = 0, end: int = 0):
        #: As written, until it is measured; a value that is neither joined nor scored never is.
        self.text: str | None = text
        #: A place (start, end), a pair of trees, or nothing.
        self.places = (start, end) if start < end else None

    def __bool__(self) -> bool:
        return self.text is None or len(self.text) > 0

    def measured(self) -> _Value:
        if self.text is not None:
            self.pem = "-----" in self.text
            own = body(self.text)
            self.length, self.counts, self.head = len(own), Counter(own), own[:16]
            bare = own.strip()
            self.inner = " " in bare
            self.before = bool(bare) and " " in own[: len(own) - len(own.lstrip())]
            self.after = " " in own[len(own.rstrip()) :]
            if self.text:
                self.text = None
        return self

    def join(self, other: _Value) -> _Value:
        if not self:
            return other
        self.measured()
        other.measured()
        out = _Value()
        out.text = None
        out.length, out.head, out.pem = self.length + other.length, (self.head + other.head)[:16], self.pem or other.pem
        out.counts = self.counts + other.counts
        filled = [any(not c.isspace() for c in v.counts) for v in (self, other)]
        out.inner = self.inner or other.inner or (all(filled) and (self.after or other.before))
        out.before = self.before if filled[0] else (filled[1] and (self.after or other.before))
        out.after = other.after or (not filled[1] and self.after)
        out.places = (self.places, other.places) if self.places and other.places else self.places or other.places
        return out

    def score(self) -> float:
        """``value_score`` of the whole."""
        self.measured()
        if self.length < 6 or self.inner or (self.length <= 16 and self.head.lower() in PLACEHOLDERS):
            return 0.0
        if re.match(r"[$<{%]|x{3,}|\*{3,}", self.head, re.I):
            return 0.0
        bits = -sum(n / self.length * math.log2(n / self.length) for n in self.counts.values())
        signs = "".join(self.counts)
        classes = sum(bool(re.search(p, signs)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        return min(1.0, self.length / 12) * min(1.0, bits / 3) * min(1.0, 0.4 + 0.3 * classes)


_NOTHING = _Value()


def literals(text: str) -> list[tuple[int, int]]:
    """Places of the literals that reach a sensitive name."""
    if "=" not in text and ":" not in text:
        return []
    return _Lexer(text).read()


class _Bracket:
    """An open bracket: its sign, the sensitivity it hands on, the name it is the value of, where
    the next empty line starts, and what was found in it."""

    def __init__(self, sign: str, score: float, head: list | None, value: bool, ends: int):
        self.sign, self.score, self.head, self.value, self.ends = sign, score, head, value, ends
        self.found: list[tuple] = []


class _Lexer:
    """One pass over the tokens of a text. What is found, remembered or looked up ahead costs time in
    proportion to the text: findings stay trees until the end, and a search that ended somewhere is
    not made again before that place."""

    def __init__(self, text: str):
        self.text = text
        self.constants: dict[str, _Value] = {}
        #: Trees of places, or lists of such of given-up brackets, each with where it stops to count.
        self.found: list[tuple] = []
        self.stack: list[_Bracket] = []
        self.signs: Counter[str] = Counter()
        self.valued = 0
        #: Name, sensitivity and whether no value was seen yet; the value so far; whether one may follow.
        self.head: list | None = None
        self.value, self.wanted, self.quoted = _NOTHING, False, False
        self.empty_line = -1
        self.ahead: dict[object, int] = {}
        self.line, self.line_to, self.text_from = 0, 0, -1

    def inherited(self) -> float:
        return self.stack[-1].score if self.stack else 0.0

    def report(self, tree, ends: float = math.inf) -> None:
        (self.stack[-1].found if self.stack else self.found).append((tree, ends))

    def finish(self) -> None:
        """The value ends here."""
        if self.value:
            score = self.inherited()
            if self.head:
                score = max(score, self.head[1])
                if self.head[2]:
                    self.constants[self.head[0]] = self.value
                    self.head[2] = False
            if self.value.places and score and score * self.value.score() >= CUTOFF:
                self.report(self.value.places)
        self.value, self.quoted = _NOTHING, False

    def end(self) -> None:
        self.finish()
        self.head, self.wanted = None, False

    def add(self, value: str, start: int, end: int) -> None:
        if self.value and self.value.measured().pem:
            value = value.replace("\\n", "\n")
        self.value = self.value.join(_Value(value, start, end))
        self.wanted, self.quoted = False, True

    def opened(self, sign: str, at: int) -> None:
        direct = self.head is not None and self.wanted and not self.value
        score = max(self.inherited(), self.head[1] if self.head else 0.0)
        self.finish()
        if at > self.empty_line:
            found = _EMPTY_LINE.search(self.text, at)
            self.empty_line = found.start() if found else len(self.text)
        own = _Bracket(sign, score, self.head, direct, self.empty_line)
        self.stack.append(own)
        self.signs[sign] += 1
        self.valued += bool(own.value or own.score)
        self.wanted = True

    def popped(self) -> _Bracket:
        own = self.stack.pop()
        self.signs[own.sign] -= 1
        self.valued -= bool(own.value or own.score)
        return own

    def closed(self, sign: str) -> None:
        self.finish()
        if not self.signs[_CLOSES[sign]]:
            self.head, self.wanted = None, False
            return
        while self.stack[-1].sign != _CLOSES[sign]:
            self.given_up(self.popped())
        own = self.popped()
        if own.found:
            self.report(own.found)
        self.head, self.wanted = own.head, False

    def given_up(self, own: _Bracket) -> None:
        if own.found:
            self.report(own.found, own.ends)

    def places(self) -> list[tuple[int, int]]:
        """The places of all that was found, each tree read once, from the latest end down."""
        trees, lists = [], [(self.found, math.inf)]
        while lists:
            entries, limit = lists.pop()
            for tree, ends in entries:
                (lists if isinstance(tree, list) else trees).append((tree, min(limit, ends)))
        found: set[tuple[int, int]] = set()
        seen: set[int] = set()
        for tree, limit in sorted(trees, key=lambda t: -t[1]):
            left = [tree]
            while left:
                node = left.pop()
                if id(node) in seen:
                    continue
                seen.add(id(node))
                if isinstance(node[0], int):
                    if node[0] < limit:
                        found.add(node)
                else:
                    left += node
        return sorted(found)

    def next(self, pattern, at: int) -> int:
        """Where the pattern starts at or after ``at``; the end of the text if nowhere."""
        if self.ahead.get(pattern, -1) < at:
            if isinstance(pattern, str):
                to = self.text.find(pattern, at)
            else:
                to = m.start() if (m := pattern.search(self.text, at)) else -1
            self.ahead[pattern] = to if to >= 0 else len(self.text)
        return self.ahead[pattern]

    def indent(self, at: int) -> int:
        """White space before the text of the line, up to ``at``; places do not decrease."""
        to = self.text.rfind("\n", self.line_to, at)
        if to >= 0:
            self.line, self.text_from = to + 1, -1
        self.line_to = max(at, self.line)
        if self.text_from < 0:
            self.text_from = _INDENT.match(self.text, self.line).end()
        return min(self.text_from, at) - self.line

    def newline(self, at: int) -> int:
        """Where to read on after the line break before ``at``."""
        text = self.text
        if self.stack and self.valued:
            return at
        while self.stack:
            self.given_up(self.popped())
        if self.head and (self.wanted or self.quoted):
            m = _SPACE.match(text, at)
            to = m.end()
            line = text[to : text.find("\n", to) if "\n" in text[to : to + 400] else to + 400]
            first = line[:1]
            indent = to - text.rfind("\n", 0, to) - 1
            if self.wanted and first and (first in "\"'([{" or (indent > self.head[3] and re.fullmatch(r"[^\s:=\"']+\r?", line))):
                own = _LEX.match(text, to)
                if self.value or not (own.lastgroup == "text" and _KEY.match(text, own.end())):
                    return to
            elif not self.wanted and first == "+" and line[1:2] not in "+=":
                return to
            elif not self.wanted and first in ("'", '"'):
                own = _LEX.match(text, to)
                if own.lastgroup == "text" and not _KEY.match(text, own.end()):
                    return to
        self.end()
        return at

    def skipped(self, at: int) -> int:
        """The start of the next line with an assignment, if no value is open."""
        if self.stack or self.head:
            return at
        text = self.text
        to = min(self.next("=", at), self.next(":", at))
        return max(at, text.rfind("\n", at, to) + 1) if to < len(text) else to

    def pem(self, at: int):
        """The place of a PEM block that starts here, up to the first end mark after its head."""
        head = _PEM_HEAD.match(self.text, at)
        if not head:
            return None
        to = self.next(_PEM_END, head.end())
        return (head.start(1), _PEM_END.match(self.text, to).end()) if to < len(self.text) else None

    def block(self, at: int, indent: int) -> None:
        """A YAML block scalar whose lines start at ``at``."""
        to, text = at, self.text
        while to < len(text):
            stop = text.find("\n", to)
            stop = len(text) if stop < 0 else stop
            line = text[to:stop]
            if line.strip() and len(line) - len(line.lstrip()) <= indent:
                break
            to = stop + 1
        own = text[at:to]
        if own.strip():
            start = at + len(own) - len(own.lstrip())
            self.add(own.strip(), start, at + len(own.rstrip()))
        self.end()

    def read(self) -> list[tuple[int, int]]:
        text, at, before, low = self.text, self.skipped(0), None, 0
        tried: dict[str, int] = {}
        while at < len(text):
            m = _LEX.search(text, at)
            if not m:
                break
            kind, token, start, at = m.lastgroup, m.group(), m.start(), m.end()
            here = self.wanted and not self.value and before is not None and before[0] == "op"
            if kind == "line":
                at = self.newline(at)
                at = low = self.skipped(at)
                before = None
                continue
            if kind == "op":
                if token in _SET and before and (before[0] in ("word", "text") or _NAME.fullmatch(before[1])):
                    name = before[1].strip("\"'")
                    self.finish()
                    indent = self.indent(start)
                    self.head, self.wanted = [name, name_score(name), True, indent], True
                    if token == ":" and (own := _BLOCK.match(text, at)):
                        self.block(own.end(), indent)
                    elif text.startswith("-----BEGIN", at + (text[at : at + 1] == " ")) and (own := self.pem(at)):
                        self.add(text[own[0] : own[1]], *own)
                        at = own[1]
                        self.end()
                else:
                    self.end()
            elif kind == "triple":
                if self.wanted or self.quoted:
                    self.add(token[3:-3], start + 3, at - 3)
                else:
                    at = start + 3
            elif kind == "text":
                key = not here and _KEY.match(text, at)
                if key or not (self.wanted or self.quoted):
                    if self.stack:
                        self.finish()
                    else:
                        self.end()
                else:
                    self.add(token[1:-1], start + 1, at - 1)
            elif kind == "quote":
                # No second quote on the line: a value of several lines if it reads like one.
                if self.head and self.wanted and self.head[1] and tried.get(token, -1) <= start:
                    own = _LONG_TEXT[token].match(text, start)
                    tried[token] = own.end() if own else len(text)
                    if own and self.head[1] * value_score(body(own.group(1))) >= CUTOFF:
                        self.add(own.group(1), own.start(1), own.end(1))
                        at = own.end()
                continue
            elif kind == "plus":
                self.wanted, self.quoted = bool(self.head or self.stack), False
                if not self.value:
                    self.end()
            elif kind in ("word", "bare"):
                if token == "\\" and text.startswith(("\n", "\r\n"), at):
                    at = text.index("\n", at) + 1
                    continue
                if self.wanted and token in self.constants:
                    self.value = self.value.join(self.constants[token])
                    self.wanted = False
                elif self.wanted and kind == "word" and _CALL.match(text, at):
                    pass
                elif here or (self.wanted and not self.value and self.head and not self.stack):
                    self.value, self.wanted = _Value(token, start, at), False
                elif self.stack:
                    self.finish()
                    self.wanted = False
                else:
                    self.end()
            elif kind == "open":
                self.opened(token, start)
            elif kind == "close":
                self.closed(token)
            elif self.stack:
                self.finish()
                # A new element: only what the bracket hands on, and no name of its own.
                self.head, self.wanted = self.stack[-1].head, True
                if self.head:
                    self.head[2] = False
            else:
                self.end()
            before = (kind, token)
        self.finish()
        while self.stack:
            self.given_up(self.popped())
        return self.places()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind number and end of the base findings, in order."""
    found = []
    if "=" in text or ":" in text:
        found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for slab in words.slabs(batches):
        base, spans = [], []
        for text in slab.column(1).to_pylist():
            base.append(base_spans(text or ""))
            spans.append(sorted({*base[-1], *((s, 3, e) for s, e in literals(text or ""))}))
        counts = [pa.array([sum(k == n for _, k, _ in b) for b in base], pa.int64()) for n in range(3)]
        yield pa.RecordBatch.from_arrays(
            [
                slab.column(0),
                slab.column(1),
                *counts,
                pa.array([_joined(b) for b in base], pa.string()),
                pa.array([_joined(s) for s in spans], pa.string()),
                pa.array([[s for s, _, _ in x] for x in spans], pa.list_(pa.int64())),
                pa.array([[e for _, _, e in x] for x in spans], pa.list_(pa.int64())),
            ],
            ["row", "text", "n_assign", "n_access", "n_hex", "base", "spans", "starts", "ends"],
        )


def find_secrets(documents: DataFrame, text: str = "text") -> DataFrame:
    """Per document: ``row`` (all its columns), ``text``, counts of the base kinds, ``base`` and
    ``spans`` as text, and ``starts`` and ``ends`` of all spans."""
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.col(text).alias("text"))
    places = T.ArrayType(T.LongType())
    schema = T.StructType(
        [
            *rows.schema.fields,
            *[T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")],
            *[T.StructField(n, T.StringType()) for n in ("base", "spans")],
            *[T.StructField(n, places) for n in ("starts", "ends")],
        ]
    )
    return rows.mapInArrow(_scan, schema)


def redact(
    found: DataFrame, columns: list[str], text: str = "text", length: str | None = "n_chars", mark: str = "[REDACTED]"
) -> DataFrame:
    """The documents with every span, overlapping ones as one, replaced by ``mark``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in words.slabs(batches):
            texts = slab.column(1).to_pylist()
            starts, ends = slab.column(2).to_pylist(), slab.column(3).to_pylist()
            for i, value in enumerate(texts):
                if starts[i]:
                    out, at = [], 0
                    for s, e in sorted(zip(starts[i], ends[i], strict=True)):
                        if s >= at:
                            out += [value[at:s], mark]
                        at = max(at, e)
                    texts[i] = "".join([*out, value[at:]])
            yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(texts, pa.string())], ["row", "text"])

    plain = found.select("row", "text", "starts", "ends")
    done = plain.mapInArrow(task, plain.select("row", "text").schema)
    return words.with_text(done, columns, text, length)
