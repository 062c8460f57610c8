"""Secret scans through a trigram inverted index.

Index.  Documents are dealt into segments of at most DOCS documents and BYTES
bytes; of each segment the index holds, for every trigram of its folded bytes
(A-Z lower-cased), the sorted documents that have it: one sorted array of
trigram << 8 | document.  A longer document is a segment of its own, read piece
by piece.  A segment's postings do not depend on any rule, so that a kept index
(`segments`) answers rules that are written later.

Search.  Of each rule's regular expression a Boolean trigram query is derived
(`trigram_query`): the trigrams that any match must hold, by AND along a sequence
and OR over alternatives.  Postings are intersected and united by it; only the
documents that remain are verified with the expression itself.  A rule whose
expression has no mandatory trigram scans all documents.  Matches are leftmost
and do not overlap within a rule; those that are too short are dropped.

Defined results: a null text is an empty one and holds nothing; spans count code
points, ends exclusive; repeated rows give repeated rows; texts are scanned whole,
however long; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import append, trim
from larkspur.llm.jaccard import _expand, _squeeze


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost matches of pattern, kept if the group has `least` characters or more."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.any_case else 0)


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: more shapes of public key formats
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("login", r"[a-z]+://[A-Za-z0-9._-]+:[^\x00-\x20\x22\x27/:@\x7F]+@"),
)
RULES = BASE + MORE

# ---- from an expression to the trigrams that its matches must hold

#: strings of a set, and characters of a class, up to which they are followed one by one
MOST, WIDE = 64, 4


def _and(*queries):
    parts = frozenset(p for q in queries if q is not True for p in (q[1] if isinstance(q, tuple) and q[0] == "and" else [q]))
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def _or(*queries):
    if True in queries:
        return True
    parts = frozenset(p for q in queries for p in (q[1] if isinstance(q, tuple) and q[0] == "or" else [q]))
    return next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _held(strings) -> object:
    """The query of texts that hold one of the strings."""
    return _or(*(_and(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings)) if strings else True


@dataclass(frozen=True)
class _Part:
    """What the matches of a part of an expression are: all of them, or how they start and end and what they hold."""

    exact: frozenset | None
    start: frozenset = frozenset([b""])
    end: frozenset = frozenset([b""])
    query: object = True

    def opened(self) -> _Part:
        """The same, without the list of all matches."""
        if self.exact is None:
            return self
        return _Part(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), _held(self.exact))


_ANY, _NOTHING = _Part(None), _Part(frozenset([b""]))


def _joined(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        return _Part(frozenset(x + y for x, y in product(a.exact, b.exact)))
    left, right = a.exact if a.exact is not None else a.end, b.exact if b.exact is not None else b.start
    across = frozenset(x + y for x, y in product(left, right)) if len(left) * len(right) <= MOST else None
    query = _and(a.opened().query, b.opened().query, True if across is None else _held(across))
    start, end = a.opened().start, b.opened().end
    if a.exact is not None and across is not None:
        start = frozenset(s[:2] for s in across)
    if b.exact is not None and across is not None:
        end = frozenset(s[-2:] for s in across)
    return _Part(None, start, end, query)


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts) and len(all_of := frozenset().union(*(p.exact for p in parts))) <= MOST:
        return _Part(all_of)
    parts = [p.opened() for p in parts]
    start, end = (frozenset().union(*(getattr(p, k) for p in parts)) for k in ("start", "end"))
    return _Part(None, start if len(start) <= MOST else frozenset([b""]), end if len(end) <= MOST else frozenset([b""]), _or(*(p.query for p in parts)))


def _fold(code: int) -> bytes:
    return chr(code + 32 if 65 <= code <= 90 else code).encode("utf-8", "replace")


def _sequence(items) -> _Part:
    out = _NOTHING
    for item in items:
        out = _joined(out, _part(*item))
    return out


def _part(op, value) -> _Part:
    name = str(op)
    if name == "LITERAL":
        return _Part(frozenset([_fold(value)]))
    if name == "IN":
        codes: set[int] = set()
        for kind, x in value:
            codes |= {x} if str(kind) == "LITERAL" else set(range(x[0], min(x[1], x[0] + 64) + 1)) if str(kind) == "RANGE" else set(range(WIDE + 65))
        chars = {_fold(c) for c in codes}
        return _Part(frozenset(chars)) if len(codes) <= 2 * WIDE and len(chars) <= WIDE + 1 else _ANY
    if name == "SUBPATTERN":
        return _sequence(value[3])
    if name == "ATOMIC_GROUP":
        return _sequence(value)
    if name == "BRANCH":
        return _either([_sequence(x) for x in value[1]])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = value
        one = _sequence(inner)
        if low == 0:
            return _either([_NOTHING, one]) if high == 1 else _ANY
        out = one
        for _ in range(min(low, 8) - 1):
            out = _joined(out, one)
        return out if high == low <= 8 else _joined(out, _ANY)
    # places hold no characters; anything else may be any text
    return _NOTHING if name in ("AT", "ASSERT", "ASSERT_NOT") else _ANY


def trigram_query(pattern: str, flags: int = 0):
    """True where no trigram is mandatory; else trigrams (3 folded bytes) under ("and", set) and ("or", set)."""
    return _sequence(re._parser.parse(pattern, flags)).opened().query


# ---- the index

DOCS, BYTES = 256, 4_000_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Segment:
    """The postings of some documents: sorted trigram << 8 | document."""

    def __init__(self, postings: np.ndarray, n: int):
        self.postings, self.n = postings, n

    @classmethod
    def of(cls, texts: list[bytes]) -> Segment:
        """From UTF-8 texts, DOCS at most; long ones are read piece by piece."""
        parts, load, done = [], 0, []
        for i, text in enumerate(texts):
            for low in range(0, max(1, len(text) - 2), BYTES):
                raw = np.frombuffer(text[low : low + BYTES + 2].translate(_FOLD), np.uint8).astype(np.uint32)
                if len(raw) < 3:
                    continue
                parts.append(raw[:-2] << 24 | raw[1:-1] << 16 | raw[2:] << 8 | np.uint32(i))
                load += len(raw)
                if load >= BYTES:
                    done.append(cls._distinct(np.concatenate(parts)))
                    parts, load = [], 0
        done += [cls._distinct(np.concatenate(parts))] if parts else []
        return cls(done[0] if len(done) == 1 else cls._distinct(np.concatenate(done)) if done else np.empty(0, np.uint32), len(texts))

    @staticmethod
    def _distinct(keys: np.ndarray) -> np.ndarray:
        keys.sort()
        return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]

    def having(self, trigram: bytes) -> np.ndarray:
        low = int.from_bytes(trigram, "big") << 8
        a, b = np.searchsorted(self.postings, np.array([low, low + 255], np.uint32)) + np.array([0, 0])
        b += int(b < len(self.postings) and self.postings[b] == low + 255)
        return (self.postings[a:b] & np.uint32(255)).astype(np.int64)

    def candidates(self, query) -> np.ndarray:
        """The documents that may hold a match, sorted."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.having(query)
        sets = (self.candidates(q) for q in sorted(query[1], key=repr))
        out = next(sets)
        for more in sets:
            if query[0] == "and" and not len(out):
                break
            out = np.intersect1d(out, more, assume_unique=True) if query[0] == "and" else np.union1d(out, more)
        return out


@lru_cache
def _compiled(rules: tuple[Rule, ...]) -> list[tuple]:
    return [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for r in rules]


def _matches(rule: Rule, pattern, text: str) -> list[tuple[str, int, int]]:
    return [(rule.kind, *m.span()) for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least]


def find(segment: Segment, texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[str, int, int]]]:
    """Of each text its spans (kind, start, end) by start, then by the order of the rules."""
    found: list[list] = [[] for _ in texts]
    for place, (rule, pattern, query) in enumerate(_compiled(rules)):
        for i in segment.candidates(query).tolist():
            found[i] += [(start, place, end, kind) for kind, start, end in _matches(rule, pattern, texts[i])]
    return [[(kind, start, end) for start, _, end, kind in sorted(spans)] for spans in found]


def _dealt(texts: list[str | None]):
    """Places of texts, cut into segments."""
    low = load = 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > low and (i - low == DOCS or load + size > BYTES):
            yield low, i
            low, load = i, 0
        load += size
    if len(texts) > low:
        yield low, len(texts)


def scan(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """docs with `spans`, array<struct<kind, start, end>>: a segment is indexed, searched and verified where its rows are."""
    rules = tuple(rules)

    def run(values):
        out = []
        for low, high in _dealt(values):
            texts = [t or "" for t in values[low:high]]
            segment = Segment.of([t.encode("utf-8", "replace") for t in texts])
            out += [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in find(segment, texts, rules)]
        return [out]

    return append(docs, [text], run, "spans array<struct<kind:string,start:bigint,end:bigint>>")


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index to keep: one row a segment with its documents' keys and postings; no texts."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType
    arrow = pa.list_(to_arrow_type(kind))

    def run(batches):
        for batch in batches:
            values = batch.column(1).to_pylist()
            for low, high in _dealt(values):
                segment = Segment.of([(t or "").encode("utf-8", "replace") for t in values[low:high]])
                keys = batch.column(0).slice(low, high - low).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([keys], arrow), pa.array([_squeeze(segment.postings)], pa.binary())], names=["keys", "postings"])
        trim()

    return rows.mapInArrow(run, f"keys array<{kind.simpleString()}>, postings binary")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """key, kind: documents of a kept index that may hold a match; kinds of full scans are not listed (see `full_scans`)."""
    from pyspark.sql.pandas.types import to_arrow_type

    queries = [(r.kind, q) for r, _, q in _compiled(tuple(rules)) if q is not True]
    kind = index.schema["keys"].dataType.elementType
    arrow = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column(0)[i].values
                segment = Segment(_expand(batch.column(1)[i].as_py()).astype(np.uint32), len(keys))
                for name, query in queries:
                    own = segment.candidates(query)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(own)).cast(arrow), pa.array([name] * len(own), pa.string())], names=["key", "kind"])

    return index.mapInArrow(run, f"key {kind.simpleString()}, kind string")


def full_scans(rules=RULES) -> list[str]:
    """Kinds whose expression has no mandatory trigram."""
    return [r.kind for r, _, q in _compiled(tuple(rules)) if q is True]


def report(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, a count for each base kind, the digest of the base spans and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(r.kind) for r in BASE]
    return scanned.select(key, *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
