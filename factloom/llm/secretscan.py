"""Operator 7: secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must contain. A
block of documents is indexed once: all trigrams of its lower-cased bytes are looked up at once among those
that some rule asks for, which gives postings from trigram to document. Postings are intersected and united as
the query says, and only the documents left are read with the expression itself. Rules without a mandatory
trigram read every document. Blocks are bounded in bytes, so memory does not grow with the input.

Null and empty texts have no spans. Matches do not overlap within a rule and may overlap between rules; a match
that a rule's further test refuses is dropped and not tried again. Spans are in code points, end exclusive. Repeated rows are
scanned like any other; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import ship

try:
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # Python before 3.11
    import sre_constants as _c
    import sre_parse as _p

Query = tuple[frozenset[bytes], ...]  # one of these sets, all of its trigrams
EXACT, WIDE = 64, 6


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] = lambda m: True


def _letters(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEY = "|".join((_letters("password"), _letters("passwd"), _letters("secret"), _letters("token"), _letters("api") + "_?" + _letters("key")))
BASE = (
    Rule("assign", f"({_KEY})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
    Rule("access", "AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 20),
    Rule("hex", "[0-9a-f]{24,}"),  # the runs of one or more that are 24 or longer
)
MORE = (
    Rule("private_key", "-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("code_host", "gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", "[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("web_token", "(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("login_url", "[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\\x00-\\x20/:@]{1,64}:[^\\x00-\\x20/@]{3,64}@"),
)
RULES = BASE + MORE


def _fold(code: int) -> str | None:
    """The lower-cased ASCII character, or None for others, which the index does not hold as one byte."""
    return chr(code).lower() if 0 < code < 128 else None


def _and(a: Query | None, b: Query | None) -> Query | None:
    if a is None or b is None:
        return a if b is None else b
    if len(a) * len(b) > 256:
        return min(a, b, key=len)
    return _least(x | y for x in a for y in b)


def _least(sets) -> Query | None:
    """Drop alternatives that ask for more than another one; None if one asks for nothing."""
    out: list[frozenset[bytes]] = []
    for s in sorted(set(sets), key=len):
        if not any(t <= s for t in out):
            out.append(s)
    return None if not out or not out[0] else tuple(out)


def _grams(words: set[str]) -> Query | None:
    return _least(frozenset(w[i : i + 3].encode() for i in range(len(w) - 2)) for w in words)


def trigram_query(pattern: str) -> Query | None:
    """Trigrams that every match of ``pattern`` contains, ASCII letters lower-cased; None if there are none."""

    def walk(items) -> tuple[set[str] | None, Query | None]:
        """The exact strings, if few, or else a query; for a sequence."""
        held: set[str] = {""}
        query: Query | None = None
        whole = True

        def flush() -> None:
            nonlocal held, query, whole
            query, held, whole = _and(query, _grams(held)), {""}, False

        for op, arg in items:
            exact, sub = node(op, arg)
            if exact is not None and len(exact) * len(held) <= EXACT:
                held = {a + b for a in held for b in exact}
                continue
            flush()
            if exact is not None:
                held = set(exact)
            else:
                query = _and(query, sub)
        if whole:
            return held, None
        flush()
        return None, query

    def node(op, arg) -> tuple[set[str] | None, Query | None]:
        if op is _c.LITERAL:
            f = _fold(arg)
            return ({f}, None) if f else (None, None)
        if op is _c.IN:
            chars: set[str] = set()
            for o, a in arg:
                codes = [a] if o is _c.LITERAL else range(a[0], a[1] + 1) if o is _c.RANGE else None
                if codes is None or len(codes) > 64 or any(_fold(x) is None for x in codes):
                    return None, None
                chars |= {_fold(x) for x in codes}
            return (chars, None) if len(chars) <= WIDE else (None, None)
        if op is _c.SUBPATTERN:
            return walk(arg[-1])
        if op is _c.BRANCH:
            parts = [walk(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                union = set().union(*(e for e, _ in parts))
                return (union, None) if len(union) <= EXACT else (None, _grams(union))
            queries = [_grams(e) if e is not None else q for e, q in parts]
            return None, None if any(q is None for q in queries) else _least(s for q in queries for s in q)
        if op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            low, high, body = arg
            exact, sub = walk(body)
            if exact is not None and low == 0 and high == 1:
                return exact | {""}, None
            if exact is not None and low == high and len(exact) ** low <= EXACT:
                out = {""}
                for _ in range(low):
                    out = {a + b for a in out for b in exact}
                return out, None
            return None, None if low == 0 else _grams(exact) if exact is not None else sub
        if op is _c.AT:
            return {""}, None
        return None, None

    exact, query = walk(_p.parse(pattern))
    return _grams(exact) if exact is not None else query


class TrigramScanner:
    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        grams = sorted({g for _, _, q in self.rules for s in q or () for g in s})
        self.number = {g: i for i, g in enumerate(grams)}
        self.slot = np.full(1 << 24, -1, np.int16)
        for g, i in self.number.items():
            self.slot[g[0] << 16 | g[1] << 8 | g[2]] = i

    def postings(self, texts: Sequence[str]) -> list[np.ndarray]:
        """For each trigram that a rule asks for, the documents that hold it, ascending."""
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        ends = np.cumsum([len(r) + 2 for r in raw])
        b = np.frombuffer(b"\0\0".join([*raw, b""]), np.uint8)
        out = [np.empty(0, np.int64)] * len(self.number)
        hits: list[np.ndarray] = []
        for lo in range(0, max(0, len(b) - 2), 1 << 22):
            p = b[lo : lo + (1 << 22) + 2].astype(np.int32)
            if len(p) < 3:
                continue
            s = self.slot[p[:-2] << 16 | p[1:-1] << 8 | p[2:]]
            at = np.flatnonzero(s >= 0)
            hits.append(s[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at + lo, side="right"))
        if hits:
            u = np.unique(np.concatenate(hits))
            cut = np.searchsorted(u, np.arange(len(self.number) + 1) * len(texts))
            out = [u[cut[i] : cut[i + 1]] - i * len(texts) for i in range(len(self.number))]
        return out

    def candidates(self, query: Query | None, postings: list[np.ndarray], n: int) -> np.ndarray:
        if query is None:
            return np.arange(n)
        found = [np.empty(0, np.int64)]
        for conj in query:
            lists = sorted((postings[self.number[g]] for g in conj), key=len)
            both = lists[0]
            for x in lists[1:]:
                both = np.intersect1d(both, x, assume_unique=True)
            found.append(both)
        return np.unique(np.concatenate(found))

    def spans(self, texts: Sequence[str]) -> list[list[tuple[str, int, int]]]:
        """Spans of each text by start, then by rule as listed."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        post = self.postings(texts)
        for k, (rule, regex, query) in enumerate(self.rules):
            for d in self.candidates(query, post, len(texts)).tolist():
                out[d] += [(m.start(), k, m.end()) for m in regex.finditer(texts[d]) if rule.accept(m)]
        return [[(self.rules[k][0].kind, s, e) for s, k, e in sorted(x)] for x in out]


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = 8 << 20) -> DataFrame:
    """``docs`` with ``secret_spans``, an array of (kind, start, end), in place of any column of that name."""
    return _scan(docs, [c for c in docs.columns if c != "secret_spans"], text, block, False)


def redact_secrets(docs: DataFrame, text: str = "text", block: int = 8 << 20) -> DataFrame:
    """``docs`` with every span, overlapping ones joined, replaced by ``[SECRET]``; the same columns."""
    return _scan(docs, docs.columns, text, block, True)


def _scan(docs: DataFrame, names: list[str], text: str, block: int, redact: bool) -> DataFrame:
    ship(docs.sparkSession)
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    at = names.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = TrigramScanner()
        for b in batches:
            lo = 0
            texts = b.column(at).to_pylist()
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= block):
                    size += len(texts[hi] or "")
                    hi += 1
                part, spans = b.slice(lo, hi - lo), scanner.spans([t or "" for t in texts[lo:hi]])
                if redact:
                    new = pa.array([_cut(t, s) for t, s in zip(texts[lo:hi], spans, strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays([new if i == at else part.column(i) for i in range(len(names))], names=names)
                else:
                    rows = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], kind)
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), rows], names=[*names, "secret_spans"])
                lo = hi

    return docs.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema if redact else f"{schema}, secret_spans array<struct<kind: string, start: int, end: int>>")


def _cut(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if not spans or text is None:
        return text
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    base = F.filter("secret_spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    n = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(key, *(n(r.kind) for r in BASE), F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("secret_spans")).alias("spans"))
