"""Operator 8: quality rules by line sequence labelling.

Every line with a word is described by a few shape features. A linear-chain conditional random field with the
states content and boilerplate gives the best labelling of a document's lines (Viterbi); the share of words on
content lines decides whether the document stays. Plain counts of words, symbols and repeats are returned
beside it, and two of them refuse a document outright.

The field is trained on a sample of at most ``sample`` labelled documents, at most ``lines`` lines of each:
lines of documents of good quality are content, lines of others boilerplate. Without both kinds of labels every
line counts as content. Scoring reads whole texts and has no bound.

Null and empty texts have no words and fail the plain rule on length. Lines without a word belong to no label.
Rows without a key and repeated rows are scored like any other. Keys of labelled documents are integers. An empty table gives
no rows. Columns that share a name with a result are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import ship

SYMBOLS = b"#*$%&|<>"
_WHITE = " \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
FEATURES = ("bias", "short", "length", "symbols", "shout", "upper", "digits", "echo", "variety", "again", "open", "word_length")


def line_features(words: list[bytes], raw: bytes, again: bool) -> list[float]:
    """Shape of one line; ``again`` tells that the line stood earlier in the document."""
    n, size = len(words), max(1, len(raw))
    echo = sum(map(bytes.__eq__, words, words[1:])) / n
    return [
        1.0,
        1.0 if n < 4 else 0.0,
        min(1.0, n / 40),
        min(1.0, (size - len(raw.translate(None, SYMBOLS))) / n),
        min(1.0, raw.count(b"!") / n),
        (size - len(raw.translate(None, _UPPER))) / size,
        (size - len(raw.translate(None, _DIGIT))) / size,
        echo,
        len(set(words)) / n if n < 60 else min(1.0, len(set(words)) / n * (n / 60) ** 0.3),
        1.0 if again else 0.0,
        0.0 if words[-1][-1:] in b".!?:\"" else 1.0,
        min(1.0, size / n / 20),
    ]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    w = np.fromiter((seen.setdefault(x, len(seen)) for x in words), np.int64, len(words))
    k = len(seen)
    if k < 2_000_000:
        window = (w[:-2] * k + w[1:-1]) * k + w[2:]
    else:
        pair = np.unique(w[:-1] * k + w[1:], return_inverse=True)[1]
        window = pair[:-1] * k + w[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for d in range(3):
        hit[d : d + len(window)] |= twice
    return int(hit.sum())


def measure(text: str | None) -> tuple[list[int], list[list[float]], list[int]]:
    """Counts (words, word_chars, n_symbols, n_dup_lines, n_repeat_words), line features and words per line."""
    text = text or ""
    words: list[bytes] = []
    feats, sizes, dup = [], [], 0
    seen: set[bytes] = set()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        w = line.split()
        if not w:
            continue
        again = line in seen
        seen.add(line)
        dup += again
        feats.append(line_features(w, line, again))
        sizes.append(len(w))
        words += w
    chars = len(text) - sum(map(text.count, _WHITE))
    symbols = sum(text.count(chr(c)) for c in SYMBOLS)
    return [len(words), chars, symbols, dup, repeated_words(words)], feats, sizes


class LineField:
    """Two-state linear-chain conditional random field; state 1 is content."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    @classmethod
    def indifferent(cls) -> LineField:
        """Calls every line content."""
        emit = np.zeros((len(FEATURES), 2))
        emit[0, 1] = 1.0
        return cls(emit, np.zeros((2, 2)))

    @classmethod
    def train(cls, docs: list[tuple[np.ndarray, int]], steps: int = 160, rate: float = 0.1, decay: float = 1e-3) -> LineField:
        """Maximum likelihood by Adam over documents padded to one length; each document weighs the same."""
        if len({y for _, y in docs}) < 2:
            return cls.indifferent()
        n, longest, width = len(docs), max(len(x) for x, _ in docs), len(FEATURES)
        x, mask = np.zeros((n, longest, width)), np.zeros((n, longest))
        y = np.array([q for _, q in docs])
        for i, (f, _) in enumerate(docs):
            x[i, : len(f)], mask[i, : len(f)] = f, 1
        share = np.bincount(y, minlength=2)
        weight = (n / 2 / share)[y] / mask.sum(axis=1)
        theta = np.zeros(width * 2 + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        gold = np.eye(2)[y][:, None, :] * mask[:, :, None]
        pairs = mask[:, 1:] * mask[:, :-1]
        for step in range(1, steps + 1):
            emit, move = theta[: 2 * width].reshape(width, 2), theta[2 * width :].reshape(2, 2)
            e = x @ emit
            up, down = np.zeros_like(e), np.zeros_like(e)
            up[:, 0] = e[:, 0]
            for t in range(1, longest):
                new = e[:, t] + np.logaddexp(up[:, t - 1, 0, None] + move[0], up[:, t - 1, 1, None] + move[1])
                up[:, t] = np.where(mask[:, t, None] > 0, new, up[:, t - 1])
            for t in range(longest - 2, -1, -1):
                z = e[:, t + 1] + down[:, t + 1]
                new = np.logaddexp(z[:, 0, None] + move[:, 0], z[:, 1, None] + move[:, 1])
                down[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0)
            total = np.logaddexp(up[:, -1, 0], up[:, -1, 1])
            node = np.exp(up + down - total[:, None, None]) * mask[:, :, None]
            two = np.exp(up[:, :-1, :, None] + move + (e + down)[:, 1:, None, :] - total[:, None, None, None]) * pairs[:, :, None, None]
            own = gold[:, :-1, :, None] * gold[:, 1:, None, :]
            grad = np.concatenate((np.einsum("nlf,nls,n->fs", x, gold - node, weight).ravel(), np.einsum("nlab,n->ab", own - two, weight).ravel())) / n - decay * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(theta[: 2 * width].reshape(width, 2), theta[2 * width :].reshape(2, 2))

    def label(self, feats: list[list[float]]) -> list[int]:
        """The best labelling; ties go to content."""
        if not feats:
            return []
        (a00, a01), (a10, a11) = self.move.tolist()
        rows = (np.array(feats) @ self.emit).tolist()
        s0, s1 = rows[0]
        back = []
        for e0, e1 in rows[1:]:
            p0, p1 = s1 + a10 >= s0 + a00, s1 + a11 >= s0 + a01
            back.append((p0, p1))
            s0, s1 = (s1 + a10 if p0 else s0 + a00) + e0, (s1 + a11 if p1 else s0 + a01) + e1
        state = int(s1 >= s0)
        out = [state]
        for p in reversed(back):
            state = int(p[state])
            out.append(state)
        return out[::-1]


def train_field(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 600, lines: int = 64) -> LineField:
    """Fit on at most ``sample`` labelled keys, chosen by a hash of the key, and ``lines`` lines of each of their
    documents; of rows that repeat a key, the one with the least text. Features are made where the texts are; only they come to the driver."""
    ship(docs.sparkSession)
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("own")).agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("own"), "own").limit(sample)  # so few rows may be sent to all
    picked = docs.select(F.col(key).alias("own"), F.col(text).alias("text")).join(F.broadcast(chosen), "own")
    picked = picked.groupBy("own", "y").agg(F.min("text").alias("text")).select("own", "text", "y")  # one row per key: no more than the sample
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.array(measure(t.as_py())[1][:lines], float).reshape(-1, width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array([r.ravel() for r in rows], pa.list_(pa.float64()))], names=["own", "y", "x"])

    rows = picked.mapInArrow(run, "own long, y int, x array<double>").orderBy("own").collect()
    return LineField.train([(np.array(r.x).reshape(-1, width), int(r.y > 0)) for r in rows if r.x])


def judge(docs: DataFrame, field: LineField, key: str = "doc_id", text: str = "text", share: float = 0.5) -> DataFrame:
    """One row per document: ``key``, the counts, ``content_share``, ``base_failed`` and ``kept``."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shares, failed = [], [], []
            for t in b.column(1):
                c, feats, sizes = measure(t.as_py())
                good = sum(n for n, s in zip(sizes, field.label(feats), strict=True) if s)
                counts.append(c)
                shares.append(good / c[0] if c[0] else 0.0)
                failed.append(c[0] < 50 or 100 * c[4] > 50 * c[0])
            cols = [b.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(5)), pa.array(shares, pa.float64()), pa.array(failed, pa.bool_()), pa.array([not f and s >= share for f, s in zip(failed, shares, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, field: LineField, text: str = "text", share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that stay, in one pass and with the same columns."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stay = []
            for t in b.column(at):
                c, feats, sizes = measure(t.as_py())
                good = sum(n for n, s in zip(sizes, field.label(feats), strict=True) if s)
                stay.append(c[0] >= 50 and 100 * c[4] <= 50 * c[0] and good >= share * c[0])
            yield b.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
