"""Operator 12: compression of vectors to codes, one codebook per part, fitted with bounds on all distances.

A vector is cut into equal parts; each part has a codebook, and a vector's code is the index of the nearest entry of
each. Codebooks start from the smallest keys and are fitted by rounds of assigning all parts and moving each entry to
the mean of its parts. With each row go, per part, its entry, an upper bound of the distance to it, and a lower bound
of the distance to every entry. When entries move, the bounds are shifted by how far they moved. An entry is passed
over only where it is strictly farther: where its lower bound, or half the way between the two entries, lies above the
upper bound. The rest are compared by integer distances, ties going to the lower index, so the bounds change no result.
Lower bounds are kept in one byte each, rounded down to a multiple of a unit of the part; upper bounds in single
precision, rounded up. Both are written out with the rows between rounds.

A round reads the rows where they lie; each task sends one sum per part, entry and position. Only the codebooks pass
through the driver: ``entries`` times the length of a vector, whatever the number of rows.

Rows whose vector is null or has a null or non-finite component are dropped. Rows with a null key are kept and come
last among the first entries; fewer rows than entries give shorter codebooks; rows that repeat a key are rows of their
own, and among equal keys the smaller vector comes first. Null labels are one label. An empty table gives no rows. All
vectors must have one length that the number of parts divides, with components of at most 2^28 after scaling; anything else raises an error. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.vectors import LARGEST, checked, integer_rows
from factloom.session import discard, freeze, ship

#: Keeps a bound on the safe side of rounding.
SLACK = 1e-9


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer squared distances of all rows of a part from all entries."""
    return np.square(a[:, None, :] - b[None, :, :]).sum(axis=2)


def _units(books: np.ndarray) -> np.ndarray:
    """What one step of a stored lower bound means, per part."""
    return np.array([max(1.0, np.sqrt(_between(b, b).max())) / 254 for b in books])


def nearest(x: np.ndarray, book: np.ndarray, at: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entry, upper and lower bounds of each row of a part, and how many distances were computed. ``at``, ``upper`` and
    ``lower`` are bounds that hold for this codebook; without them every distance is computed."""
    if at is None:
        d = _between(x, book)
        at, lower = d.argmin(axis=1), np.sqrt(d)
        return at, lower[np.arange(len(x)), at], lower, d.size
    apart = np.sqrt(_between(book, book))

    def open_to(at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        reach = upper[:, None] * (1 + SLACK) + SLACK
        could = (lower <= reach) & (apart[at] <= 2 * reach)
        could[np.arange(len(at)), at] = False
        return could

    at, upper, lower = at.copy(), upper.copy(), lower.copy()
    rows = np.flatnonzero(open_to(at, upper, lower).any(axis=1))
    own = np.square(x[rows] - book[at[rows]]).sum(axis=1)
    upper[rows] = lower[rows, at[rows]] = np.sqrt(own)
    r, c = np.nonzero(open_to(at[rows], upper[rows], lower[rows]))
    d = np.square(x[rows[r]] - book[c]).sum(axis=1)
    exact = np.full((len(rows), len(book)), np.iinfo(np.int64).max)
    exact[np.arange(len(rows)), at[rows]] = own
    exact[r, c] = d
    lower[rows[r], c] = np.sqrt(d)
    at[rows] = exact.argmin(axis=1)  # the lower index of equal distances
    upper[rows] = np.sqrt(exact[np.arange(len(rows)), at[rows]])
    return at, upper, lower, len(rows) + len(d)


def _kept_bounds(upper: np.ndarray, lower: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nextafter(upper.astype(np.float32), np.float32(np.inf)), np.minimum(lower / unit * (1 - SLACK), 255).astype(np.uint8)


def _assign(state: DataFrame, books: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The rows with their entries and bounds for ``books``, from those for ``before`` if there are any."""
    parts, k, width = books.shape
    units = _units(books)
    if before is not None:
        old = _units(before)
        moved = np.sqrt(np.square(books - before).sum(axis=2)) * (1 + SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if before is None:
                v = _vectors(b.column("v"), parts * width)
            else:
                v = _from_bytes(b.column("v"), np.int32).reshape(n, parts * width).astype(np.int64)
                codes, uppers = _from_bytes(b.column("codes"), np.uint8).reshape(n, parts), _from_bytes(b.column("uppers"), np.float32).reshape(n, parts)
                lowers = _from_bytes(b.column("lowers"), np.uint8).reshape(n, parts, k)
            at, up, low = np.empty((n, parts), np.uint8), np.empty((n, parts), np.float32), np.empty((n, parts, k), np.uint8)
            for p in range(parts):
                x = v[:, p * width : (p + 1) * width]
                if before is None:
                    a, u, l, _ = nearest(x, books[p])
                else:
                    was = codes[:, p].astype(np.int64)
                    a, u, l, _ = nearest(x, books[p], was, uppers[:, p] + moved[p][was], lowers[:, p] * old[p] - moved[p])
                at[:, p] = a
                up[:, p], low[:, p] = _kept_bounds(u, np.maximum(l, 0), units[p])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), _to_bytes(v.astype(np.int32)), _to_bytes(at), _to_bytes(up), _to_bytes(low.reshape(n, parts * k))], names=["key", "label", "v", "codes", "uppers", "lowers"])

    kind = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    return state.mapInArrow(run, f"key {kind['key']}, label {kind['label']}, v binary, codes binary, uppers binary, lowers binary")


def _vectors(column: pa.ListArray, dim: int) -> np.ndarray:
    if len(column) and (np.asarray(column.value_lengths()) != dim).any():
        raise ValueError(f"all vectors must have {dim} components")
    return checked(np.asarray(column.flatten()).astype(np.int64)).reshape(-1, dim)


def _to_bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _from_bytes(column: pa.BinaryArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry becomes the mean of its parts, rounded down; entries without parts stay."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for b in batches:
            v = _from_bytes(b.column("v"), np.int32).reshape(b.num_rows, parts, width).astype(np.int64)
            codes = _from_bytes(b.column("codes"), np.uint8).reshape(b.num_rows, parts)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], v[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=k)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e], pa.int64()), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    own = state.select("v", "codes").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = own.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
    out = books.copy()
    for r in total.collect():  # one row per entry
        out[r.part, r.entry] = [s // r.n for s in r.sums]
    return out


def fit(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray | None]:
    """The kept rows with their final entries and bounds, and the codebooks (part, entry, position); None without rows."""
    if not 1 <= entries <= 256:
        raise ValueError("an index must fit one byte")
    ship(rows.sparkSession)
    state = integer_rows(rows, vector, F.col(key).alias("key"), F.col(label).alias("label"), scale=scale)
    first = [r.v for r in state.orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).collect()]
    if not first:
        return state, None
    dim = len(first[0])
    if dim % parts or any(len(v) != dim for v in first):
        raise ValueError(f"all vectors must have one length that {parts} divides")
    if max((abs(x) for v in first for x in v), default=0) > LARGEST:
        raise ValueError(f"a vector component times its scale lies beyond {LARGEST}")
    books, before = np.array(first, np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy(), None
    for done in range(rounds + 1):
        last, state = state, freeze(_assign(state, books, before), "assigned")
        if before is not None:
            discard(last)
        if done < rounds:
            before, books = books, _moved(state, books)
    return state, books


def listed(books: np.ndarray) -> str:
    """All components by part, entry and position."""
    return ",".join(map(str, books.ravel().tolist()))


def decode(code: str, books: np.ndarray) -> list[int]:
    """The vector that a code stands for."""
    return [x for p, e in enumerate(bytes.fromhex(code)) for x in books[p, e].tolist()]


def _coded(state: DataFrame, books: np.ndarray) -> DataFrame:
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = _from_bytes(b.column("codes"), np.uint8).reshape(b.num_rows, parts)
            v = _from_bytes(b.column("v"), np.int32).reshape(b.num_rows, parts, width).astype(np.int64)
            error = np.square(v - books[np.arange(parts), codes]).sum(axis=(1, 2))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], names=["key", "label", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    return state.select("key", "label", "v", "codes").mapInArrow(run, f"key {kind['key']}, label {kind['label']}, code string, error long")


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """One row per kept row: ``key``, ``code`` (two hex digits a part), ``error``, ``label_error`` and ``codebooks_sha256``."""
    state, books = fit(rows, key, vector, label, parts, entries, rounds, scale)
    if books is None:
        return state.select(F.col("key").alias(key), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    coded = freeze(_coded(state, books), "coded")
    discard(state)
    by = freeze(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label_errors")
    out = coded.join(by, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(hashlib.sha256(listed(books).encode()).hexdigest()).alias("codebooks_sha256"))


def _oracle(rounds: int = 2) -> str:
    """The fit in SQL, a round after the other."""
    nearest_of = "SELECT x.*, b.entry, row_number() OVER (PARTITION BY vec_id, x.part ORDER BY {d}, b.entry) AS rn, {d} AS d FROM x JOIN {book} b ON x.part = b.part".format
    d = " + ".join(f"(x.v[{i}] - b.v[{i}]) * (x.v[{i}] - b.v[{i}])" for i in range(1, 5))
    mean = ", ".join(f"CAST((sum(v[{i}]) - ((sum(v[{i}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)" for i in range(1, 5))
    sql = """
WITH r AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT vec_id, label, part, list_slice(v, part * 4 + 1, part * 4 + 4) AS v FROM r, (SELECT unnest(range(16)) AS part) p),
b0 AS (SELECT part, pos AS entry, list_slice(v, part * 4 + 1, part * 4 + 4) AS v FROM r, (SELECT unnest(range(16)) AS part) p WHERE pos < 64)"""
    for i in range(rounds):
        sql += f""",
a{i} AS (SELECT part, entry, v FROM ({nearest_of(d=d, book=f'b{i}')}) WHERE rn = 1),
b{i + 1} AS (SELECT o.part, o.entry, coalesce(m.v, o.v) AS v FROM b{i} o LEFT JOIN (SELECT part, entry, [{mean}] AS v FROM a{i} GROUP BY part, entry) m ON o.part = m.part AND o.entry = m.entry)"""
    return sql + f""",
f AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM ({nearest_of(d=d, book=f'b{rounds}')}) WHERE rn = 1 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f, h
"""


ORACLE = _oracle()
