"""Operator 13: removal of repeated passages by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of ``span`` bytes that covers it also starts anywhere else. The strings that start at each
place are never sorted one by one. Of the ``q``-byte strings inside a span the one with the least hash (the leftmost
of equals) represents it, so equal spans are represented at the same offset by equal strings. The distinct
representatives, about one in 77 places, are the suffixes that are kept; each serves a run of consecutive spans.

Initial buckets hold the suffixes with equal ``q`` bytes; a bucket of one suffix is done. The identifier of a bucket is a
name made from its bytes, so that the identifiers at later offsets of a suffix are known where its text lies and need no
look-up. A bucket is refined by the identifiers of what its suffixes' runs of spans cover:

* spans of a run whose whole stretch has the same identifier as another one's repeat: all of the run is settled;
* spans whose common middle is in nobody else's bucket do not repeat: settled as well;
* the rest are halved twice (runs of at most 64, 16, 4, 1 spans) and refined again, on the new, smaller buckets. Of suffixes
  with the same identifier one goes on, marked as settled, for the others to meet.

A run of one span is the span itself, so nothing is left open. Identifiers are 128-bit names (a 64-bit one for the
bucket besides). Groups are counted with partial sums before their shuffle; places are found by joins with tables of one row
per bucket, whose hot keys Spark can split. Nothing is listed pair by pair and no group is gathered.

Nulls and texts below ``span`` bytes lose nothing. Very long texts are read in overlapping chunks; results do not
depend on the chunks. Rows that repeat key and text are rows of their own, and so repeat each other; a null key is a
key like any other. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import freeze, ship

SPAN, Q = 200, 48
#: Runs of at most so many spans, level by level; the first level takes a suffix's whole run.
RUNS = (64, 16, 4, 1)
CHUNK = 1 << 20
_OWN = ["id1", "id2", "at"]
_BLOCK = "id1 long, id2 long, at long, first short, last short, settled boolean, bucket long, n1 long, n2 long"


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base, of its inverse, and a random number for each byte; all modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    rng = np.random.default_rng(20260301)
    up, down = (np.cumprod(np.full(CHUNK, x, np.uint64)) for x in (base, pow(base, -1, 1 << 64)))
    return up, down, rng.integers(0, 1 << 64, 256, np.uint64)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` keys."""
    n = len(keys)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = keys
    rows = rows.reshape(-1, width)
    left, right = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(right[:count], left[width - 1 : width - 1 + count])


def suffixes(text: bytes, span: int = SPAN, q: int = Q) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: places of the kept suffixes, the hash of their ``q`` bytes, and the first and last span each serves."""
    if len(text) < span:
        return
    up, down, of_byte = _powers()
    step = CHUNK - span
    for begin in range(0, len(text) - span + 1, step):
        b = np.frombuffer(text, np.uint8)[begin : begin + step + span - 1]
        n = len(b)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(of_byte[b] * up[:n], out=sums[1:])
        h = (sums[q:] - sums[:-q]) * down[: n - q + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        low = np.uint64(CHUNK - 1)
        at = (_least((h & ~low) | np.arange(len(h), dtype=np.uint64), span - q + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:] - 1, [len(at) - 1]))
        yield at[first] + begin, h[at[first]].view(np.int64), first + begin, last + begin


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``text`` and an identity made from both: the same whenever the table is read."""
    k, t = F.col(key).cast("string"), F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("key"), t.alias("text"), F.xxhash64(k, t).alias("id1"), F.xxhash64(F.lit(13), t, k).alias("id2"))


def _buckets(docs: DataFrame, span: int, q: int) -> DataFrame:
    """The initial bucket of every kept suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [h for t in b.column("text") for _, h, _, _ in suffixes(t.as_buffer().to_pybytes(), span, q)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], names=["bucket"])

    return docs.select("text").mapInArrow(run, "bucket long")


def _runs(docs: DataFrame, span: int, q: int) -> DataFrame:
    """Every kept suffix with its bucket and the name of the stretch that its run of spans covers. ``first`` and ``last``
    say how far before the suffix the run's last and first spans start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for t, i, j in zip(b.column("text"), b.column("id1").to_pylist(), b.column("id2").to_pylist(), strict=True):
                raw = t.as_buffer().to_pybytes()
                for at, h, lo, hi in suffixes(raw, span, q):
                    far, near = at - lo, at - hi
                    names = [xxh3_128_intdigest(raw[x : y + span], (f << 16) | n) for x, y, f, n in zip(lo.tolist(), hi.tolist(), far.tolist(), near.tolist(), strict=True)]
                    for col, more in zip(cols, ([i] * len(at), [j] * len(at), at.tolist(), near.tolist(), far.tolist(), h.tolist(), [_signed(x >> 64) for x in names], [_signed(x & (1 << 64) - 1) for x in names]), strict=True):
                        col += more
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id1", "id2", "at", "first", "last", "bucket", "n1", "n2"])

    return docs.select("id1", "id2", "text").mapInArrow(run, _BLOCK.replace("settled boolean, ", ""))


def _counted(blocks: DataFrame) -> DataFrame:
    """One row per identifier: how often it occurs, one of its places, whether it is settled."""
    place = F.struct("id1", "id2", "at", "first", "last")
    return blocks.groupBy("bucket", "n1", "n2").agg(F.count("*").alias("n"), F.bool_or("settled").alias("settled"), F.min(place).alias("place"))


def _repeated(blocks: DataFrame, counted: DataFrame) -> DataFrame:
    """The places, not settled before, of identifiers that occur more than once."""
    twice = counted.where("n > 1").select(*(F.col(c).alias(f"of_{c}") for c in ("bucket", "n1", "n2")))
    same = [F.col(c) == F.col(f"of_{c}") for c in ("bucket", "n1", "n2")]
    return blocks.where("not settled").join(twice, same, "left_semi").select(*_OWN, "first", "last")


def _open(counted: DataFrame) -> DataFrame:
    """One place for each identifier of the buckets that hold several, some of them not settled."""
    mixed = counted.groupBy("bucket").agg(F.count("*").alias("names"), F.bool_or((F.col("n") == 1) & ~F.col("settled")).alias("open")).where("names > 1 and open").select(F.col("bucket").alias("of"))
    mixed = freeze(mixed, "open_buckets")  # a written side lets Spark split the rows of a bucket with very many names
    return counted.join(mixed, F.col("bucket") == F.col("of"), "left_semi").select("place.*", (F.col("settled") | (F.col("n") > 1)).alias("settled"))


def _texts(docs: DataFrame, places: DataFrame, span: int) -> DataFrame:
    """Each open suffix with the bytes that its run covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for t, i, j, own in zip(b.column("text"), b.column("id1").to_pylist(), b.column("id2").to_pylist(), b.column("own").to_pylist(), strict=True):
                raw = t.as_buffer().to_pybytes()
                rows += [(i, j, x["at"], x["last"], raw[x["at"] - x["last"] : x["at"] - x["first"] + span]) for x in own]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.binary()), strict=True)], names=["id1", "id2", "at", "reach", "bytes"])

    own = places.groupBy("id1", "id2").agg(F.collect_set(F.struct("at", "first", "last")).alias("own"))
    return docs.join(own, ["id1", "id2"]).select("id1", "id2", "text", "own").mapInArrow(run, "id1 long, id2 long, at long, reach short, bytes binary")


def _smaller(texts: DataFrame, places: DataFrame, size: int, span: int) -> DataFrame:
    """The runs of open suffixes cut at multiples of ``size``, each piece with its bucket and name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

        for b in batches:
            rows: list[tuple] = []
            for x in b.to_pylist():
                raw, reach = x["bytes"], x["reach"]
                for own in x["own"]:
                    for block in range(own["first"] // size, own["last"] // size + 1):
                        low, high = block * size, block * size + size - 1
                        near, far = max(low, own["first"]), min(high, own["last"])
                        # the bytes that all spans of the block share, even those that this run lacks
                        bucket = xxh3_64_intdigest(raw[reach - low : reach - high + span], block)
                        name = xxh3_128_intdigest(raw[reach - far : reach - near + span], (far << 16) | near)
                        rows.append((x["id1"], x["id2"], x["at"], near, far, own["settled"], _signed(bucket), _signed(name >> 64), _signed(name & (1 << 64) - 1)))
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])

    # a suffix has at most as many open pieces as its run has spans
    own = places.groupBy(*_OWN).agg(F.collect_set(F.struct("first", "last", "settled")).alias("own"))
    return texts.join(own, _OWN).select(*_OWN, "reach", "bytes", "own").mapInArrow(run, _BLOCK)


def repeats(docs: DataFrame, span: int = SPAN, q: int = Q) -> DataFrame:
    """``id1``, ``id2``, ``start``, ``end``: stretches, overlapping ones too, whose spans all repeat. ``docs`` has ``text`` and the identity."""
    if not 1 <= q < span or span - q >= 1 << 15:
        raise ValueError("q must lie below the span")
    shared = freeze(_buckets(docs, span, q).groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select(F.col("bucket").alias("of")), "shared_buckets")
    blocks = freeze(_runs(docs, span, q).join(shared, F.col("bucket") == F.col("of"), "left_semi").withColumn("settled", F.lit(False)), "runs")
    counted = freeze(_counted(blocks), "run_names")
    found = _repeated(blocks, counted)
    places = freeze(_open(counted), "open")
    texts = freeze(_texts(docs, places, span).distinct(), "open_texts")
    for size in RUNS:
        if size > span - q:
            continue
        blocks = freeze(_smaller(texts, places, size, span), "runs")
        counted = freeze(_counted(blocks), "run_names")
        found = found.union(_repeated(blocks, counted))
        if size > 1:
            places = freeze(_open(counted), "open")
    return found.select("id1", "id2", (F.col("at") - F.col("last")).alias("start"), (F.col("at") - F.col("first") + span).alias("end"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, q: int = Q, content: bool = True) -> DataFrame:
    """One row per document: ``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, with ``content``, the
    removed runs ``spans`` (start, end) and the remaining bytes ``kept``."""
    ship(docs.sparkSession)
    own = _identified(docs, key, text)
    found = repeats(own, span, q).groupBy("id1", "id2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    kind = docs.schema[key].dataType.simpleString()
    cols = f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start: long, end: long>>, kept binary" * content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            sizes, removed, runs, kept = [], [], [], []
            for t, s in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
                raw = t.as_buffer().to_pybytes()
                merged: list[list[int]] = []
                for x, y in sorted((x["start"], x["end"]) for x in s or ()):
                    if merged and x <= merged[-1][1]:
                        merged[-1][1] = max(y, merged[-1][1])
                    else:
                        merged.append([x, y])
                edges = [0, *(e for m in merged for e in m), len(raw)]
                kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(raw)), removed.append(len(raw) - len(kept[-1])), runs.append([{"start": x, "end": y} for x, y in merged])
            out = [b.column("key"), *(pa.array(x, pa.int64()) for x in (sizes, removed, [len(r) for r in runs])), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            out += [pa.array(runs, span_type), pa.array(kept, pa.binary())] if content else []
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in ("key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")[: len(out)]])

    return own.join(found, ["id1", "id2"], "left").select("key", "text", "spans").mapInArrow(run, cols).withColumnRenamed("key", key)


#: Every 200-byte string by its place, in hexadecimal digits, cut from blocks of 400 bytes so that it takes linear time.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, j, n, substr(h, 800 * j + 1, 1200) AS part FROM (SELECT doc_id, h, length(h) // 2 AS n, unnest(range(0, length(h) // 800 + 1)) AS j FROM d) x),
p AS (SELECT doc_id, 400 * j + o AS i, md5(substr(part, 2 * o + 1, 400)) AS m FROM c, (SELECT unnest(range(0, 400)) AS o) os WHERE 400 * j + o <= n - 200),
s AS (SELECT doc_id, i FROM p WHERE m IN (SELECT m FROM p GROUP BY m HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM s),
r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) x GROUP BY doc_id, run),
k AS (SELECT r.doc_id, a, b, substr(h, 2 * lag(b, 1, 0) OVER (PARTITION BY r.doc_id ORDER BY a) + 1, 2 * (a - lag(b, 1, 0) OVER (PARTITION BY r.doc_id ORDER BY a))) AS kept FROM r JOIN d ON r.doc_id = d.doc_id),
t AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS n, max(b) AS stop, string_agg(kept, '' ORDER BY a) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
