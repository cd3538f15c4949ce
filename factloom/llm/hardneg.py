"""Operator 11: hard-negative mining by a full score sort per anchor.

An anchor's positives are its best other rows of the same label; for each of them the best rows of another label
are wanted whose score is at most the positive's and at least a share of it. Scores are integer inner products.

Rows are packed into blocks of at most one Arrow batch, anchors into blocks of about ``ANCHORS``; each anchor block
meets each row block once, in a task that holds one pair of blocks. There the scores are computed as one matrix
product, sorted for each anchor by score and id, the upper limit of each positive is found by binary search, and
the best rows of another label are read from there down to the lower limit. A first pass finds the positives, a
second one the negatives; a task merges what it finds for an anchor, so that per anchor or positive only the best
few rows leave it, and a window keeps the best of those. Memory depends on the block sizes alone. The work is that of every
anchor against every row, which is what an exact search by full sort means.

Rows with a null id, label or vector, or with a null or non-finite component take no part. Vectors of different
lengths have no score and never meet; an empty vector scores 0 with another. Rows that repeat an id are rows of
their own: an anchor never meets itself, but a repetition of it is another row; a repeated anchor is mined twice.
Ties go to the smaller id, then to any fixed order. Negative positives have no negatives, as the lower limit lies
above the upper one. An empty table gives no rows. Components beyond 2^28 after scaling raise an error. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.vectors import checked, integer_rows
from factloom.session import freeze, partitions_for, ship

ANCHORS = 512
ROWS = 4096
_BLOCK = "dim int, ids binary, labels binary, is_anchor binary, comps binary"


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, dim)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of rows of one vector length; components in 16 bits where they fit, which ``comps`` shows by its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.asarray(b.column("v").value_lengths())
            for dim in np.unique(lengths).tolist():
                own = b.filter(pa.array(lengths == dim))
                for at in range(0, own.num_rows, size):
                    cut = own.slice(at, size)
                    v = checked(_matrix(cut.column("v"), dim) if dim else np.zeros((cut.num_rows, 0), np.int64))
                    small = v.astype(np.int16)
                    v = small if (small == v).all() else v
                    ids, labels = (np.asarray(cut.column(c)).astype(np.int64) for c in ("id", "label"))
                    order = np.argsort(ids, kind="stable")
                    mask = np.asarray(cut.column("is_anchor").to_numpy(zero_copy_only=False)).astype(np.uint8)
                    yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), **{k: pa.array([x[order].tobytes()], pa.binary()) for k, x in (("ids", ids), ("labels", labels), ("is_anchor", mask), ("comps", v))}})

    return rows.mapInArrow(run, _BLOCK)


def _comps(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int16 if len(raw) == 2 * n * dim else np.int64).reshape(n, dim)


def _anchor_rows(blocks: DataFrame) -> DataFrame:
    """One row per anchor: where it lies, its id, label and components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                ids, labels = (np.frombuffer(x[c], np.int64) for c in ("ids", "labels"))
                at = np.flatnonzero(np.frombuffer(x["is_anchor"], np.uint8))
                v = _comps(x["comps"], len(ids), x["dim"]).astype(np.int64)
                cols = {"dim": np.full(len(at), x["dim"], np.int32), "block": np.full(len(at), x["block"], np.int64), "place": at.astype(np.int32), "id": ids[at], "label": labels[at]}
                yield pa.RecordBatch.from_pydict({**{k: pa.array(c) for k, c in cols.items()}, "comps": pa.array([v[i].tobytes() for i in at], pa.binary())})

    return blocks.mapInArrow(run, "dim int, block long, place int, id long, label long, comps binary")


def _scores(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where no sum can leave the integers it holds exactly."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(v).max(initial=0)) * max(1, a.shape[1])
    return np.rint(a.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64) if most < 1 << 53 else a.astype(np.int64) @ v.astype(np.int64).T


def _merge(best: dict, key: tuple, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Keep the k best of a key, by falling score, then id."""
    if not len(scores):
        return
    if key in best:
        scores, ids = np.concatenate((best[key][0], scores)), np.concatenate((best[key][1], ids))
    order = np.lexsort((ids, -scores))[:k]
    best[key] = scores[order], ids[order]


def _cells(pairs: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """What each task finds over its pairs of blocks. Without ``wanted`` in the anchors, their best rows of the same
    label; with it, for each wanted positive (by rank) the best rows of another label between the limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            keys = [k for k, (s, _) in best.items() for _ in range(len(s))]
            cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            found = [np.concatenate([x[i] for x in best.values()]) if best else np.zeros(0, np.int64) for i in (0, 1)]
            best.clear()
            return pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.int64()) for x in found)], names=["block", "place", "rank", "score", "other"])

        for b in batches:
            for i in range(b.num_rows):
                dim, block = b.column("dim")[i].as_py(), b.column("block")[i].as_py()
                ids, labels = (np.frombuffer(b.column(c)[i].as_buffer(), np.int64) for c in ("ids", "labels"))
                v = _comps(b.column("comps")[i].as_buffer(), len(ids), dim)
                anchors = b.column("anchors")[i].as_py()
                a = np.frombuffer(b"".join(x["comps"] for x in anchors), np.int64).reshape(len(anchors), dim)
                for x, s in zip(anchors, _scores(a, v), strict=True):
                    same = labels == x["label"]
                    if positives and block == x["block"]:
                        same[x["place"]] = False  # not itself
                    part = np.flatnonzero(same if positives else ~same)
                    order = part[np.argsort(-s[part], kind="stable")]  # a block's ids ascend
                    if positives:
                        _merge(best, (x["block"], x["place"], 0), s[order[:positives]], ids[order[:positives]], positives)
                        continue
                    falling = -s[order]
                    for rank, p in enumerate(x["wanted"], 1):
                        top = np.searchsorted(falling, -(high * p // 100), "left")  # the first score not above the upper limit
                        end = min(np.searchsorted(falling, (-low * p) // 100, "right"), top + negatives)  # the last one not below the lower limit
                        _merge(best, (x["block"], x["place"], rank), s[order[top:end]], ids[order[top:end]], negatives)
                if len(best) > 50_000:
                    yield flush()
        yield flush()

    return pairs.mapInArrow(run, "block long, place int, rank int, score long, other long")


def _meet(blocks: DataFrame, anchors: DataFrame, groups: int, slots: int) -> DataFrame:
    """Each anchor block beside each row block of the same vector length, by an equal join on the pair of places. Neither
    side is broadcast: the copies of the anchors lie in as many tasks as there are pairs of places."""
    left = blocks.select("dim", "block", "ids", "labels", "comps", F.pmod(F.xxhash64("block"), F.lit(slots)).alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    right = anchors.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    return left.join(right.hint("shuffle_hash"), ["dim", "group", "slot"])


def _slots(groups: int, partitions: int) -> int:
    """Places of row blocks: enough for a pair of places in every partition, no more, as every place takes a copy of all anchors."""
    return max(1, -(-partitions // groups))


def mine(rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, group: int = ANCHORS, size: int = ROWS) -> DataFrame:
    """One row per negative found: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``,
    ``negative_score``, and ``positive_rank``. ``anchor`` says which rows are anchors; negatives score from ``low`` to ``high`` percent of the positive."""
    spark = rows.sparkSession
    ship(spark)
    known = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    wide = integer_rows(known, vector, F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"), scale=scale)
    blocks = freeze(_packed(wide, size).withColumn("block", F.monotonically_increasing_id()), "row_blocks")
    anchors = freeze(_anchor_rows(blocks), "anchors")
    groups = max(1, -(-anchors.count() // group))
    slots = _slots(groups, partitions_for(spark))
    dealt = F.pmod(F.xxhash64("block", "place"), F.lit(groups)).cast("int").alias("group")

    best = _cells(_meet(blocks, _grouped(anchors.withColumn("wanted", F.array().cast("array<long>")), dealt), groups, slots), positives, 0, low, high)
    by = Window.partitionBy("block", "place").orderBy(F.col("score").desc(), "other")
    pos = freeze(best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= positives), "positives")

    wanted = pos.groupBy("block", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("wanted"))
    found = _cells(_meet(blocks, _grouped(anchors.join(wanted, ["block", "place"]), dealt), groups, slots), 0, negatives, low, high)
    by = Window.partitionBy("block", "place", "positive_rank").orderBy(F.col("score").desc(), "other")
    neg = found.withColumnRenamed("rank", "positive_rank").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    of = pos.join(anchors.select("block", "place", F.col("id").alias("anchor_id")), ["block", "place"])
    of = of.select("block", "place", F.col("rank").alias("positive_rank"), "anchor_id", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return neg.join(of, ["block", "place", "positive_rank"]).select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), "positive_rank")


def _grouped(anchors: DataFrame, dealt: Column) -> DataFrame:
    """Anchor blocks; dealt by a hash of each anchor's place, so that their sizes stay near the wanted one."""
    return anchors.groupBy("dim", dealt).agg(F.collect_list(F.struct("block", "place", "label", "comps", "wanted")).alias("anchors"))


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM r a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score,
       CAST(dense_rank() OVER (PARTITION BY anchor_id ORDER BY positive_score DESC, positive_id) AS INTEGER) AS positive_rank
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""
