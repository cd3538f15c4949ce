"""Points against paths and boxes against axis lines: grid-indexed joins, no pairs of what lies far apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import partitions_for, ship


def path_segments(points: DataFrame) -> DataFrame:
    """Segments of paths (``path``, ``ord``, ``x``, ``y``): both ends, the length up to the segment and that of the path.
    Paths of one point have none."""
    w = Window.partitionBy("path").orderBy("ord")
    s = points.withColumn("bx", F.lead("x").over(w)).withColumn("by", F.lead("y").over(w)).where("bx is not null")
    s = s.select("path", "ord", F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay"), F.col("bx").cast("double").alias("bx"), F.col("by").cast("double").alias("by"))
    s = s.withColumn("size", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    done = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    return s.withColumn("before", done).withColumn("length", F.sum("size").over(Window.partitionBy("path")))


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))


def _rounded(d: np.ndarray) -> np.ndarray:
    """Billionths, halves away from zero, as SQL rounds to nine digits."""
    v = d * 1e9
    low = np.floor(v)
    return low + (v - low >= 0.5)


def _hits(tolerance: float, pairs: int) -> Callable:
    """What one cell holds, in: segments, and probes without a second end. Out: each probe's paths in order, a few probes
    in a batch, so that about ``pairs`` pairs are in memory at once however many are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        probes, s = rows.filter(pc.is_null(rows["bx"])), rows.filter(pc.is_valid(rows["bx"]))
        if not probes.num_rows or not s.num_rows:
            return
        path, ord_ = (pc.rank(s[c], "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) for c in ("path", "ord"))
        order = np.lexsort((ord_, path))
        path, names = path[order], s["path"].combine_chunks().take(pa.array(order))
        ax, ay, bx, by, before, length = (s[c].to_numpy()[order] for c in ("x", "y", "bx", "by", "before", "length"))
        vx, vy = bx - ax, by - ay
        square = vx * vx + vy * vy
        size, square = np.sqrt(square), np.where(square == 0, 1.0, square)  # a segment without length is a point
        low_x, high_x, low_y, high_y = np.fmin(ax, bx) - tolerance, np.fmax(ax, bx) + tolerance, np.fmin(ay, by) - tolerance, np.fmax(ay, by) + tolerance
        asked = probes["probe"].combine_chunks()
        one = np.unique(pc.rank(asked, "ascending", tiebreaker="dense").to_numpy(), return_index=True)[1]
        px, py = (probes[c].to_numpy()[one] for c in ("x", "y"))
        close = np.lexsort((py, np.floor(px / 4)))  # probes of a batch lie close together, so that few segments are compared
        px, py, asked = px[close], py[close], asked.take(pa.array(one[close]))
        step = max(1, pairs // len(path))
        for k in range(0, len(px), step):
            x, y = px[k : k + step], py[k : k + step]
            near = np.flatnonzero((low_x <= x.max()) & (high_x >= x.min()) & (low_y <= y.max()) & (high_y >= y.min()))
            if not len(near):
                continue
            x, y, nx, ny, wx, wy = x[:, None], y[:, None], ax[near], ay[near], vx[near], vy[near]
            t = (x - nx) * wx
            t += (y - ny) * wy
            t /= square[near]
            np.clip(t, 0.0, 1.0, out=t)
            d = wx * t
            d += nx
            np.subtract(x, d, out=d)
            d *= d
            e = wy * t
            e += ny
            np.subtract(y, e, out=e)
            e *= e
            d += e
            np.sqrt(d, out=d)
            hit = np.flatnonzero(d <= tolerance)
            if not len(hit):
                continue
            probe, at, d, t = hit // len(near), near[hit % len(near)], d.ravel()[hit], t.ravel()[hit]
            rounded = _rounded(d)
            # Hits of a probe and path lie together, by ord: the first of the nearest ones counts.
            first = np.flatnonzero(np.r_[True, (np.diff(probe) != 0) | (np.diff(path[at]) != 0)])
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(hit)]))
            least = np.flatnonzero(rounded == np.minimum.reduceat(rounded, first)[group])
            best = least[np.r_[True, np.diff(group[least]) != 0]]
            best = best[np.lexsort((rounded[best], probe[best]))]  # stable: equal distances stay by path
            own, at = probe[best], at[best]
            rank = np.arange(1, len(best) + 1) - np.searchsorted(own, own)
            source = before[at] + t[best] * size[at] <= length[at] / 2
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(own + k)), names.take(pa.array(at)), pa.array(d[best]), pa.array(source), pa.array(rank.astype(np.int32))], names=["probe", "path", "distance", "source", "rank"])

    return run


def paths_at(probes: DataFrame, points: DataFrame, tolerance: float, cell: float = 32, pairs: int = 1 << 19) -> DataFrame:
    """Paths within ``tolerance`` of each probe (``probe``, ``x``, ``y``), the nearest first: ``probe``, ``path``,
    ``distance``, ``zone`` and ``rank``. The zone is source up to half of the path's length, else target; of equally near
    segments the first counts; equal distances rank by path. Segments meet probes in shared grid cells only; a probe's name stands for one point.

    A probe lies in one cell, so segments and probes are shuffled by cell. The hits, which may be far more than both, are
    found, grouped and ranked for a few probes at a time (at most about ``pairs`` pairs) and handed on: they are never shuffled,
    sorted as a whole or spilled. A task holds the segments of one cell."""
    spark = points.sparkSession
    ship(spark)
    s = path_segments(points)
    ends = lambda c: (F.least(f"a{c}", f"b{c}") - tolerance, F.greatest(f"a{c}", f"b{c}") + tolerance)
    s = s.withColumn("cx", _cells(*ends("x"), cell)).withColumn("cy", _cells(*ends("y"), cell))
    s = s.select("cx", "cy", "path", "ord", F.col("ax").alias("x"), F.col("ay").alias("y"), "bx", "by", "before", "length")
    p = probes.select("probe", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    p = p.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    met = s.unionByName(p, allowMissingColumns=True).repartition(partitions_for(spark), "cx", "cy")  # work is not in proportion to bytes: no parts are put together
    hits = met.groupBy("cx", "cy").applyInArrow(_hits(tolerance, pairs), f"probe {kind(probes, 'probe')}, path {kind(points, 'path')}, distance double, source boolean, rank int")
    return hits.select("probe", "path", "distance", F.when(F.col("source"), "source").otherwise("target").alias("zone"), "rank")


def cleared(boxes: DataFrame, left: float, right: float, vertical: float) -> DataFrame:
    """Boxes (``region``, ``id``, ``x0``, ``y0``, ``x1``, ``y1``) grown by the clearances that routes keep."""
    return boxes.select("region", "id", (F.col("x0") - left).alias("x0"), (F.col("y0") - vertical).alias("y0"), (F.col("x1") + right).alias("x1"), (F.col("y1") + vertical).alias("y1"))


def axis_lines(boxes: DataFrame, gap_x: float, gap_y: float, eps: float = 0.001) -> DataFrame:
    """``region``, ``axis``, ``at``: the distinct edges of all boxes and one line beyond the outermost on either side. A
    line less than ``eps`` above the one before it is left out."""
    def axis(name: str, gap: float) -> DataFrame:
        lo, hi = f"{name}0", f"{name}1"
        edges = boxes.select("region", F.explode(F.array(lo, hi)).alias("at"))
        outer = boxes.groupBy("region").agg(F.min(lo).alias("a"), F.max(hi).alias("b")).select("region", F.explode(F.array(F.col("a") - gap, F.col("b") + gap)).alias("at"))
        return edges.union(outer).distinct().withColumn("axis", F.lit(name))

    lines = axis("x", gap_x).union(axis("y", gap_y))
    below = F.lag("at").over(Window.partitionBy("region", "axis").orderBy("at"))
    return lines.withColumn("_b", below).where(F.col("_b").isNull() | (F.col("at") - F.col("_b") >= eps)).select("region", "axis", "at")


def blockers(lines: DataFrame, boxes: DataFrame, eps: float = 0.001, cell: float = 64) -> DataFrame:
    """``region``, ``axis``, ``at``, ``id``: the boxes that each line runs through, edges left out. Lines and boxes meet in
    shared stretches of the axis only."""
    stretch = lambda name: boxes.select("region", F.lit(name).alias("axis"), "id", F.col(f"{name}0").alias("lo"), F.col(f"{name}1").alias("hi"))
    b = stretch("x").union(stretch("y")).withColumn("cell", _cells(F.col("lo"), F.col("hi"), cell))
    hit = lines.withColumn("cell", F.floor(F.col("at") / cell)).join(b, ["region", "axis", "cell"])
    return hit.where((F.col("lo") + eps < F.col("at")) & (F.col("at") < F.col("hi") - eps)).select("region", "axis", "at", "id")
