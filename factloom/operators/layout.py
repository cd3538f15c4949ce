"""Geometry of the diagram that plain columns can compute: snapping, bands, rows, boxes, paths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import ship

#: Fixed values of the layout: long rows, the wanted shape, the character width of the default measure.
LONG_ROW, LONG_FACTOR, SHAPE, CHAR = 360.0, 1.8, 16 / 9, 7


def text_width(text: Column | str, padding: int = 0) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.length(t) * CHAR + padding


def snapped(boxes: DataFrame, cell: int) -> DataFrame:
    """Boxes grown outward to whole cells."""
    return boxes.select("*", (F.floor(F.col("x0") / cell)).alias("c0"), (F.floor(F.col("y0") / cell)).alias("r0"), (F.ceil(F.col("x1") / cell)).alias("c1"), (F.ceil(F.col("y1") / cell)).alias("r1"))


def conflicts(boxes: DataFrame, clearance: int = 0, cell: int = 256) -> DataFrame:
    """Pairs (a < b) in one region whose boxes, one of them grown by ``clearance``, overlap. Boxes meet only in shared
    grid buckets, so far apart ones are never paired."""
    grown = boxes.select("region", "id", F.col("x0") - clearance, F.col("y0") - clearance, F.col("x1") + clearance, F.col("y1") + clearance).toDF("region", "id", "x0", "y0", "x1", "y1")
    cut = lambda df: df.withColumn("bx", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))).withColumn("by", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
    a, b = cut(grown).alias("a"), cut(boxes.select("region", "id", "x0", "y0", "x1", "y1")).alias("b")
    hit = a.join(b, (F.col("a.region") == F.col("b.region")) & (F.col("a.bx") == F.col("b.bx")) & (F.col("a.by") == F.col("b.by")) & (F.col("a.id") != F.col("b.id")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1")))
    return hit.select(F.col("a.region").alias("region"), F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def long_rows(rows: DataFrame, box: str = "box", width: str = "width", header: str = "header") -> DataFrame:
    """Rows to set apart: at least 360 wide and 1.8 times the median of the box's narrower rows, or where it has none
    1.8 times its ``header`` width (a column; without it such a box has no header)."""
    head = F.col(header) if header in rows.columns else F.lit(0)
    normal = rows.where(F.col(width) < LONG_ROW).groupBy(F.col(box).alias("_b")).agg(F.median(width).alias("mid"))
    return rows.join(normal, F.col(box) == F.col("_b"), "left").select(*rows.columns, ((F.col(width) >= LONG_ROW) & (F.col(width) >= LONG_FACTOR * F.greatest(F.coalesce("mid", head), F.lit(1)))).alias("long"))


def fragments(rows: DataFrame, box: str = "box", ord: str = "ord") -> DataFrame:
    """Runs of rows with the same ``long`` flag become fragments, numbered within their box."""
    w = Window.partitionBy(box).orderBy(ord)
    r = rows.withColumn("_new", F.coalesce(F.col("long") != F.lag("long").over(w), F.lit(True)).cast("int"))
    return r.withColumn("fragment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def depth_buckets(items: DataFrame) -> DataFrame:
    """Prelude items first, then by depth, function columns before others, input order, name, id; a new bucket where
    prelude or depth changes."""
    w = Window.partitionBy("module").orderBy(F.desc("prelude"), "depth", F.desc("fn_column"), "ord", "name", "id")
    change = (F.col("depth") != F.lag("depth").over(w)) | (F.col("prelude") != F.lag("prelude").over(w))
    i = items.withColumn("_new", F.coalesce(change, F.lit(True)).cast("int")).withColumn("place", F.row_number().over(w))
    return i.withColumn("bucket", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def chunks(items: DataFrame, by: str, groups: int, ord: str = "ord") -> DataFrame:
    """``groups`` slices of nearly equal size in order."""
    n = F.count("*").over(Window.partitionBy(by))
    rn = F.row_number().over(Window.partitionBy(by).orderBy(ord))
    return items.withColumn("chunk", F.floor((rn - 1) / F.ceil(n / groups)).cast("int"))


def band_groups(counts: DataFrame) -> DataFrame:
    """Number of side-by-side groups for ``n`` items: groups are added while groups / rows comes nearer to 16:9."""
    gap = lambda g: F.abs(g / F.ceil(F.col("n") / g) - F.lit(SHAPE))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))), lambda g: F.struct(gap(g).alias("d"), g.alias("g")))
    # the first group count after which the distance stops shrinking
    stop = F.filter(F.zip_with(each, F.slice(each, F.lit(2), F.greatest(F.size(each) - 1, F.lit(0))), lambda a, b: F.struct((b["d"].isNull() | (b["d"] >= a["d"])).alias("ends"), a["g"].alias("g"))), lambda z: z["ends"])
    return counts.select("*", F.element_at(stop, 1)["g"].alias("groups"))


def row_tops(rows: DataFrame, by: str = "box", ord: str = "ord", height: str = "height") -> DataFrame:
    w = Window.partitionBy(by).orderBy(ord).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("top", F.coalesce(F.sum(height).over(w), F.lit(0)))


def bounds(boxes: DataFrame, by: str) -> DataFrame:
    return boxes.groupBy(by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def simplified(points: DataFrame, path: str = "path", ord: str = "ord") -> DataFrame:
    """Paths without points that lie on the straight line between their neighbours."""
    w = Window.partitionBy(path).orderBy(ord)
    before, after = F.lag(F.struct("x", "y")).over(w), F.lead(F.struct("x", "y")).over(w)
    p = points.withColumn("_b", before).withColumn("_a", after)
    cross = (F.col("x") - F.col("_b.x")) * (F.col("_a.y") - F.col("y")) - (F.col("y") - F.col("_b.y")) * (F.col("_a.x") - F.col("x"))
    return p.where(F.col("_b").isNull() | F.col("_a").isNull() | (cross != 0)).drop("_a", "_b")


def path_lengths(points: DataFrame, path: str = "path", ord: str = "ord") -> DataFrame:
    w = Window.partitionBy(path).orderBy(ord)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return points.withColumn("_s", F.coalesce(step, F.lit(0.0))).groupBy(path).agg(F.sum("_s").alias("length"))


def routes(requests: DataFrame, obstacles: DataFrame, turn: float = 30.0) -> DataFrame:
    """Shortest orthogonal ways around the obstacles of a layout, one layout per group: length plus a price per turn,
    on the lines of obstacle edges and end points. Rows (layout, request, ord, x, y). A request without a way is an error."""
    ship(requests.sparkSession)
    both = requests.select("layout", F.lit(0).alias("what"), F.col("request"), "x0", "y0", "x1", "y1").unionByName(obstacles.select("layout", F.lit(1).alias("what"), F.lit(None).cast("long").alias("request"), "x0", "y0", "x1", "y1"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        walls = pdf[pdf["what"] == 1][["x0", "y0", "x1", "y1"]].to_numpy(float).tolist()
        rows: list[tuple] = []
        for r in pdf[pdf["what"] == 0].itertuples(index=False):
            xs = sorted({r.x0, r.x1, *(w[0] - 1 for w in walls), *(w[2] + 1 for w in walls)})
            ys = sorted({r.y0, r.y1, *(w[1] - 1 for w in walls), *(w[3] + 1 for w in walls)})
            at, goal = (xs.index(r.x0), ys.index(r.y0)), (xs.index(r.x1), ys.index(r.y1))

            def free(a, b, xs=xs, ys=ys):
                x0, x1 = sorted((xs[a[0]], xs[b[0]]))
                y0, y1 = sorted((ys[a[1]], ys[b[1]]))
                return not any(x0 < w[2] and x1 > w[0] and y0 < w[3] and y1 > w[1] for w in walls)

            best, heap, back = {(at, 0): 0.0}, [(0.0, at, 0)], {}
            while heap:
                cost, p, way = heapq.heappop(heap)
                if p == goal:
                    line = [p]
                    while (p, way) in back:
                        p, way = back[p, way]
                        line.append(p)
                    rows += [(r.layout, int(r.request), k, xs[a], ys[b]) for k, (a, b) in enumerate(reversed(line))]
                    break
                if cost > best[p, way]:
                    continue
                for dx, dy, to in ((1, 0, 1), (-1, 0, 1), (0, 1, 2), (0, -1, 2)):
                    q = (p[0] + dx, p[1] + dy)
                    if not (0 <= q[0] < len(xs) and 0 <= q[1] < len(ys)) or not free(p, q):
                        continue
                    c = cost + abs(xs[q[0]] - xs[p[0]]) + abs(ys[q[1]] - ys[p[1]]) + (turn if way and way != to else 0)
                    if c < best.get((q, to), float("inf")):
                        best[q, to], back[q, to] = c, (p, way)
                        heapq.heappush(heap, (c, q, to))
            else:
                raise ValueError(f"no way for request {r.request}")
        cols = ["layout", "request", "ord", "x", "y"]
        return pd.DataFrame({c: pd.Series([x[k] for x in rows], dtype=object) for k, c in enumerate(cols)})

    return both.groupBy("layout").applyInPandas(solve, "layout string, request long, ord int, x double, y double")


def placed(items: DataFrame, width: int = 256, height: int = 256) -> DataFrame:
    """Greedy grid placement, one region per group: in order of (rank, group, index, id) each item takes the first free
    cell, column by column from the column of its rank on; an item that fits nowhere is an error."""
    ship(items.sparkSession)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[tuple[int, int]] = set()
        out, edge, last_rank, floor = [], 0, None, 0
        for r in pdf.sort_values(["rank", "group", "index", "id"], kind="stable").itertuples(index=False):
            if last_rank is not None and r.rank != last_rank:
                floor = edge
            last_rank = r.rank
            spot = next(((x, y) for x in range(floor, width - r.w + 1) for y in range(0, height - r.h + 1) if not any((x + i, y + j) in taken for i in range(r.w) for j in range(r.h))), None)
            if spot is None:
                raise ValueError(f"no place for {r.id}")
            taken.update((spot[0] + i, spot[1] + j) for i in range(r.w) for j in range(r.h))
            edge = max(edge, spot[0] + r.w)
            out.append((r.region, r.id, *spot))
        cols = ["region", "id", "x", "y"]
        return pd.DataFrame({c: pd.Series([o[k] for o in out], dtype=object) for k, c in enumerate(cols)})

    return items.groupBy("region").applyInPandas(place, "region string, id string, x int, y int")


def iter_groups(n: int, groups: int) -> Iterator[range]:
    """Index ranges of ``chunks`` for one list."""
    size = -(-n // max(1, groups)) if n else 1
    for lo in range(0, n, size):
        yield range(lo, min(n, lo + size))
