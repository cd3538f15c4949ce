"""Interval lookups: overlap, smallest containing, nearest after and before, as one ranked ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


_SPAN = ("file", "id", "start_line", "end_line")


def _marked(spans: DataFrame, found: DataFrame) -> DataFrame:
    """``spans`` with ``hit``: whether ``found`` holds the span, all of whose values count."""
    hit = found.select(*(F.col(c).alias(f"_{c}") for c in _SPAN)).distinct().withColumn("hit", F.lit(True))
    same = F.col("file").eqNullSafe(F.col("_file"))
    for c in _SPAN[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return spans.join(hit, same, "left").select(*spans.columns, F.coalesce("hit", F.lit(False)).alias("hit"))


def overlaps(spans: DataFrame, hunks: DataFrame) -> DataFrame:
    """``spans`` (``file``, ``id``, ``start_line``, ``end_line``) with ``hit``: some hunk (``file``, ``start``, ``end``)
    overlaps, ends included. The file is the join key; the test is a semi join."""
    h = hunks.select(F.col("file").alias("_f"), "start", "end")
    return _marked(spans, spans.join(h, (F.col("file") == F.col("_f")) & (F.col("start_line") <= F.col("end")) & (F.col("end_line") >= F.col("start")), "left_semi"))


def bucketed_overlaps(spans: DataFrame, hunks: DataFrame, width: int = 64) -> DataFrame:
    """The same for files that dominate: both sides are cut into line buckets that join the key; hunks that run to
    the end of a file are clamped to its last line first. Spans and hunks that end before they start are compared as they are."""
    last = spans.groupBy("file").agg(F.max(F.greatest("start_line", "end_line")).alias("last")).withColumnRenamed("file", "_lf")
    h = hunks.join(last, F.col("file") == F.col("_lf")).where("start <= last").select("file", "start", F.least("end", "last").alias("end"))
    cut = lambda df, a, b: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))
    s, g = cut(spans, "start_line", "end_line"), cut(h.where("end is not null"), "start", "end").select(F.col("file").alias("_f"), "start", "end", F.col("bucket").alias("_b"))
    return _marked(spans, s.join(g, (F.col("file") == F.col("_f")) & (F.col("bucket") == F.col("_b")) & (F.col("start_line") <= F.col("end")) & (F.col("end_line") >= F.col("start")), "left_semi"))


def resolve_lines(probes: DataFrame, spans: DataFrame, calls: DataFrame | None = None, modules: DataFrame | None = None) -> DataFrame:
    """``probes`` (``probe``, ``file``, ``line``) with ``element_id`` and ``how``.

    Tiers: the smallest call interval around the line whose callee is an indexed element; the smallest element
    around it; the next element; the previous one; the module of the file. Ties of one to three go to the earlier
    start, then the smaller span; of equal ends before the line the last in index order wins. A line without any
    gets a null element, and a probe without a line the module. One window ranks all tiers."""
    s = spans.select(F.col("file").alias("_f"), F.col("element_id").cast("string").alias("element_id"), "start_line", "end_line")
    c = probes.where("line is not null").join(s, F.col("file") == F.col("_f"))
    line, size = F.col("line"), F.col("end_line") - F.col("start_line")
    tier = F.when((F.col("start_line") <= line) & (line <= F.col("end_line")), 1).when(F.col("start_line") >= line, 2).otherwise(3)
    c = c.select(*probes.columns, "element_id", tier.alias("tier"), F.when(tier == 1, size).when(tier == 2, F.col("start_line")).otherwise(-F.col("end_line")).alias("k1"), F.when(tier == 3, -F.col("start_line")).otherwise(F.col("start_line")).alias("k2"), F.when(tier == 3, -size).otherwise(size).alias("k3"))
    if calls is not None:
        k = calls.select(F.col("file").alias("_f"), F.col("callee").cast("string").alias("callee"), F.col("start_line").alias("cs"), F.col("end_line").alias("ce"))
        known = spans.select(F.col("element_id").cast("string").alias("_e")).distinct()
        near = probes.join(k, (F.col("file") == F.col("_f")) & (F.col("cs") <= F.col("line")) & (F.col("line") <= F.col("ce")))
        near = near.withColumn("rn", F.row_number().over(Window.partitionBy("probe").orderBy(F.col("ce") - F.col("cs"), "cs", "callee"))).where("rn = 1")
        near = near.join(known, F.col("callee") == F.col("_e"), "left_semi")
        c = c.unionByName(near.select(*probes.columns, F.col("callee").alias("element_id"), F.lit(0).alias("tier"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("k3")))
    if modules is not None:
        m = modules.select(F.col("file").alias("_f"), F.col("module_id").cast("string").alias("element_id"))
        c = c.unionByName(probes.join(m, F.col("file") == F.col("_f")).select(*probes.columns, "element_id", F.lit(4).alias("tier"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("k3")))
    # one minimum per probe, pre-aggregated: candidates of a long file never meet in one place
    best = c.groupBy("probe").agg(F.min(F.struct("tier", "k1", "k2", "k3", "element_id")).alias("b"))
    how = F.element_at(F.array(*map(F.lit, ("callsite", "containing", "next", "previous", "module"))), F.col("b.tier") + 1)
    return probes.join(best.withColumnRenamed("probe", "_p"), F.col("probe") == F.col("_p"), "left").select(*probes.columns, F.col("b.element_id").alias("element_id"), F.when(F.col("b").isNull(), "unknown").otherwise(how).alias("how"))


def tour_errors(steps: DataFrame, directed: DataFrame) -> DataFrame:
    """All errors of a tour's resolved steps (``step``, ``ref``, ``a``, ``b`` and, if given, ``file_a_known`` and
    ``file_b_known``): a step has a reference or an arrow or none; files are indexed; ends of an arrow differ and are joined
    by an edge. A tour is accepted if empty. Whole batches of tours are checked by ``tours.check``."""
    d = directed.select(F.col("from_id").alias("f"), F.col("to_id").alias("t"), F.lit(True).alias("hit"))
    r = directed.select(F.col("from_id").alias("f2"), F.col("to_id").alias("t2"), F.lit(True).alias("back"))
    j = steps.join(d, (F.col("a") == F.col("f")) & (F.col("b") == F.col("t")), "left").join(r, (F.col("a") == F.col("t2")) & (F.col("b") == F.col("f2")), "left")
    arrow = F.col("b").isNotNull()
    msg = F.when(F.col("ref").isNotNull() & F.col("a").isNotNull(), "a step has either a reference or an arrow")
    msg = msg.when(arrow & (F.col("a") == F.col("b")), "an arrow joins two different elements").when(arrow & F.col("hit").isNull() & F.col("back"), "no edge in this direction; the reverse exists").when(arrow & F.col("hit").isNull(), "no edge between the elements")
    lost = [F.when(~F.col(c), F.lit("a file is not in the index")) for c in ("file_a_known", "file_b_known") if c in steps.columns]
    return j.select("step", F.explode(F.array_compact(F.array(*lost, *([F.when(F.coalesce(*lost).isNull(), msg)] if lost else [msg])))).alias("msg"))
