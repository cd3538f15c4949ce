"""Call tables: locality, index, neighbourhoods, look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def located(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls whose caller is known, with ``locality``: same_module, other_module or unresolved."""
    f = functions.select("id", "module_id").distinct()
    c = calls.join(f.toDF("_c", "caller_module"), F.col("caller") == F.col("_c")).join(f.toDF("_t", "callee_module"), F.col("callee") == F.col("_t"), "left")
    where = F.when(F.col("callee_module").isNull(), "unresolved").when(F.col("callee_module") == F.col("caller_module"), "same_module").otherwise("other_module")
    return c.select(*calls.columns, "caller_module", "callee_module", where.alias("locality"))


def call_index(located_calls: DataFrame) -> DataFrame:
    """Per function: outgoing and incoming calls, distinct targets and callers, and flags."""
    n = located_calls.groupBy("caller", "callee", "locality").agg(F.count("*").alias("n"))
    known = F.col("locality") != "unresolved"
    out = n.groupBy(F.col("caller").alias("id")).agg(F.sum("n").alias("outgoing"), F.count_distinct("callee").alias("targets"), F.bool_or(F.col("locality") == "other_module").alias("has_external"), F.bool_or(~known).alias("has_unresolved"))
    into = n.where(known).groupBy(F.col("callee").alias("id")).agg(F.sum("n").alias("incoming"), F.count_distinct("caller").alias("callers"), F.count_distinct(F.when(F.col("locality") == "other_module", F.col("caller"))).alias("outside_callers"))
    j = out.join(into, "id", "full_outer")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("outgoing", "targets", "incoming", "callers", "outside_callers")]
    return j.select("id", *zero, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("has_external", "has_unresolved")))


def edge_list(calls: DataFrame, anchor: str, other: str) -> DataFrame:
    """Distinct others of each anchor, in order of first sight; unresolved ones too."""
    first = calls.groupBy(anchor, other).agg(F.min("ord").alias("ord"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(anchor).orderBy("ord")).cast("long")).select(anchor, other, "place")


def deduplicated(calls: DataFrame, keys: tuple[str, ...] = ("caller", "callee", "kind", "resolution", "origin")) -> DataFrame:
    """The first call of each key."""
    keys = tuple(k for k in keys if k in calls.columns)
    return calls.groupBy(*keys).agg(F.min("ord").alias("ord"))


def one_hop(selected: DataFrame, calls: DataFrame, edges: DataFrame, depths: DataFrame) -> DataFrame:
    """Callers, callees and owned targets further down of the selected ids."""
    s = selected.select(F.col("id").alias("_s"))
    callers = calls.join(s, F.col("callee") == F.col("_s"), "left_semi").select(F.col("caller").alias("id"))
    callees = calls.join(s, F.col("caller") == F.col("_s"), "left_semi").select(F.col("callee").alias("id"))
    d = depths.select("id", "depth")
    owned = edges.join(s, F.col("from_id") == F.col("_s"), "left_semi").join(d.toDF("_a", "da"), F.col("from_id") == F.col("_a")).join(d.toDF("_b", "db"), F.col("to_id") == F.col("_b")).where("db > da").select(F.col("to_id").alias("id"))
    return callers.union(callees).union(owned).distinct()


def forward_split(edges: DataFrame, depths: DataFrame) -> DataFrame:
    """Edges marked forward where the target lies deeper."""
    d = depths.select(F.col("node"), "depth")
    return edges.join(d.toDF("_a", "da").hint("merge"), F.col("src") == F.col("_a")).join(d.toDF("_b", "db").hint("merge"), F.col("dst") == F.col("_b")).select("src", "dst", (F.col("db") > F.col("da")).alias("forward"))


def endpoint_axis(arrows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Per group the axis with fewer distinct ends; the first on a tie."""
    g = arrows.groupBy(by).agg(F.count_distinct(a).alias("na"), F.count_distinct(b).alias("nb"))
    return g.select(by, "na", "nb", F.when(F.col("na") <= F.col("nb"), a).otherwise(b).alias("axis"))
