"""Placement drift: where an item lives against the lowest common module of its owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import paths as P
from factloom.session import freeze


def ordered_paths(paths: DataFrame, module: str = "owner_module") -> DataFrame:
    """``path`` and ``place``: distinct paths and a number that rises in the order of their segments; the empty path has none."""
    parts = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(P.segments("path"))
    known = paths.select(F.col(module).alias("path")).where("path is not null").distinct()
    return freeze(known.sort(parts).withColumn("place", F.monotonically_increasing_id()), "ordered_paths")


def _ends(owners: DataFrame, paths: DataFrame | None, item: str, module: str, *more: Column) -> DataFrame:
    """Least and greatest path of each item's owners, as segments ``lo`` and ``hi``. Numbers stand for the paths, so that what
    is aggregated has a fixed width; ``paths`` are those numbers where ``owners`` has them as ``place``."""
    if paths is None:
        paths = ordered_paths(owners, module)
        owners = owners.join(paths.withColumnRenamed("path", "_path"), F.col(module) == F.col("_path"), "left")
    ends = owners.groupBy(item).agg(F.min("place").alias("_lo"), F.max("place").alias("_hi"), *more)
    parts = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(P.segments("path"))
    for c in ("lo", "hi"):
        ends = ends.join(paths.select(F.col("place").alias(f"_{c}"), parts.alias(c)), f"_{c}", "left")
    return ends


def _common() -> Column:
    return P.joined(F.slice("lo", F.lit(1), P.common_prefix_length(F.col("lo"), F.col("hi"))))


def owners_lca(owners: DataFrame, item: str = "item", module: str = "owner_module", paths: DataFrame | None = None) -> DataFrame:
    """Lowest common module of each item's owners: the common prefix of the least and the greatest path, taken as
    arrays. Minimum and maximum are pre-aggregated, so an item with very many owners stays small."""
    return _ends(owners, paths, item, module, F.count_distinct("owner").alias("n_owners")).select(item, _common().alias("lca"), "n_owners")


def _classified(items: DataFrame, lca: DataFrame, item: str) -> DataFrame:
    j = items.join(lca, item, "left")
    levels = P.depth("home") - P.depth("lca")
    return j.withColumn("levels", levels).withColumn("below", P.strictly_below("home", "lca")).withColumn("above", P.strictly_below("lca", "home"))


def drift_cli(items: DataFrame, owners: DataFrame, max_below: int = 1, item: str = "item", paths: DataFrame | None = None) -> DataFrame:
    """``item``, ``home``, ``lca``, ``n_owners``, ``drift`` and ``severity``; unowned items have no owners' class.
    The empty path is nobody's ancestor here."""
    j = _classified(items, owners_lca(owners, item, paths=paths), item)
    j = j.withColumn("below", F.col("below") & (F.col("lca") != "")).withColumn("above", F.col("above") & (F.col("home") != ""))
    cls = F.when(F.col("lca").isNull(), "no_owners").when(F.col("home") == F.col("lca"), "at_lca").when(F.col("below"), F.when(F.col("levels") <= max_below, "below_within_budget").otherwise("below")).when(F.col("above"), "above").otherwise("sideways")
    far = P.tree_distance("home", "lca")
    severity = F.when(F.col("lca").isNull() | (F.col("home") == F.col("lca")), 0).when(F.col("below") | F.col("above"), F.abs("levels")).otherwise(far)
    return j.select(item, "home", F.coalesce("lca", F.lit("")).alias("lca"), F.coalesce("n_owners", F.lit(0)).cast("long").alias("n_owners"), cls.alias("drift"), severity.cast("long").alias("severity"))


def bare(path: str) -> Column:
    """A path without its crate."""
    s = P.segments(path)
    return F.when(F.size(s) > 1, P.joined(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))))).otherwise("")


def drift_view(items: DataFrame, owners: DataFrame, budget: int = 1, item: str = "item", paths: DataFrame | None = None) -> DataFrame:
    """The viewer's policy: paths without the crate, the empty path above all, unowned items at their place. Where
    ``paths`` are given, they are without the crate already."""
    o = owners if paths is not None else owners.withColumn("owner_module", bare("owner_module"))
    i = items.withColumn("home", bare("home"))
    lca = _ends(o, paths, item, "owner_module").select(item, _common().alias("lca"))
    j = _classified(i, lca, item)
    cls = F.when(F.col("lca").isNull() | (F.col("home") == F.col("lca")), "at_lca").when(F.col("below"), F.when(F.col("levels") <= budget, "within_budget").otherwise("drift_below")).when(F.col("above"), "drift_above").otherwise("drift_sideways")
    return j.select(item, "home", F.coalesce("lca", F.lit("")).alias("lca"), cls.alias("drift"))


def summary(drift: DataFrame) -> DataFrame:
    return drift.groupBy("drift").agg(F.count("*").alias("n"))


def severity_histogram(drift: DataFrame) -> DataFrame:
    """Below against sideways by severity; severities seen by either."""
    d = drift.where(F.col("drift").isin("below", "sideways"))
    return d.groupBy("severity").agg(F.count_if(F.col("drift") == "below").alias("below"), F.count_if(F.col("drift") == "sideways").alias("sideways"))


#: Order of classes by weight, for the strongest drift of several targets.
_WEIGHT = {"at_lca": 0, "within_budget": 1, "drift_below": 2, "drift_above": 3, "drift_sideways": 4}


def strongest(targets: DataFrame, by: str) -> DataFrame:
    weight = F.lit(0)
    for k, v in _WEIGHT.items():
        weight = F.when(F.col("drift") == k, v).otherwise(weight)
    return targets.withColumn("_w", weight).groupBy(by).agg(F.max_by("drift", "_w").alias("drift"))
