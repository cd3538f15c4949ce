"""Module tables, module pairs, trees and ancestor roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import paths as P

TYPE_KINDS = ("struct", "enum", "union", "trait", "type_alias", "class", "interface")


def global_counters(types: DataFrame) -> DataFrame:
    """One row of conditional counts over the types in scope."""
    return types.agg(F.count("*").alias("types"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in TYPE_KINDS[:5]), F.sum("unsafe_blocks").cast("long").alias("unsafe_blocks"), F.count_if(F.col("unsafe_blocks") > 0).alias("types_with_unsafe"), F.count_if(F.col("n_lifetimes") > 0).alias("types_with_lifetimes"))


def module_table(modules: DataFrame, types: DataFrame) -> DataFrame:
    """Counts for every module, empty ones too."""
    t = types.groupBy("module_id").agg(F.count("*").alias("types"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in TYPE_KINDS[:5]), F.sum("unsafe_blocks").cast("long").alias("unsafe_blocks"), F.count_if(F.col("n_lifetimes") > 0).alias("lifetime_types"))
    j = modules.select("module_id").distinct().join(t, "module_id", "left")
    counts = [c for c in t.columns if c != "module_id"]
    return j.select("module_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), P.is_tests_path("module_id").alias("is_tests"))


def visibility_counts(types: DataFrame) -> DataFrame:
    return types.where(P.is_real_visibility("visibility")).groupBy(P.visibility_bucket("visibility").alias("bucket")).agg(F.count("*").alias("n"))


def implementors(impls: DataFrame) -> DataFrame:
    """Trait to the types that implement it, in order, repeats kept."""
    g = impls.groupBy("trait").agg(F.sort_array(F.collect_list(F.struct("ord", "type_path"))).alias("x"))
    return g.select("trait", F.transform("x", lambda s: s["type_path"]).alias("types"))


def module_pairs(edges: DataFrame) -> DataFrame:
    """Edges between two different modules outside tests: totals and counts by kind, largest first."""
    e = edges.where(F.col("from_module") != F.col("to_module")).where(~P.is_tests_path("from_module") & ~P.is_tests_path("to_module"))
    k = e.groupBy("from_module", "to_module", "kind").agg(F.count("*").alias("n"))
    return k.groupBy("from_module", "to_module").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind", "n"))).alias("x")).select("from_module", "to_module", "total", F.array_join(F.transform("x", lambda s: F.concat(s["kind"], F.lit("="), s["n"].cast("string"))), ",").alias("by_kind"))


def module_sizes(types: DataFrame, edges: DataFrame) -> DataFrame:
    """Types of each module and edges that stay inside it."""
    inner = edges.where(F.col("from_module") == F.col("to_module")).groupBy(F.col("from_module").alias("module_id")).agg(F.count("*").alias("inner_edges"))
    return types.groupBy("module_id").agg(F.count("*").alias("types")).join(inner, "module_id", "left").select("module_id", "types", F.coalesce("inner_edges", F.lit(0)).alias("inner_edges"))


def ranked_neighbours(pairs: DataFrame, side: str = "from_module", other: str = "to_module") -> DataFrame:
    """Imports (or dependents) of each module by count, then name."""
    w = Window.partitionBy(side).orderBy(F.desc("total"), other)
    return pairs.select(side, other, "total", F.row_number().over(w).cast("long").alias("place"))


def module_tree(modules: DataFrame, sep: str = "::") -> DataFrame:
    """All real modules and the ones their paths imply: ``id``, ``parent``, ``depth``, ``real``, ``children``."""
    nodes = modules.select(F.explode(P.ancestors("module_id", True, sep)).alias("id")).distinct()
    real = modules.select(F.col("module_id").alias("id")).distinct().withColumn("is_real", F.lit(True))
    s = F.split("id", sep, -1)
    n = nodes.join(real, "id", "left").select("id", F.when(F.size(s) > 1, F.array_join(F.slice(s, F.lit(1), F.size(s) - 1), sep)).alias("parent"), F.size(s).cast("long").alias("depth"), F.coalesce("is_real", F.lit(False)).alias("real"))
    kids = n.where("parent is not null").groupBy(F.col("parent").alias("_p")).agg(F.count("*").alias("kids"))
    return n.join(kids, F.col("id") == F.col("_p"), "left").select("id", F.coalesce("parent", F.lit("")).alias("parent"), "depth", "real", F.coalesce("kids", F.lit(0)).alias("children"))


def file_roles(modules: DataFrame) -> DataFrame:
    """Role of a module's file: ``crate-root``, ``inline`` (the parent's file), ``dir`` or ``leaf-file``."""
    m = modules.select("module_id", "file")
    parent = m.select(F.col("module_id").alias("_p"), F.col("file").alias("_pf"))
    up = m.withColumn("up", P.module_of("module_id")).join(parent, (F.col("up") == F.col("_p")) & (F.col("up") != F.col("module_id")), "left")
    has = m.select(P.module_of("module_id").alias("_h")).distinct().withColumn("has_children", F.lit(True))
    j = up.join(has, F.col("module_id") == F.col("_h"), "left")
    role = F.when(F.size(P.segments("module_id")) == 1, "crate-root").when(F.col("file") == F.col("_pf"), "inline").when(F.col("file").endswith("/mod.rs") | F.col("has_children"), "dir").otherwise("leaf-file")
    return j.select("module_id", "file", role.alias("role"))


def rollup(files: DataFrame, value: str, path: str = "path", sep: str = "::") -> DataFrame:
    """Sum of ``value`` over every ancestor prefix, the path itself included; tests paths are left out."""
    f = files.where(~F.array_contains(F.split(path, sep), "tests"))
    return f.select(F.explode(P.ancestors(path, True, sep)).alias("prefix"), value).groupBy("prefix").agg(F.sum(value).cast("long").alias(value), F.count("*").alias("files"))


def shortest_suffixes(types: DataFrame) -> DataFrame:
    """Display names: within a simple name all paths show the same number of last segments, the fewest that tell
    them apart (all segments if none does)."""
    t = types.select("full_path").distinct().withColumn("s", P.segments("full_path")).withColumn("name", F.element_at("s", -1))
    deep = t.groupBy("name").agg(F.max(F.size("s")).alias("most"), F.count("*").alias("n"))
    each = t.join(deep, "name").select("name", "most", "n", F.explode(F.sequence(F.lit(1), F.col("most"))).alias("k"), "s")
    each = each.select("name", "most", "n", "k", P.joined(F.slice("s", F.greatest(F.size("s") - F.col("k") + 1, F.lit(1)), F.col("k"))).alias("suffix"))
    ok = each.groupBy("name", "most", "n", "k").agg(F.count_distinct("suffix").alias("d")).groupBy("name", "most").agg(F.min(F.when(F.col("d") == F.col("n"), F.col("k"))).alias("k"))
    k = ok.select(F.col("name").alias("_n"), F.coalesce("k", "most").alias("k"))
    return t.join(k, F.col("name") == F.col("_n")).select("full_path", P.joined(F.slice("s", F.greatest(F.size("s") - F.col("k") + 1, F.lit(1)), F.col("k"))).alias("shown"))


def placement_ranks(depths: DataFrame) -> DataFrame:
    """Dense places by (depth, label) and the place within a depth."""
    by_depth = Window.partitionBy("depth").orderBy("label", "id")
    # ranks follow from counts per depth, which are few; no window over everything
    sizes = depths.groupBy("depth").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("depth").alias("_d"), (F.sum("n").over(Window.orderBy("depth")) - F.col("n")).alias("before"))
    return depths.join(before, F.col("depth") == F.col("_d")).withColumn("subrank", F.row_number().over(by_depth).cast("long")).select("id", "depth", (F.col("before") + F.col("subrank")).alias("rank"), "subrank")
