"""Indexes over fact tables: spans by file, ids that exist, file trees, outlines, gating."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import paths as P


def span_entries(types: DataFrame, functions: DataFrame) -> DataFrame:
    """``file``, ``element_id``, ``kind``, ``start_line``, ``end_line``, ``side`` of all elements with a span. Functions of a
    module and methods of a type keep their kinds apart, since a field and a method may share an id."""
    side = lambda df: F.col("side") if "side" in df.columns else F.lit("both")
    t = types.where("start_line is not null").select("file", F.col("full_path").alias("element_id"), F.lit("type").alias("kind"), "start_line", "end_line", side(types).alias("side"))
    f = functions.where("start_line is not null").select("file", F.concat_ws("::", "owner", "name").alias("element_id"), F.when(F.col("owner_kind") == "type", "method").otherwise("function").alias("kind"), "start_line", "end_line", side(functions).alias("side"))
    return t.unionByName(f)


def by_side(entries: DataFrame) -> DataFrame:
    """Reverse index: modified and unchanged elements are found in both snapshots, others in their own."""
    where = F.when(F.col("side").isin("both", "modified"), F.array(F.lit("head"), F.lit("base"))).otherwise(F.array("side"))
    return entries.withColumn("snapshot", F.explode(where))


def module_of_file(modules: DataFrame) -> DataFrame:
    """The first module of each file."""
    return modules.groupBy("file").agg(F.min("module_id").alias("module_id"))


def known_ids(modules: DataFrame, types: DataFrame, functions: DataFrame) -> DataFrame:
    """All ids that can be selected or opened, with their kind."""
    m = modules.select(F.col("module_id").alias("id"), F.lit("module").alias("kind"))
    t = types.select(F.col("full_path").alias("id"), F.lit("type").alias("kind"))
    f = functions.select(F.concat_ws("::", "owner", "name").alias("id"), F.when(F.col("owner_kind") == "type", "method").otherwise("function").alias("kind"))
    return m.unionByName(t).unionByName(f).distinct()


def still_there(chosen: DataFrame, known: DataFrame) -> DataFrame:
    """Chosen (id, kind) rows that the new snapshot still has."""
    return chosen.join(known, ["id", "kind"], "left_semi")


def file_tree(files: DataFrame, path: str = "path") -> DataFrame:
    """Files and their folders below the longest common folder: ``id``, ``parent``, ``is_dir``, and ``place`` among
    siblings, folders first, then by name."""
    parts = F.split(F.col(path), "/")
    folder = F.slice(parts, F.lit(1), F.size(parts) - 1)
    ends = files.agg(F.min(folder).alias("lo"), F.max(folder).alias("hi"))
    keep = ends.select(P.common_prefix_length(F.col("lo"), F.col("hi")).alias("cut"))
    cut = keep.first().cut or 0  # one number
    rel = files.select(path).distinct().select(F.array_join(F.slice(F.split(F.col(path), "/"), F.lit(cut + 1), F.size(F.split(F.col(path), "/"))), "/").alias("rel"))
    nodes = rel.select(F.explode(P.ancestors("rel", False, "/")).alias("id")).distinct().withColumn("is_dir", F.lit(True)).unionByName(rel.select(F.col("rel").alias("id"), F.lit(False).alias("is_dir")))
    s = F.split("id", "/")
    nodes = nodes.select("id", F.when(F.size(s) > 1, F.array_join(F.slice(s, F.lit(1), F.size(s) - 1), "/")).otherwise("").alias("parent"), "is_dir", F.element_at(s, -1).alias("name"))
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("is_dir"), "name")).cast("long"))


def breadcrumbs(paths: DataFrame, path: str = "path", sep: str = "/") -> DataFrame:
    """Segments of a path with the path up to each."""
    return paths.select(path, F.posexplode(P.ancestors(path, True, sep)).alias("pos", "upto")).select(path, "pos", "upto", F.element_at(F.split("upto", sep), -1).alias("segment"))


def tree_order(nodes: DataFrame) -> DataFrame:
    """Children in display order: modules, function groups, then types by label, in the order people expect of
    letters (``a`` before ``B``)."""
    rank = F.when(F.col("kind") == "module", 0).when(F.col("kind") == "function_group", 1).otherwise(2)
    w = Window.partitionBy("parent").orderBy(rank, F.collate("label", "UNICODE"), "id")
    return nodes.withColumn("place", F.row_number().over(w).cast("long"))


def visible(nodes: DataFrame, expanded: DataFrame) -> DataFrame:
    """Nodes all of whose ancestors are expanded: none of their ancestor rows is left without a match."""
    a = nodes.select("id", F.explode(P.ancestors("id")).alias("up"))
    closed = a.join(expanded.select(F.col("id").alias("_e")), F.col("up") == F.col("_e"), "left_anti").select(F.col("id").alias("_c")).distinct()
    return nodes.join(closed, F.col("id") == F.col("_c"), "left_anti")


def gated_arrows(arrows: DataFrame, selected: DataFrame) -> DataFrame:
    """Arrows to draw: canonical ones always, drifted ones only where their row is selected."""
    s = selected.select(F.col("type_id").alias("_t"), F.col("row").alias("_r")).distinct().withColumn("on", F.lit(True))
    j = arrows.join(s, (F.col("from_id") == F.col("_t")) & (F.col("row") == F.col("_r")), "left")
    return j.where((F.col("drift") == "at_lca") | (F.col("drift") == "within_budget") | F.col("on")).select(arrows.columns)


def ghosts(exports: DataFrame, types: DataFrame) -> DataFrame:
    """Re-exports joined to the type they stand for; a re-export of a re-export stands for nothing."""
    t = types.select(F.col("full_path").alias("_t"), "kind")
    return exports.join(t, F.col("target") == F.col("_t")).select("module_id", "exposed_name", "target", "kind")


def outline(types: DataFrame, drift: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of the full outline: modules in order, their types with class, and what each owns with a direction tag."""
    d = drift.select(F.col("item").alias("_i"), "drift")
    t = types.select("module_id", "full_path", "kind").join(d, F.col("full_path") == F.col("_i"), "left")
    o = edges.where("kind = 'owns'").select(F.col("from_id").alias("_f"), "to_id").distinct()
    j = t.join(o, F.col("full_path") == F.col("_f"), "left")
    to = P.module_of("to_id")
    tag = F.when(F.col("to_id").isNull(), "").when(to == F.col("module_id"), "same").when(P.strictly_below(to, "module_id"), "down").when(P.strictly_below("module_id", to), "up").otherwise("across")
    w = Window.partitionBy("module_id").orderBy("full_path", F.col("to_id").asc_nulls_first())
    return j.select("module_id", "full_path", "kind", F.coalesce("drift", F.lit("no_owners")).alias("drift"), "to_id", tag.alias("direction"), F.row_number().over(w).cast("long").alias("place"))
