"""Look-ups, selections and labels over the indexed facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import paths as P

# Labels of classes, kinds and self kinds.
KIND_MARKS = {"struct": "S", "enum": "E", "union": "U", "trait": "T", "type_alias": "A", "class": "C", "interface": "I", "function_group": "F"}
SELF_FLAVORS = {"ref": "shared", "ref_mut": "mut", "by_value": "move", "none": "move"}
DRIFT_SEVERITY = {"drift_above": 3, "drift_sideways": 3, "drift_below": 2, "at_lca": 1, "within_budget": 1}
GROUP_MARK = "::__fn_"


def _mapped(value: Column | str, table: dict, otherwise: object = None) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    out = F.lit(otherwise)
    for k, x in table.items():
        out = F.when(v == k, F.lit(x)).otherwise(out)
    return out


def kind_mark(kind: Column | str) -> Column:
    return _mapped(kind, KIND_MARKS)


def self_flavor(kind: Column | str) -> Column:
    """How a method takes self; unknown ones move."""
    return _mapped(kind, SELF_FLAVORS, "move")


def drift_severity(drift: Column | str) -> Column:
    return _mapped(drift, DRIFT_SEVERITY)


def direction(source: str, target: str) -> Column:
    """Where an edge's target module lies from its source: here, above, below or aside."""
    s, t = F.col(source), F.col(target)
    return F.when(s == t, "here").when(P.strictly_below(s, t), "up").when(P.strictly_below(t, s), "down").otherwise("sideways")


def spans_of(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """``wanted`` (``id``, ``kind``) with the span and containing box of the element of that id and kind, null if there is none."""
    i = index.select(F.col("id").alias("_i"), F.col("kind").alias("_k"), "file", "start_line", "end_line", "box")
    return wanted.join(i, (F.col("id") == F.col("_i")) & (F.col("kind") == F.col("_k")), "left").drop("_i", "_k")


def qualified_paths(ids: DataFrame, types: DataFrame) -> DataFrame:
    """``full_path`` with ``shown``: crate, module and label of a known type; crate and module of a function group; else
    the path up to the group's mark. ``types`` has ``full_path``, ``module_path`` and ``label``."""
    t = types.select(F.col("full_path").alias("_p"), "module_path", "label")
    group = F.col("full_path").contains(GROUP_MARK)
    crate = P.segments("full_path")[0]
    module = F.when(F.col("module_path") == "", crate).otherwise(F.concat_ws("::", crate, "module_path"))
    known = F.when(group, module).otherwise(F.concat_ws("::", module, "label"))
    return ids.join(t, F.col("full_path") == F.col("_p"), "left").select(*ids.columns, F.when(F.col("_p").isNotNull(), known).otherwise(F.substring_index("full_path", GROUP_MARK, 1)).alias("shown"))


def most_recent(expanded: DataFrame, types: DataFrame, by: list[str]) -> DataFrame:
    """Per state the type expanded last: modules and other ids in the order of ``ord`` do not count."""
    known = expanded.join(types.select(F.col("full_path").alias("_p")), F.col("id") == F.col("_p"), "left_semi")
    return known.groupBy(*by).agg(F.max_by("id", "ord").alias("id"))


def row_matches(selected: DataFrame, rows: DataFrame) -> DataFrame:
    """Boxes and rows that a selection (``selection``, ``id``, ``kind``) lights up. A type lights up its box; a field the
    row of its owner and name; a method or function every callable row of its path. Buckets and arguments never do.
    ``rows``: ``type_path``, ``name``, ``kind``, ``function_path``."""
    r = rows.select("type_path", "name", F.col("kind").alias("row_kind"), "function_path")
    call = F.col("kind").isin("method", "function") & F.col("row_kind").isin("method", "function")
    key = r.withColumn("key", F.when(F.col("row_kind").isin("method", "function"), F.col("function_path")).when(F.col("row_kind") == "field", F.concat_ws("::", "type_path", "name"))).where("key is not null")
    hit = selected.join(key, F.col("id") == F.col("key")).where(call | ((F.col("kind") == "field") & (F.col("row_kind") == "field"))).select("selection", "type_path", "name", "row_kind")
    box = selected.where("kind = 'type'").join(rows.select("type_path").distinct(), F.col("id") == F.col("type_path"), "left_semi")
    return hit.union(box.select("selection", F.col("id").alias("type_path"), F.lit(None).cast("string").alias("name"), F.lit("type").alias("row_kind")))


def direct_arrows(arrows: DataFrame, picked: DataFrame) -> DataFrame:
    """Arrows that start at one of the picked rows, by type, row name and kind of row, each once."""
    p = picked.select(F.col("type_path").alias("_t"), F.col("name").alias("_n"), F.col("kind").alias("_k")).distinct()
    return arrows.join(p, (F.col("from_type") == F.col("_t")) & (F.col("row_name") == F.col("_n")) & (F.col("row_kind") == F.col("_k")), "left_semi")


def focused(modules: DataFrame, picked: DataFrame) -> DataFrame:
    """The modules that stay in focus: those picked and all that contain them."""
    ids = picked.select(F.explode(P.ancestors("module_id", True)).alias("_f")).distinct()
    return modules.join(ids, F.col("module_id") == F.col("_f"), "left_semi")


def changed_modules(numstat: DataFrame, modules: DataFrame, root: str) -> DataFrame:
    """Changed lines per module outside tests, and summed for every module around it: files of ``numstat`` are relative
    to ``root``, those of modules are not."""
    head = root.rstrip("/") + "/"
    m = modules.where(F.col("file").startswith(head)).select(F.substring("file", F.lit(len(head) + 1), F.length("file")).alias("path"), "module_id")
    hit = numstat.join(m, "path").where(~P.is_tests_path("module_id"))
    return hit.select(F.explode(P.ancestors("module_id", True)).alias("module_id"), "added", "deleted").groupBy("module_id").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count("*").alias("files"))


def fields_pointing_at(edges: DataFrame) -> DataFrame:
    """Owner and target with the owner's fields that point there, in order, each once."""
    f = edges.where(F.col("origin").startswith("field ")).select("from_id", "to_id", F.expr("substring(origin, 7)").alias("field"), "ord")
    first = f.groupBy("from_id", "to_id", "field").agg(F.min("ord").alias("ord"))
    return first.groupBy("from_id", "to_id").agg(F.array_sort(F.collect_list(F.struct("ord", "field"))).alias("x")).select("from_id", "to_id", F.transform("x", lambda s: s["field"]).alias("fields"))


def field_rows(edges: DataFrame) -> DataFrame:
    """``type_path``, ``row_name``, ``row_kind``: fields of each type that point at something."""
    f = edges.where(F.col("origin").startswith("field ")).select(F.col("from_id").alias("type_path"), F.expr("substring(origin, 7)").alias("row_name"))
    return f.distinct().withColumn("row_kind", F.lit("field"))


def callable_rows(calls: DataFrame) -> DataFrame:
    """The same of callables that call something. ``calls``: ``type_path``, ``row_name``, ``row_kind``, ``callee``."""
    return calls.where("callee is not null").select("type_path", "row_name", "row_kind").distinct()


def first_few(rows: DataFrame, by: str, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group and how many more it has. Ranks are cut before rows of a group meet."""
    total = rows.groupBy(F.col(by).alias("_g")).agg(F.count("*").alias("_n"))
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("place") <= limit)
    return top.join(total, F.col(by) == F.col("_g")).select(*top.columns, F.greatest(F.col("_n") - limit, F.lit(0)).alias("more"))


def also_owned(owners: DataFrame, shown: int = 3) -> DataFrame:
    """Items with several owners: the first few by name and how many more. ``owners`` has ``item`` and ``owner``; no item's
    owners are gathered but those shown."""
    top = first_few(owners.select("item", "owner").distinct(), "item", "owner", shown)
    g = top.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("place", "owner"))).alias("x"), F.max("more").alias("more")).where(F.size("x") + F.col("more") > 1)
    rest = F.when(F.col("more") > 0, F.concat(F.lit(" +"), F.col("more").cast("string"), F.lit(" more"))).otherwise("")
    return g.select("item", F.concat(F.array_join(F.transform("x", lambda s: s["owner"]), ", "), rest).alias("owners"))
