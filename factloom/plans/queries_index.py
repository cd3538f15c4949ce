"""Edge construction and index queries over the driver tables, each through its library operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import edges as E
from factloom.operators import index as I
from factloom.operators import modules as M
from factloom.operators import resolve as R
from factloom.plans.adapters import read
from factloom.plans.registry import query

_REF = "array<struct<name: string, cardinality: string>>"


def _resolve(spark: SparkSession, d: str):
    known = R.registry(read(spark, d, "types"))
    return lambda refs: R.resolve_types(refs, known)


_OWNED = "CASE {o} WHEN 'owned' THEN 'owns' WHEN 'borrow_immut' THEN 'borrows_immut' WHEN 'borrow_mut' THEN 'borrows_mut' WHEN 'indirection' THEN 'indirection' END"
_FIELDS = "SELECT place || '::' || s_name AS type_path, 'f' || CAST(l_linenumber AS VARCHAR(10)) AS name, l_orderkey AS ord, CASE l_linenumber % 6 WHEN 0 THEN 'owned' WHEN 1 THEN 'borrow_immut' WHEN 2 THEN 'borrow_mut' WHEN 3 THEN 'indirection' WHEN 4 THEN 'primitive' ELSE 'other' END AS ownership, c_name AS ref, CASE WHEN l_quantity < 25 THEN 'one' ELSE 'many' END AS cardinality FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {places} ON s_nationkey = n_nationkey"
_N = "SELECT name, min(full_path) AS full_path FROM {types} GROUP BY 1"


@query("ed1_field_edges", f"SELECT type_path AS from_id, n.full_path AS to_id, kind, 'struct_field' AS via, cardinality, 'field ' || f.name AS origin FROM (SELECT *, {_OWNED.format(o='ownership')} AS kind FROM ({_FIELDS}) g) f JOIN ({_N}) n ON n.name = f.ref WHERE kind IS NOT NULL")
def ed1(spark: SparkSession, d: str) -> DataFrame:
    """Every line item is a field of its supplier that refers to the customer."""
    f = spark.sql(_FIELDS.replace("VARCHAR(10)", "STRING"), **{t: read(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier", "places")})
    f = f.withColumn("refs", F.array(F.struct(F.col("ref").alias("name"), "cardinality")).cast(_REF))
    # equal rows of an order stay apart
    f = f.withColumn("ord", F.monotonically_increasing_id())
    return E.field_edges(read(spark, d, "types"), f, _resolve(spark, d))


_FNS = "SELECT f.owner_kind, f.owner, f.name, CASE WHEN f.self_kind = 'none' THEN 'primitive' WHEN f.self_kind = 'by_value' THEN 'owned' WHEN f.self_kind = 'ref' THEN 'borrow_immut' ELSE 'borrow_mut' END AS ownership, s_name AS param, CASE WHEN f.is_unsafe THEN c_name END AS ret FROM {fns} f JOIN {orders} ON f.name = 'm' || CAST(o_orderkey AS VARCHAR(10)) JOIN {customer} ON c_custkey = o_custkey + 1 JOIN {supplier} ON s_suppkey = o_orderkey % 10"


@query("ed2_function_edges", f"WITH f AS ({_FNS}), n AS ({_N}) SELECT owner AS from_id, n.full_path AS to_id, {_OWNED.format(o='ownership')} AS kind, 'fn_param' AS via, 'one' AS cardinality, 'fn ' || f.name || ' param p' AS origin FROM f JOIN n ON n.name = f.param WHERE ownership <> 'primitive' AND n.full_path <> owner UNION ALL SELECT owner, n.full_path, 'owns', 'fn_return', 'optional', 'fn ' || f.name || ' -> ret' FROM f JOIN n ON n.name = f.ret WHERE n.full_path <> owner")
def ed2(spark: SparkSession, d: str) -> DataFrame:
    """Every order is a method of its customer, with a supplier as parameter and the next customer as result."""
    f = spark.sql(_FNS.replace("VARCHAR(10)", "STRING"), **{t: read(spark, d, t) for t in ("fns", "orders", "customer", "supplier")})
    one = lambda c, n: F.array(F.struct(F.col(c).alias("name"), F.lit(n).alias("cardinality")))
    params = F.array(F.struct(F.lit("p").alias("name"), "ownership", one("param", "one").alias("refs")))
    f = f.withColumn("params", params).withColumn("return_refs", F.when(F.col("ret").isNotNull(), one("ret", "optional")).otherwise(F.array().cast(_REF))).withColumn("return_ownership", F.lit("owned"))
    return E.function_edges(f, _resolve(spark, d))


@query("ed3_trait_edges", f"SELECT t.full_path AS from_id, n.full_path AS to_id, 'trait_impl' AS kind, 'trait_impl_block' AS via, 'one' AS cardinality, 'impl ' || n.name AS origin FROM {{types}} t JOIN {{types}} u ON u.ord = t.ord OR u.ord = t.ord + 1 JOIN ({_N}) n ON n.name = u.name")
def ed3(spark: SparkSession, d: str) -> DataFrame:
    """A type implements itself and the next one; the former stays as a self loop."""
    t = read(spark, d, "types").select("full_path", "name", "ord")
    after = t.select((F.col("ord") - 1).alias("ord"), F.col("name").alias("next"))
    t = t.join(after, "ord", "left").withColumn("trait_impls", F.array_compact(F.array("name", "next")))
    return E.trait_edges(t, _resolve(spark, d))


_FILED = "SELECT module_id, CASE WHEN module_id LIKE '%::HOUSEHOLD' THEN 'src/' || split_part(module_id, '::', 2) || '/' || split_part(module_id, '::', 3) || '.rs' ELSE 'src/' || replace(module_id, '::', '/') || '.rs' END AS file FROM {mods}"


@query("gr12_file_roles", f"WITH m AS (SELECT module_id, CASE WHEN len(string_split(module_id, '::')) = 3 THEN 'src/' || split_part(module_id, '::', 2) || '/' || split_part(module_id, '::', 3) || '.rs' ELSE file END AS file, array_to_string(string_split(module_id, '::')[1:len(string_split(module_id, '::')) - 1], '::') AS up FROM ({_FILED}) f) SELECT m.module_id, m.file, CASE WHEN p.file = m.file THEN 'inline' WHEN m.module_id IN (SELECT up FROM m) THEN 'dir' ELSE 'leaf-file' END AS role FROM m LEFT JOIN m p ON p.module_id = m.up")
def gr12(spark: SparkSession, d: str) -> DataFrame:
    """Modules of nations have files of their own; one segment of each is inline."""
    m = spark.sql(_FILED, mods=read(spark, d, "mods"))
    three = F.size(F.split("module_id", "::")) == 3
    file = F.when(three, F.concat(F.lit("src/"), F.split_part("module_id", F.lit("::"), F.lit(2)), F.lit("/"), F.split_part("module_id", F.lit("::"), F.lit(3)), F.lit(".rs"))).otherwise(F.col("file"))
    return M.file_roles(m.withColumn("file", file))


@query("gr13_breadcrumbs", "SELECT path, CAST(k - 1 AS INTEGER) AS pos, array_to_string(s[1:k], '/') AS upto, s[k] AS segment FROM (SELECT DISTINCT path, string_split(path, '/') AS s FROM {urls}) p, (SELECT unnest(range(1, 20)) AS k) ks WHERE k <= len(s)")
def gr13(spark: SparkSession, d: str) -> DataFrame:
    return I.breadcrumbs(read(spark, d, "urls").select("path").distinct())


@query("gr14_spans_by_side", "SELECT element_id, file, snapshot, kind FROM (SELECT CAST(element_id AS VARCHAR) AS element_id, file, 'type' AS kind, unnest(CASE element_id % 4 WHEN 0 THEN ['head', 'base'] WHEN 1 THEN ['head', 'base'] WHEN 2 THEN ['head'] ELSE ['base'] END) AS snapshot FROM {spans} WHERE start_line % 5 <> 0 UNION ALL SELECT 'o::' || element_id, file, CASE WHEN element_id % 2 = 0 THEN 'method' ELSE 'function' END, unnest(['head', 'base']) FROM {spans}) x")
def gr14(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "spans")
    side = F.element_at(F.array(*map(F.lit, ("both", "modified", "head", "base"))), (F.col("element_id") % 4 + 1).cast("int"))
    types = s.select("file", F.col("element_id").cast("string").alias("full_path"), F.when(F.col("start_line") % 5 != 0, F.col("start_line")).alias("start_line"), "end_line", side.alias("side"))
    fns = s.select("file", F.lit("o").alias("owner"), F.col("element_id").cast("string").alias("name"), F.when(F.col("element_id") % 2 == 0, "type").otherwise("module").alias("owner_kind"), "start_line", "end_line")
    return I.by_side(I.span_entries(types, fns)).select("element_id", "file", "snapshot", "kind")


@query("gr16_visible_modules", "SELECT module_id AS id FROM {mods} WHERE module_id = 'w' OR (split_part(module_id, '::', 3) = '') OR (split_part(module_id, '::', 2) IN ('ASIA', 'EUROPE') AND (split_part(module_id, '::', 4) = '' OR split_part(module_id, '::', 3) LIKE '%A%'))")
def gr16(spark: SparkSession, d: str) -> DataFrame:
    """Two regions are expanded and, everywhere, nations with an A in their names."""
    ids = read(spark, d, "mods").select(F.col("module_id").alias("id"))
    s = F.split("id", "::")
    opened = ids.where((F.col("id").isin("w::ASIA", "w::EUROPE")) | ((F.size(s) == 3) & s[2].contains("A"))).union(spark.createDataFrame([("w",)], "id string"))
    return I.visible(ids, opened)


@query("jn28_gated_arrows", "SELECT from_id, origin AS row, to_id, ord FROM {edges} WHERE kind = 'owns' OR (via = 'struct_field' AND EXISTS (SELECT 1 FROM {members} m WHERE m.type_path = from_id AND 'field ' || m.name = origin AND m.ownership = 'borrow_mut'))")
def jn28(spark: SparkSession, d: str) -> DataFrame:
    arrows = read(spark, d, "edges").select("from_id", F.when(F.col("via") == "struct_field", F.col("origin")).otherwise("none").alias("row"), "to_id", "ord", F.when(F.col("kind") == "owns", "at_lca").otherwise("drift_above").alias("drift"), "origin")
    rows = read(spark, d, "members").where("ownership = 'borrow_mut'").select(F.col("type_path").alias("type_id"), F.concat(F.lit("field "), "name").alias("row"))
    return I.gated_arrows(arrows, rows).select("from_id", F.col("origin").alias("row"), "to_id", "ord")


@query("jn29_still_there", "SELECT full_path AS id, 'type' AS kind FROM {types} WHERE visibility <> 'priv' AND ord % 2 = 0 UNION ALL SELECT module_id, 'module' FROM {mods} WHERE crate <> 'ASIA'")
def jn29(spark: SparkSession, d: str) -> DataFrame:
    """What was chosen before private types and one region went."""
    t, m = read(spark, d, "types"), read(spark, d, "mods")
    chosen = t.where("ord % 2 = 0").select(F.col("full_path").alias("id"), F.lit("type").alias("kind")).union(m.select("module_id", F.lit("module")))
    return I.still_there(chosen, I.known_ids(m.where("crate <> 'ASIA'"), t.where("visibility <> 'priv'"), read(spark, d, "fns")))


@query("jn30_ghosts", "SELECT 'm' || p_partkey AS module_id, p_name AS exposed_name, full_path AS target, kind FROM {part} JOIN {types} ON name = 'Customer#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')")
def jn30(spark: SparkSession, d: str) -> DataFrame:
    """Parts export the customer of their number; numbers without one are exports of exports."""
    names = read(spark, d, "types").select("name", "full_path")
    p = read(spark, d, "part").withColumn("_n", F.concat(F.lit("Customer#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")))
    exports = p.join(names, F.col("_n") == F.col("name"), "left").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("module_id"), F.col("p_name").alias("exposed_name"), F.coalesce("full_path", F.concat(F.lit("again::"), "_n")).alias("target"))
    return I.ghosts(exports, read(spark, d, "types"))
