"""Scalar functions, look-ups, cascades and geometry over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import paths as P
from factloom.operators import calls as C
from factloom.operators import drift as D
from factloom.operators import layout as L
from factloom.operators import snapshots as S
from factloom.plans.adapters import read
from factloom.plans.registry import query

_COMMON = "len(list_filter(range(1, 6), lambda i: a.p[1:i] = b.p[1:i] AND i <= least(len(a.p), len(b.p))))"


@query("sf6_common_ancestor", f"WITH x AS (SELECT ord, full_path, string_split(full_path, '::') AS p FROM {{types}}) SELECT a.ord, array_to_string(a.p[1:{_COMMON}], '::') AS ancestor, len(a.p) + len(b.p) - 2 * {_COMMON} AS distance FROM x a JOIN x b ON b.ord = a.ord + 1")
def sf6(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "types").select("ord", "full_path")
    j = t.join(t.select((F.col("ord") - 1).alias("ord"), F.col("full_path").alias("next")), "ord")
    return j.select("ord", P.common_ancestor("full_path", "next").alias("ancestor"), P.tree_distance("full_path", "next").cast("long").alias("distance"))


@query("sf8_ancestor_chains", "WITH x AS (SELECT full_path, string_split(full_path, '::') AS p FROM {types}) SELECT full_path, array_to_string(list_transform(range(1, len(p)), lambda k: array_to_string(p[1:k], '::')), '|') AS chain, CAST(len(p) - 1 AS INT) AS n FROM x")
def sf8(spark: SparkSession, d: str) -> DataFrame:
    a = P.ancestors("full_path")
    return read(spark, d, "types").select("full_path", F.array_join(a, "|").alias("chain"), F.size(a).alias("n"))


@query("sf19_type_text", "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'mut' WHEN 2 THEN 'shared' WHEN 3 THEN 'move' WHEN 4 THEN 'raw' WHEN 5 THEN 'raw' WHEN 6 THEN 'shared' ELSE 'move' END AS flavor, CASE l_linenumber WHEN 1 THEN '&''a mut T' WHEN 2 THEN CASE WHEN l_orderkey % 2 = 0 THEN '&T' ELSE '&''amut T' END WHEN 3 THEN 'Vec<T>' WHEN 4 THEN '*const T' WHEN 5 THEN '* const T' WHEN 6 THEN '&mut(T)' ELSE '*constant' END AS ty FROM {lineitem}")
def sf19(spark: SparkSession, d: str) -> DataFrame:
    ty = F.lit("*constant")
    for k, text in enumerate(("&'a mut T", "&T", "Vec<T>", "*const T", "* const T", "&mut(T)"), 1):
        ty = F.when(F.col("l_linenumber") == k, text).otherwise(ty)
    ty = F.when((F.col("l_linenumber") == 2) & (F.col("l_orderkey") % 2 != 0), "&'amut T").otherwise(ty)  # a lifetime whose name ends in mut
    return read(spark, d, "lineitem").withColumn("ty", ty).select("l_orderkey", "l_linenumber", P.borrow_flavor("ty").alias("flavor"), "ty")


@query("sf21_ids_and_signatures", "SELECT p_partkey, p_brand || '::' || p_name || CASE WHEN p_size % 2 = 0 THEN '@' || p_type ELSE '' END AS method_id, p_name || '(a: ' || p_type || ')' || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' -> ' || p_brand END AS signature, CASE WHEN length(p_type) <= 8 THEN p_type ELSE left(p_type, 7) || '…' END AS short FROM {part}")
def sf21(spark: SparkSession, d: str) -> DataFrame:
    params = F.array(F.struct(F.lit("a").alias("name"), F.col("p_type").alias("ty_text")))
    return read(spark, d, "part").select("p_partkey", P.method_id("p_brand", "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_type"))).alias("method_id"), P.signature("p_name", params, F.when(F.col("p_size") % 3 != 0, F.col("p_brand"))).alias("signature"), P.truncate("p_type", 8).alias("short"))


@query("sf23_origin_fields", "SELECT from_id, to_id, ord, substr(origin, 7) AS field FROM {edges} WHERE starts_with(origin, 'field ')")
def sf23(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "edges").withColumn("field", P.field_of_origin("origin")).where("field is not null")
    return e.select("from_id", "to_id", "ord", "field")


@query("gr8_ownership_index", "SELECT from_id, origin, count(DISTINCT to_id) AS targets, min(ord) AS first FROM {edges} WHERE kind = 'owns' AND via IN ('struct_field', 'union_field') AND from_id <> to_id GROUP BY 1, 2")
def gr8(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators.edges import structural

    e = read(spark, d, "edges").where(structural()).where("from_id <> to_id")
    return e.groupBy("from_id", "origin").agg(F.count_distinct("to_id").alias("targets"), F.min("ord").alias("first"))


@query("gr10_one_hop", "WITH s AS (SELECT 'p' || p_partkey AS id FROM {part} WHERE p_size = 25), c AS (SELECT 'p' || src AS caller, 'p' || dst AS callee FROM {dag}), e AS (SELECT DISTINCT 'p' || l_partkey AS from_id, 's' || l_suppkey AS to_id FROM {lineitem}), d AS (SELECT 'p' || p_partkey AS id, p_size AS depth FROM {part} UNION ALL SELECT 's' || s_suppkey, s_suppkey % 60 FROM {supplier}) SELECT caller AS id FROM c WHERE callee IN (SELECT id FROM s) UNION SELECT callee FROM c WHERE caller IN (SELECT id FROM s) UNION SELECT to_id FROM e JOIN d a ON a.id = from_id JOIN d b ON b.id = to_id WHERE from_id IN (SELECT id FROM s) AND b.depth > a.depth")
def gr10(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one size are selected; parts call parts of the same order, and own suppliers."""
    part = read(spark, d, "part")
    calls = read(spark, d, "dag").selectExpr("'p' || src AS caller", "'p' || dst AS callee")
    owned = read(spark, d, "lineitem").selectExpr("'p' || l_partkey AS from_id", "'s' || l_suppkey AS to_id").distinct()
    depths = part.selectExpr("'p' || p_partkey AS id", "CAST(p_size AS LONG) AS depth").union(read(spark, d, "supplier").selectExpr("'s' || s_suppkey", "s_suppkey % 60"))
    return C.one_hop(part.where("p_size = 25").selectExpr("'p' || p_partkey AS id"), calls, owned, depths)


@query("lk3_target_modules", "SELECT DISTINCT from_id, to_module FROM {edges} WHERE kind = 'owns'")
def lk3(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "edges").where("kind = 'owns'").select("from_id", "to_module").distinct()


@query("ag16_side_cascade", "WITH p AS (SELECT c_custkey AS module, CASE c_custkey % 4 WHEN 0 THEN 'base' WHEN 1 THEN 'head' WHEN 2 THEN 'both' ELSE 'modified' END AS side FROM customer) SELECT o_orderkey, CASE WHEN p.side IN ('base', 'head') THEN p.side WHEN o_orderkey % 2 = 0 THEN 'both' ELSE 'modified' END AS side FROM orders LEFT JOIN p ON p.module = o_custkey")
def ag16(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("c_custkey") % 4
    parents = read(spark, d, "customer").select(F.col("c_custkey").alias("module"), F.when(m == 0, "base").when(m == 1, "head").when(m == 2, "both").otherwise("modified").alias("side"))
    kids = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("module"), F.when(F.col("o_orderkey") % 2 == 0, "both").otherwise("modified").alias("side"))
    return S.cascade(kids, parents, "module").select("o_orderkey", "side")


@query("ag21_strongest_drift", "SELECT o_custkey AS field, CASE max(o_orderkey % 5) WHEN 0 THEN 'at_lca' WHEN 1 THEN 'within_budget' WHEN 2 THEN 'drift_below' WHEN 3 THEN 'drift_above' ELSE 'drift_sideways' END AS drift FROM orders GROUP BY 1")
def ag21(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("at_lca", "within_budget", "drift_below", "drift_above", "drift_sideways")))
    t = read(spark, d, "orders").select(F.col("o_custkey").alias("field"), F.element_at(names, (F.col("o_orderkey") % 5).cast("int") + 1).alias("drift"))
    return D.strongest(t, "field")


_BOXES = "(SELECT c_mktsegment AS region, c_custkey AS id, CAST(floor(abs(c_acctbal)) AS BIGINT) % 997 AS x0, (c_custkey * 37) % 991 AS y0, CAST(floor(abs(c_acctbal)) AS BIGINT) % 997 + 12 AS x1, (c_custkey * 37) % 991 + 9 AS y1 FROM customer)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.floor(F.abs("c_acctbal")) % 997, (F.col("c_custkey") * 37) % 991
    return read(spark, d, "customer").select(F.col("c_mktsegment").alias("region"), F.col("c_custkey").alias("id"), x.alias("x0"), y.alias("y0"), (x + 12).alias("x1"), (y + 9).alias("y1"))


@query("jn31_box_conflicts", f"SELECT DISTINCT a.region, least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM {_BOXES} a JOIN {_BOXES} b ON a.region = b.region AND a.id <> b.id AND a.x0 - 2 < b.x1 AND b.x0 < a.x1 + 2 AND a.y0 - 2 < b.y1 AND b.y0 < a.y1 + 2")
def jn31(spark: SparkSession, d: str) -> DataFrame:
    return L.conflicts(_boxes(spark, d), 2, 128)


@query("ly4_grid_snap", f"SELECT id, CAST(floor(x0 / 16.0) AS BIGINT) AS c0, CAST(floor(y0 / 16.0) AS BIGINT) AS r0, CAST(ceil(x1 / 16.0) AS BIGINT) AS c1, CAST(ceil(y1 / 16.0) AS BIGINT) AS r1 FROM {_BOXES} b")
def ly4(spark: SparkSession, d: str) -> DataFrame:
    return L.snapped(_boxes(spark, d), 16).select("id", "c0", "r0", "c1", "r1")


@query("ag26_bounds", f"SELECT region, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM {_BOXES} b GROUP BY region")
def ag26(spark: SparkSession, d: str) -> DataFrame:
    return L.bounds(_boxes(spark, d), "region")


@query("ly5_long_rows", "WITH r AS (SELECT o_custkey AS box, o_orderkey AS ord, CAST(o_orderkey % 700 AS DOUBLE) AS width, o_custkey % 400 AS header FROM orders), m AS (SELECT box, median(width) AS mid FROM r WHERE width < 360 GROUP BY box) SELECT r.box, r.ord, r.width, width >= 360 AND width >= 1.8 * greatest(coalesce(mid, header), 1) AS long FROM r LEFT JOIN m ON m.box = r.box")
def ly5(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "orders").select(F.col("o_custkey").alias("box"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 700).cast("double").alias("width"), (F.col("o_custkey") % 400).alias("header"))
    return L.long_rows(r).drop("header")


@query("ly6_fragments", "WITH r AS (SELECT o_custkey AS box, o_orderkey AS ord, o_orderstatus = 'F' AS long FROM orders), n AS (SELECT *, CASE WHEN long IS DISTINCT FROM lag(long) OVER (PARTITION BY box ORDER BY ord) THEN 1 ELSE 0 END AS new FROM r) SELECT box, ord, long, CAST(sum(new) OVER (PARTITION BY box ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fragment FROM n")
def ly6(spark: SparkSession, d: str) -> DataFrame:
    return L.fragments(read(spark, d, "orders").select(F.col("o_custkey").alias("box"), F.col("o_orderkey").alias("ord"), (F.col("o_orderstatus") == "F").alias("long")))


@query("wn9_chunks", "SELECT o_custkey, o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / ceil(count(*) OVER (PARTITION BY o_custkey) / 3.0)) AS INT) AS chunk FROM orders")
def wn9(spark: SparkSession, d: str) -> DataFrame:
    return L.chunks(read(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 3, "o_orderkey")


@query("ly19_row_tops", "SELECT o_custkey AS box, o_orderkey AS ord, CAST(coalesce(sum(o_orderkey % 23) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS top FROM orders")
def ly19(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "orders").select(F.col("o_custkey").alias("box"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 23).alias("height"))
    return L.row_tops(r).select("box", "ord", "top")


@query("lk7_nearest", "SELECT c_mktsegment AS region, arg_min(c_custkey, CAST(abs(c_custkey - 70) AS BIGINT) * 1000000 + c_custkey) AS id FROM customer GROUP BY 1")
def lk7(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("region")).agg(F.min_by("c_custkey", F.struct(F.abs(F.col("c_custkey") - 70), "c_custkey")).alias("id"))


@query("jn33_first_kind", "SELECT name, arg_min(kind, full_path) AS kind FROM (SELECT name, kind, full_path FROM {types}) x GROUP BY name")
def jn33(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "types").groupBy("name").agg(F.min_by("kind", "full_path").alias("kind"))


@query("st4_base_only", "SELECT DISTINCT module, name FROM {snap_base} b WHERE NOT EXISTS (SELECT 1 FROM {snap_head} h WHERE h.module = b.module AND h.name = b.name)")
def st4(spark: SparkSession, d: str) -> DataFrame:
    keys = ["module", "name"]
    return read(spark, d, "snap_base").select(keys).distinct().join(read(spark, d, "snap_head").select(keys), keys, "left_anti")


@query("ag24_totals", "SELECT count(*) AS type_count, count(DISTINCT crate) AS crate_count FROM {types}")
def ag24(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "types").agg(F.count("*").alias("type_count"), F.count_distinct("crate").alias("crate_count"))
