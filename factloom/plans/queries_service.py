"""Snapshot merge and tour ingestion over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import snapshots as S
from factloom.operators import tours as T
from factloom.plans.adapters import read
from factloom.plans.registry import query

_SNAP = "SELECT n_name AS crate, module AS module_id, name AS full_path, ord, kind, price {cmp} AS hit FROM {{{table}}} JOIN {{customer}} ON module = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey WHERE n_nationkey <> {gone}"
_BASE, _HEAD = _SNAP.format(cmp="> 300000", table="snap_base", gone=3), _SNAP.format(cmp="< 50000", table="snap_head", gone=5)


def _levels(spark: SparkSession, d: str, sql: str, table: str) -> dict[str, DataFrame]:
    types = spark.sql(sql, **{t: read(spark, d, t) for t in (table, "customer", "nation")})
    return {"packages": types.select("crate").distinct(), "modules": types.select("crate", "module_id").distinct(), "types": types}


@query(
    "jn14_snapshot_levels",
    f"WITH b AS (SELECT *, row_number() OVER (PARTITION BY crate, module_id, full_path ORDER BY ord) AS pos FROM ({_BASE}) x), h AS (SELECT *, row_number() OVER (PARTITION BY crate, module_id, full_path ORDER BY ord) AS pos FROM ({_HEAD}) x), "
    "side AS (SELECT coalesce(b.crate, h.crate) AS crate, coalesce(b.module_id, h.module_id) AS module_id, CASE WHEN b.crate IS NULL THEN 'head' WHEN h.crate IS NULL THEN 'base' ELSE 'both' END AS side FROM (SELECT DISTINCT crate, module_id FROM b) b FULL JOIN (SELECT DISTINCT crate, module_id FROM h) h ON b.crate = h.crate AND b.module_id = h.module_id), "
    "t AS (SELECT coalesce(h.crate, b.crate) AS crate, coalesce(h.module_id, b.module_id) AS module_id, coalesce(h.full_path, b.full_path) AS full_path, coalesce(h.pos, b.pos) AS pos, b.ord AS base_ord, h.ord AS head_ord, "
    "CASE WHEN b.ord IS NOT NULL AND h.ord IS NOT NULL THEN CASE WHEN b.hit OR h.hit THEN 'modified' ELSE 'both' END WHEN h.ord IS NOT NULL THEN CASE WHEN h.hit THEN 'head' ELSE 'both' END ELSE CASE WHEN b.hit THEN 'base' ELSE 'both' END END AS side "
    "FROM b FULL JOIN h ON b.crate = h.crate AND b.module_id = h.module_id AND b.full_path = h.full_path AND b.pos = h.pos) "
    "SELECT 'types' AS level, t.crate, t.module_id, full_path, pos, CASE WHEN s.side <> 'both' THEN s.side ELSE t.side END AS side, base_ord, head_ord FROM t JOIN side s ON s.crate = t.crate AND s.module_id = t.module_id "
    "UNION ALL SELECT 'modules', crate, module_id, NULL, 1, side, NULL, NULL FROM side "
    "UNION ALL SELECT 'packages', crate, NULL, NULL, 1, CASE WHEN count(*) FILTER (in_base) = 0 THEN 'head' WHEN count(*) FILTER (NOT in_base) = 0 THEN 'base' ELSE 'both' END, NULL, NULL FROM (SELECT DISTINCT crate, true AS in_base FROM b UNION ALL SELECT DISTINCT crate, false FROM h) x GROUP BY crate",
)
def jn14(spark: SparkSession, d: str) -> DataFrame:
    """Nations are crates, customers modules, order priorities types; one nation was removed and one added."""
    m = S.merge_snapshots(_levels(spark, d, _BASE, "snap_base"), _levels(spark, d, _HEAD, "snap_head"))
    cols = {"packages": ["crate"], "modules": ["crate", "module_id"], "types": ["crate", "module_id", "full_path"]}
    out = None
    for level, keys in cols.items():
        rows = m[level].select(F.lit(level).alias("level"), *(F.col(c).alias(c) if c in keys else F.lit(None).cast("long" if c == "module_id" else "string").alias(c) for c in ("crate", "module_id", "full_path")), F.col("pos").cast("long").alias("pos"), "side", *(F.col(f"{s}.ord").alias(f"{s}_ord") if level == "types" else F.lit(None).cast("long").alias(f"{s}_ord") for s in ("base", "head")))
        out = rows if out is None else out.union(rows)
    return out


_NESTED = "SELECT crate, m AS path, CASE WHEN NOT in_h THEN 'base' WHEN NOT in_b THEN 'head' ELSE 'both' END AS side, types FROM (SELECT coalesce(b.crate, h.crate) AS crate, coalesce(b.m, h.m) AS m, b.m IS NOT NULL AS in_b, h.m IS NOT NULL AS in_h, coalesce(h.types, b.types) AS types FROM (SELECT crate, CAST(module_id AS VARCHAR) AS m, count(*) AS types FROM (%s) x GROUP BY 1, 2) b FULL JOIN (SELECT crate, CAST(module_id AS VARCHAR) AS m, count(*) AS types FROM (%s) x GROUP BY 1, 2) h ON b.crate = h.crate AND b.m = h.m) y"


@query("jn14_nested_merge", _NESTED % (_BASE, _HEAD))
def jn14_nested(spark: SparkSession, d: str) -> DataFrame:
    """The same snapshots as documents: a crate's modules are a map, merged in place."""
    def documents(sql: str, table: str) -> DataFrame:
        g = _levels(spark, d, sql, table)["types"].groupBy("crate", F.col("module_id").cast("string").alias("m")).agg(F.count("*").alias("types"))
        return g.groupBy("crate").agg(F.map_from_entries(F.collect_list(F.struct("m", F.struct("types", F.lit("").alias("side"))))).alias("modules"))

    merged = S.merge_nested(documents(_BASE, "snap_base"), documents(_HEAD, "snap_head"))
    return merged.select("crate", F.explode("modules").alias("path", "x")).select("crate", "path", "x.side", "x.types")


@query("jn19_profile_merge", "WITH b AS (SELECT module, count(*) AS n FROM {snap_base} GROUP BY 1), h AS (SELECT module, count(*) AS n FROM {snap_head} GROUP BY 1) SELECT coalesce(h.module, b.module) AS module, coalesce(h.n, b.n) AS n FROM b FULL JOIN h ON b.module = h.module")
def jn19(spark: SparkSession, d: str) -> DataFrame:
    profile = lambda t: read(spark, d, t).groupBy("module").agg(F.count("*").alias("n"))
    return S.merge_profiles(profile("snap_base"), profile("snap_head"), "module")


@query("jn24_first_file", "SELECT l_partkey AS element_id, min('c' || o_custkey) AS file FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1")
def jn24(spark: SparkSession, d: str) -> DataFrame:
    held = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return T.first_files(held.select(F.col("l_partkey").alias("element_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file")))


_STEPS = "SELECT CAST(o_orderkey AS VARCHAR) AS tour, o_orderkey % 50 = 0 AS old, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS step, o_custkey AS c, l_suppkey AS s, l_quantity = 50 AS mixed, l_partkey % 4 AS shape, CAST(round(l_discount * 100) AS BIGINT) AS pct FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"
_TOUR_ERRORS = (
    f"WITH x AS ({_STEPS}), k AS (SELECT c_custkey FROM {{customer}} WHERE c_acctbal >= 0), e AS (SELECT DISTINCT c, s FROM x WHERE pct >= 5), "
    "j AS (SELECT x.*, kc.c_custkey IS NOT NULL AS c_known, ks.c_custkey IS NOT NULL AS s_known, e.c IS NOT NULL AS hit, r.c IS NOT NULL AS back FROM x LEFT JOIN k kc ON kc.c_custkey = x.c LEFT JOIN k ks ON ks.c_custkey = x.s LEFT JOIN e ON e.c = x.c AND e.s = x.s LEFT JOIN e r ON r.c = x.s AND r.s = x.c WHERE NOT old), "
    "b AS (SELECT tour, step, CASE WHEN mixed THEN [0] WHEN shape = 0 AND NOT c_known THEN [1] WHEN shape IN (1, 2) AND NOT c_known THEN [1] WHEN shape IN (1, 2) AND NOT s_known THEN [2] WHEN shape IN (1, 2) AND (c = s OR NOT hit) THEN [0] END AS ref, "
    "CASE WHEN mixed THEN 'step sets both ref and arrow; pick one' WHEN shape = 0 AND NOT c_known THEN 'file not in index: c' || c WHEN shape IN (1, 2) AND NOT c_known THEN 'arrow.from: file not in index: c' || c WHEN shape IN (1, 2) AND NOT s_known THEN 'arrow.to: file not in index: c' || s "
    "WHEN shape IN (1, 2) AND c = s THEN 'both ends of the arrow are the same element' WHEN shape IN (1, 2) AND NOT hit THEN 'no edge from m' || c || ' to m' || s || CASE WHEN back THEN '; the reverse exists' ELSE '' END END AS msg FROM j) "
    "SELECT tour, CAST(step AS INTEGER) AS step, CAST(ref[1] AS INTEGER) AS ref, msg FROM b WHERE msg IS NOT NULL UNION ALL SELECT DISTINCT tour, 0, 0, 'schema_version 2 not supported; expected 1' FROM x WHERE old"
)


@query("tr3_tour_errors", _TOUR_ERRORS)
def tr3(spark: SparkSession, d: str) -> DataFrame:
    """Every order is a tour of its lines. Planted errors: old versions, both shapes at once, files outside the index,
    arrows to themselves, without an edge or against it."""
    x = spark.sql(_STEPS.replace("VARCHAR", "STRING"), lineitem=read(spark, d, "lineitem"), orders=read(spark, d, "orders"))
    at = lambda c: F.struct(F.concat(F.lit("c"), F.col(c).cast("string")).alias("file"), F.lit(None).cast("long").alias("line"))
    arrow = F.when(F.col("mixed") | F.col("shape").isin(1, 2), F.struct(at("c").alias("from"), at("s").alias("to")))
    step = F.struct("step", F.struct(F.lit("say").alias("say"), F.when(F.col("mixed") | (F.col("shape") == 0), at("c")).alias("ref"), arrow.alias("arrow")).alias("s"))
    tours = x.groupBy("tour").agg(F.when(F.bool_or("old"), 2).otherwise(T.SCHEMA_VERSION).alias("schema_version"), F.transform(F.array_sort(F.collect_list(step)), lambda s: s["s"]).alias("steps")).withColumn("subject", F.lit(None).cast(T.REF))
    modules = read(spark, d, "customer").where("c_acctbal >= 0").selectExpr("'c' || c_custkey AS file", "'m' || c_custkey AS module_id")
    spans = spark.createDataFrame([], "file string, element_id string, start_line long, end_line long")
    directed = x.where("pct >= 5").selectExpr("'m' || c AS from_id", "'m' || s AS to_id")
    return T.check(tours, spans, modules, directed).errors
