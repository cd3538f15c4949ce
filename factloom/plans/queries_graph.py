"""Graph, tree and call queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import paths as P
from factloom.operators import calls as C
from factloom.operators import graph as G
from factloom.operators import modules as M
from factloom.plans.adapters import read
from factloom.plans.registry import query

_CLOSURE = "WITH RECURSIVE g AS (SELECT src, dst FROM {%s}), r AS (SELECT src, dst FROM g UNION SELECT r.src, g.dst FROM r JOIN g ON r.dst = g.src)"


@query("gr1_strong_components", _CLOSURE % "modgraph" + ", n AS (SELECT src AS node FROM g UNION SELECT dst FROM g) SELECT n.node, least(n.node, coalesce(min(a.dst), n.node)) AS scc FROM n LEFT JOIN r a ON a.src = n.node AND EXISTS (SELECT 1 FROM r b WHERE b.src = a.dst AND b.dst = n.node) GROUP BY n.node")
def gr1(spark: SparkSession, d: str) -> DataFrame:
    return G.strong_components(read(spark, d, "modgraph"))


@query("gr3_closure_size", _CLOSURE % "dag" + ", n AS (SELECT src AS node FROM g UNION SELECT dst FROM g) SELECT n.node, count(r.dst) AS size FROM n LEFT JOIN r ON r.src = n.node AND r.dst <> n.node GROUP BY n.node")
def gr3(spark: SparkSession, d: str) -> DataFrame:
    return G.closure_size(read(spark, d, "dag"))


_DEPTH = "WITH RECURSIVE g AS (SELECT DISTINCT src, dst FROM {dag}), w AS (SELECT src AS node, 0 AS depth FROM g UNION SELECT g.dst, w.depth + 1 FROM w JOIN g ON w.node = g.src) SELECT node, max(depth) AS depth FROM w GROUP BY node"


@query("gr5_longest_depth", _DEPTH)
def gr5(spark: SparkSession, d: str) -> DataFrame:
    return G.longest_depth(read(spark, d, "dag"))


@query("wn6_placement_ranks", "WITH RECURSIVE g AS (SELECT DISTINCT src, dst FROM {dag}), w AS (SELECT src AS node, 0 AS depth FROM g UNION SELECT g.dst, w.depth + 1 FROM w JOIN g ON w.node = g.src), x AS (SELECT node AS id, max(depth) AS depth FROM w GROUP BY node), p AS (SELECT x.id, x.depth, p_name AS label FROM x JOIN part ON p_partkey = x.id) SELECT id, depth, row_number() OVER (ORDER BY depth, label, id) AS rank, row_number() OVER (PARTITION BY depth ORDER BY label, id) AS subrank FROM p")
def wn6(spark: SparkSession, d: str) -> DataFrame:
    depths = G.longest_depth(read(spark, d, "dag")).join(read(spark, d, "part").hint("merge"), F.col("node") == F.col("p_partkey")).select(F.col("node").alias("id"), "depth", F.col("p_name").alias("label"))
    return M.placement_ranks(depths)


@query("gr9_forward_split", "WITH RECURSIVE g AS (SELECT DISTINCT src, dst FROM {dag}), w AS (SELECT src AS node, 0 AS depth FROM g UNION SELECT g.dst, w.depth + 1 FROM w JOIN g ON w.node = g.src), x AS (SELECT node, max(depth) AS depth FROM w GROUP BY node) SELECT g.src, g.dst, b.depth > a.depth AS forward FROM g JOIN x a ON a.node = g.src JOIN x b ON b.node = g.dst")
def gr9(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "dag")
    return C.forward_split(e, G.longest_depth(e))


@query("gr2_ownership_forest")
def gr2(spark: SparkSession, d: str) -> DataFrame:
    brand = read(spark, d, "part").select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("workspace"))
    return G.ownership_forest(read(spark, d, "dag").join(brand, "src").select("workspace", "src", "dst"))


@query("gr4_back_edges")
def gr4(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "modgraph")
    return G.back_edges(e.select(F.lit("w").alias("workspace"), "src", "dst", F.concat_ws("|", "src", "dst").alias("ord")))


@query("gr11_module_tree", "WITH p AS (SELECT DISTINCT path, string_split(path, '/') AS s FROM {urls}), n AS (SELECT DISTINCT array_to_string(s[1:k], '/') AS id, k AS depth, CASE WHEN k > 1 THEN array_to_string(s[1:k - 1], '/') ELSE '' END AS parent FROM p, (SELECT unnest(range(1, 12)) AS k) ks WHERE k <= len(s)), c AS (SELECT parent, count(*) AS n FROM n WHERE depth > 1 GROUP BY parent) SELECT n.id, n.parent, n.depth, n.id IN (SELECT path FROM p) AS real, coalesce(c.n, 0) AS children FROM n LEFT JOIN c ON c.parent = n.id")
def gr11(spark: SparkSession, d: str) -> DataFrame:
    return M.module_tree(read(spark, d, "urls").select(F.col("path").alias("module_id")), "/")


@query("ag18_ancestor_rollup", "SELECT array_to_string(s[1:k], '/') AS prefix, CAST(sum(size) AS BIGINT) AS size, count(*) AS files FROM (SELECT size, string_split(path, '/') AS s FROM {urls}) p, (SELECT unnest(range(1, 12)) AS k) ks WHERE k <= len(s) AND NOT list_contains(s, 'tests') GROUP BY 1")
def ag18(spark: SparkSession, d: str) -> DataFrame:
    return M.rollup(read(spark, d, "urls"), "size", "path", "/")


_FUNCS = "(SELECT event_type AS id, CASE WHEN event_type < 'm' THEN 'a' ELSE 'b' END AS module_id FROM (SELECT DISTINCT event_type FROM events) t WHERE event_type <> 'click')"
_CALLS = "(SELECT * FROM {calls})"
_LOC = "SELECT c.caller, c.callee, c.ord, f.module_id AS caller_module, g.module_id AS callee_module, CASE WHEN g.module_id IS NULL THEN 'unresolved' WHEN g.module_id = f.module_id THEN 'same_module' ELSE 'other_module' END AS locality FROM {calls} c JOIN " + _FUNCS + " f ON f.id = c.caller LEFT JOIN " + _FUNCS + " g ON g.id = c.callee"


def _functions(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_type").distinct().where("event_type <> 'click'")
    return e.select(F.col("event_type").alias("id"), F.when(F.col("event_type") < "m", "a").otherwise("b").alias("module_id"))


@query("jn12_call_locality", _LOC)
def jn12(spark: SparkSession, d: str) -> DataFrame:
    return C.located(read(spark, d, "calls").drop("user_id"), _functions(spark, d))


@query("ag19_call_index", "WITH l AS (" + _LOC + "), o AS (SELECT caller AS id, count(*) AS outgoing, count(DISTINCT callee) AS targets, bool_or(locality = 'other_module') AS has_external, bool_or(locality = 'unresolved') AS has_unresolved FROM l GROUP BY 1), i AS (SELECT callee AS id, count(*) AS incoming, count(DISTINCT caller) AS callers, count(DISTINCT CASE WHEN locality = 'other_module' THEN caller END) AS outside_callers FROM l WHERE locality <> 'unresolved' GROUP BY 1) SELECT coalesce(o.id, i.id) AS id, coalesce(outgoing, 0) AS outgoing, coalesce(targets, 0) AS targets, coalesce(incoming, 0) AS incoming, coalesce(callers, 0) AS callers, coalesce(outside_callers, 0) AS outside_callers, coalesce(has_external, false) AS has_external, coalesce(has_unresolved, false) AS has_unresolved FROM o FULL JOIN i ON o.id = i.id")
def ag19(spark: SparkSession, d: str) -> DataFrame:
    return C.call_index(C.located(read(spark, d, "calls"), _functions(spark, d)))


@query("lk2_edge_list", "SELECT caller, callee, row_number() OVER (PARTITION BY caller ORDER BY m) AS place FROM (SELECT caller, callee, min(ord) AS m FROM {calls} GROUP BY 1, 2) x")
def lk2(spark: SparkSession, d: str) -> DataFrame:
    return C.edge_list(read(spark, d, "calls"), "caller", "callee")


@query("ed5_call_dedup", "SELECT caller, callee, user_id % 7 AS origin, min(ord) AS ord FROM {calls} GROUP BY 1, 2, 3")
def ed5(spark: SparkSession, d: str) -> DataFrame:
    return C.deduplicated(read(spark, d, "calls").withColumn("origin", F.col("user_id") % 7))


@query("ag23_endpoint_axis", "SELECT from_module, count(DISTINCT from_id) AS na, count(DISTINCT to_id) AS nb, CASE WHEN count(DISTINCT from_id) <= count(DISTINCT to_id) THEN 'from_id' ELSE 'to_id' END AS axis FROM {edges} GROUP BY 1")
def ag23(spark: SparkSession, d: str) -> DataFrame:
    return C.endpoint_axis(read(spark, d, "edges"), "from_module", "from_id", "to_id")


@query("st2_directed_edges", "SELECT DISTINCT from_id, to_id FROM (SELECT from_module AS from_id, to_module AS to_id FROM {edges} UNION ALL SELECT caller, callee FROM {calls}) x")
def st2(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators.edges import directed_edges

    return directed_edges(read(spark, d, "edges").select(F.col("from_module").alias("from_id"), F.col("to_module").alias("to_id")), read(spark, d, "calls"))


@query("ct7_focus_set", "WITH s AS (SELECT DISTINCT from_module AS m FROM {edges} WHERE from_module LIKE 'w::ASIA%' UNION SELECT DISTINCT to_module FROM {edges} WHERE from_module LIKE 'w::ASIA%'), x AS (SELECT string_split(m, '::') AS p FROM s) SELECT DISTINCT array_to_string(p[1:k], '::') AS id FROM x, (SELECT unnest(range(1, 8)) AS k) ks WHERE k <= len(p)")
def ct7(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "edges").where(F.col("from_module").startswith("w::ASIA"))
    picked = e.select(F.explode(F.array("from_module", "to_module")).alias("m")).distinct()
    return picked.select(F.explode(P.ancestors("m", True)).alias("id")).distinct()
