"""Interval, snapshot, diff and canonicalisation queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import snapshots as S
from factloom.operators import spans as L
from factloom.plans.adapters import read
from factloom.plans.registry import query

_HUNKS = "(SELECT o_custkey AS file, {day_of:o_orderdate} AS start, {day_of:o_orderdate} + 3 AS stop FROM orders)"


def _hunks(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    return o.select(F.col("o_custkey").alias("file"), day.alias("start"), (day + 3).alias("end"))


@query("jn20_span_overlap", "SELECT s.file, s.element_id AS id, s.start_line, s.end_line, EXISTS (SELECT 1 FROM " + _HUNKS + " h WHERE h.file = s.file AND s.start_line <= h.stop AND s.end_line >= h.start) AS hit FROM {spans} s")
def jn20(spark: SparkSession, d: str) -> DataFrame:
    return L.overlaps(read(spark, d, "spans").withColumnRenamed("element_id", "id"), _hunks(spark, d))


@query("jn20_span_overlap_bucketed", "SELECT s.file, s.element_id AS id, s.start_line, s.end_line, EXISTS (SELECT 1 FROM " + _HUNKS + " h WHERE h.file = s.file AND s.start_line <= h.stop AND s.end_line >= h.start) AS hit FROM {spans} s")
def jn20b(spark: SparkSession, d: str) -> DataFrame:
    return L.bucketed_overlaps(read(spark, d, "spans").withColumnRenamed("element_id", "id"), _hunks(spark, d))


@query("tr2_line_ladder", "WITH c AS (SELECT p.probe, p.file, p.line, CAST(s.element_id AS VARCHAR) AS element_id, s.start_line, s.end_line, CASE WHEN s.start_line <= p.line AND p.line <= s.end_line THEN 1 WHEN s.start_line >= p.line THEN 2 ELSE 3 END AS tier FROM {probes} p JOIN {spans} s ON s.file = p.file), k AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY tier, CASE tier WHEN 1 THEN end_line - start_line WHEN 2 THEN start_line ELSE -end_line END, CASE tier WHEN 3 THEN -start_line ELSE start_line END, CASE tier WHEN 3 THEN start_line - end_line ELSE end_line - start_line END, element_id) AS rn FROM c) SELECT p.probe, p.file, p.line, k.element_id, CASE k.tier WHEN 1 THEN 'containing' WHEN 2 THEN 'next' WHEN 3 THEN 'previous' ELSE 'unknown' END AS how FROM {probes} p LEFT JOIN k ON k.probe = p.probe AND k.rn = 1")
def tr2(spark: SparkSession, d: str) -> DataFrame:
    return L.resolve_lines(read(spark, d, "probes"), read(spark, d, "spans"))


_MERGED = """
WITH b AS (SELECT *, row_number() OVER (PARTITION BY module, name ORDER BY ord) AS pos FROM {snap_base}),
h AS (SELECT *, row_number() OVER (PARTITION BY module, name ORDER BY ord) AS pos FROM {snap_head})
SELECT coalesce(h.module, b.module) AS module, coalesce(h.name, b.name) AS name, coalesce(h.pos, b.pos) AS pos, b.ord AS base_ord, h.ord AS head_ord,
       coalesce(h.day % 7 = 0, false) AS head_add, coalesce(b.day % 5 = 0, false) AS base_del, b.ord IS NOT NULL AS in_base, h.ord IS NOT NULL AS in_head
FROM b FULL JOIN h ON b.module = h.module AND b.name = h.name AND b.pos = h.pos"""
_SIDE = "CASE WHEN in_base AND in_head AND (head_add OR base_del) THEN 'modified' WHEN in_base AND in_head THEN 'both' WHEN in_head THEN CASE WHEN head_add THEN 'head' ELSE 'both' END ELSE CASE WHEN base_del THEN 'base' ELSE 'both' END END"


def _merged(spark: SparkSession, d: str) -> DataFrame:
    m = S.merge(read(spark, d, "snap_base"), read(spark, d, "snap_head"), ["module", "name"], positional_pairs=True)
    add, rem = F.coalesce(F.col("head.day") % 7 == 0, F.lit(False)), F.coalesce(F.col("base.day") % 5 == 0, F.lit(False))
    m = m.select("module", "name", F.col("pos").cast("long").alias("pos"), F.col("base.ord").alias("base_ord"), F.col("head.ord").alias("head_ord"), add.alias("head_add"), rem.alias("base_del"))
    return m.withColumn("in_base", F.col("base_ord").isNotNull()).withColumn("in_head", F.col("head_ord").isNotNull())


@query("jn15_snapshot_merge", f"SELECT module, name, pos, base_ord, head_ord, {_SIDE} AS side, CASE WHEN in_base AND in_head THEN CASE WHEN head_add AND base_del THEN 'mixed' WHEN head_add THEN 'add' WHEN base_del THEN 'del' END END AS change FROM ({_MERGED}) m")
def jn15(spark: SparkSession, d: str) -> DataFrame:
    m = _merged(spark, d)
    c = [F.col(x) for x in ("in_base", "in_head", "head_add", "base_del")]
    change = F.when(c[0] & c[1], S.change_kind(c[2], c[3]))
    return m.select("module", "name", "pos", "base_ord", "head_ord", S.side_of(*c).alias("side"), change.alias("change"))


@query("jn16_last_base_wins", "WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY module, name ORDER BY ord DESC) AS rn FROM {snap_base}) x WHERE rn = 1), h AS (SELECT *, row_number() OVER (PARTITION BY module, name ORDER BY ord) AS pos FROM {snap_head}) SELECT coalesce(h.module, b.module) AS module, coalesce(h.name, b.name) AS name, b.ord AS base_ord, h.ord AS head_ord FROM b FULL JOIN h ON b.module = h.module AND b.name = h.name AND h.pos = 1")
def jn16(spark: SparkSession, d: str) -> DataFrame:
    m = S.merge(read(spark, d, "snap_base"), read(spark, d, "snap_head"), ["module", "name"])
    return m.select("module", "name", F.col("base.ord").alias("base_ord"), F.col("head.ord").alias("head_ord"))


@query("jn18_edge_merge", "WITH b AS (SELECT DISTINCT module AS from_id, name AS to_id, kind FROM {snap_base}), h AS (SELECT DISTINCT module AS from_id, name AS to_id, kind FROM {snap_head}) SELECT coalesce(b.from_id, h.from_id) AS from_id, coalesce(b.to_id, h.to_id) AS to_id, coalesce(b.kind, h.kind) AS kind, CASE WHEN b.kind IS NOT NULL AND h.kind IS NOT NULL THEN 'both' WHEN h.kind IS NOT NULL THEN 'head' ELSE 'base' END AS side FROM b FULL JOIN h ON b.from_id = h.from_id AND b.to_id = h.to_id AND b.kind = h.kind")
def jn18(spark: SparkSession, d: str) -> DataFrame:
    as_edges = lambda n: read(spark, d, n).select(F.col("module").alias("from_id"), F.col("name").alias("to_id"), "kind", "ord")
    return S.merge_edges(as_edges("snap_base"), as_edges("snap_head"), ("from_id", "to_id", "kind"))


@query("jn17_reexport_merge", "SELECT module, name, ord FROM {snap_head} UNION ALL SELECT module, name, ord FROM {snap_base} b WHERE NOT EXISTS (SELECT 1 FROM {snap_head} h WHERE h.module = b.module AND h.name = b.name)")
def jn17(spark: SparkSession, d: str) -> DataFrame:
    cols = ["module", "name", "ord"]
    return S.merge_reexports(read(spark, d, "snap_base").select(cols), read(spark, d, "snap_head").select(cols), ("module", "name"))


@query("ag17_bar_state", f"WITH s AS (SELECT module, {_SIDE} AS side FROM ({_MERGED}) m) SELECT module, count(*) FILTER (side IN ('head', 'modified')) AS adds, count(*) FILTER (side IN ('base', 'modified')) AS dels, CASE WHEN count(*) FILTER (side IN ('head', 'modified')) > 0 AND count(*) FILTER (side IN ('base', 'modified')) > 0 THEN 'split' WHEN count(*) FILTER (side IN ('head', 'modified')) > 0 THEN 'add' WHEN count(*) FILTER (side IN ('base', 'modified')) > 0 THEN 'del' ELSE 'none' END AS state FROM s GROUP BY module")
def ag17(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("in_base", "in_head", "head_add", "base_del")]
    return S.bar_state(_merged(spark, d).withColumn("side", S.side_of(*c)), "module")


_LINES = "(SELECT doc_id, i AS ord, lines[i] AS line, CASE WHEN length(lines[i]) % 3 = 0 THEN 'add' WHEN length(lines[i]) % 3 = 1 THEN 'del' ELSE 'context' END AS kind FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) d, (SELECT unnest(range(1, 100000)) AS i) k WHERE i <= len(lines))"


@query("ag13_hunk_ranges", "WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ord, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT *, CASE WHEN length(line) % 3 = 0 THEN 'add' WHEN length(line) % 3 = 1 THEN 'del' ELSE 'context' END AS kind FROM l), h AS (SELECT *, sum(CASE WHEN kind = 'context' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS hunk, sum(CASE WHEN kind <> 'add' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS old, sum(CASE WHEN kind <> 'del' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS new FROM k) SELECT doc_id AS file, CAST(hunk AS BIGINT) AS hunk, CAST(min(CASE WHEN kind = 'add' THEN new END) AS BIGINT) AS add_start, CAST(max(CASE WHEN kind = 'add' THEN new END) AS BIGINT) AS add_end, CAST(min(CASE WHEN kind = 'del' THEN old END) AS BIGINT) AS del_start, CAST(max(CASE WHEN kind = 'del' THEN old END) AS BIGINT) AS del_end FROM h WHERE kind <> 'context' GROUP BY 1, 2")
def ag13(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    lines = read(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"))
    n = F.length("line") % 3
    lines = lines.withColumn("kind", F.when(n == 0, "add").when(n == 1, "del").otherwise("context"))
    w = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(w)
    lines = lines.withColumn("hunk", run(F.col("kind") == "context")).withColumn("old", run(F.col("kind") != "add")).withColumn("new", run(F.col("kind") != "del"))
    return S.hunk_ranges(lines.where("kind <> 'context'"))


_CANON = "(SELECT text AS full_path, doc_id AS ord, CASE lang WHEN 'en' THEN 'struct' WHEN 'de' THEN 'enum' WHEN 'fr' THEN 'type_alias' ELSE 'trait' END AS kind, CASE doc_id % 5 WHEN 0 THEN 'modified' WHEN 1 THEN 'both' WHEN 2 THEN 'head' ELSE 'base' END AS side, n_chars % 50 AS n_fields, n_chars % 7 AS n_methods, n_chars AS prev_start FROM documents)"


@query("wn2_canonical_types", "WITH t AS (SELECT *, n_fields + n_methods - CASE WHEN kind = 'type_alias' THEN 100 ELSE 0 END AS score, CASE side WHEN 'modified' THEN 0 WHEN 'both' THEN 1 WHEN 'head' THEN 2 ELSE 3 END AS r FROM " + _CANON + " x), b AS (SELECT *, row_number() OVER (PARTITION BY full_path ORDER BY score DESC, ord) AS rn FROM t), g AS (SELECT full_path, min(r) AS r, min(ord) AS first_ord, count(*) AS variants, min(CASE WHEN side = 'modified' THEN ord END) AS pm FROM t GROUP BY 1) SELECT g.full_path, b.kind, b.ord, CASE g.r WHEN 0 THEN 'modified' WHEN 1 THEN 'both' WHEN 2 THEN 'head' ELSE 'base' END AS side, p.prev_start, g.first_ord, g.variants FROM g JOIN b ON b.full_path = g.full_path AND b.rn = 1 LEFT JOIN t p ON p.ord = g.pm AND p.full_path = g.full_path")
def wn2(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "struct").when(F.col("lang") == "de", "enum").when(F.col("lang") == "fr", "type_alias").otherwise("trait")
    m = F.col("doc_id") % 5
    side = F.when(m == 0, "modified").when(m == 1, "both").when(m == 2, "head").otherwise("base")
    t = read(spark, d, "documents").select(F.col("text").alias("full_path"), F.col("doc_id").alias("ord"), kind.alias("kind"), side.alias("side"), (F.col("n_chars") % 50).alias("n_fields"), (F.col("n_chars") % 7).alias("n_methods"), F.col("n_chars").alias("prev_start"))
    return S.canonical_types(t)


@query("wn4_canonical_members", "WITH t AS (SELECT o_custkey AS type_id, o_orderstatus AS name, o_orderkey AS ord, CASE WHEN o_orderkey % 4 = 0 THEN 'modified' ELSE 'both' END AS side FROM orders) SELECT type_id, name, ord, side, first_ord FROM (SELECT *, row_number() OVER (PARTITION BY type_id, name ORDER BY CASE WHEN side = 'modified' THEN 0 ELSE 1 END, ord) AS rn, min(ord) OVER (PARTITION BY type_id, name) AS first_ord FROM t) x WHERE rn = 1")
def wn4(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select(F.col("o_custkey").alias("type_id"), F.col("o_orderstatus").alias("name"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 4 == 0, "modified").otherwise("both").alias("side"))
    return S.canonical_members(t, ["type_id", "name"])
