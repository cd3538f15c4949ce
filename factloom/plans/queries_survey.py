"""Survey, scope and grouping queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import edges as E
from factloom.operators import survey as S
from factloom.operators.modules import TYPE_KINDS
from factloom.plans.adapters import named, numbered_edges, read
from factloom.plans.registry import query


def _scope(spark: SparkSession, d: str, crate: str | None = None) -> S.Scope:
    """Regions are the crates."""
    types = read(spark, d, "types").withColumn("crate", F.split("full_path", "::")[1])
    return S.scope(read(spark, d, "mods"), types, read(spark, d, "members"), read(spark, d, "fns"), read(spark, d, "edges"), crate)


def _counts(column: str, values: tuple[str, ...], prefix: str) -> str:
    return ", ".join(f"count(*) FILTER ({column} = '{v}') AS {prefix}{v}" for v in values)


def _counter_sql(crate: str | None = None) -> str:
    """The totals of a scope, one select per counter family, turned into rows."""
    of = f" WHERE crate = '{crate}'" if crate else ""
    t = f"t AS (SELECT * FROM (SELECT *, split_part(full_path, '::', 2) AS crate FROM (SELECT * EXCLUDE (crate) FROM {{types}}) a) b{of})"
    f = "f AS (SELECT * FROM {members} WHERE type_path IN (SELECT full_path FROM t))"
    m = "m AS (SELECT * FROM {fns} WHERE owner_kind = 'type' AND owner IN (SELECT full_path FROM t))"
    n = f"n AS (SELECT * FROM (SELECT * FROM {{fns}} WHERE owner_kind = 'module') a{of})"
    e = "e AS (SELECT * FROM {edges} WHERE from_id IN (SELECT full_path FROM t UNION SELECT owner || '::' || name FROM n))"
    u = "CAST(coalesce(sum(unsafe_blocks), 0) AS BIGINT)"
    rows = [
        f"SELECT count(*) AS types, {_counts('kind', TYPE_KINDS[:5], 'types_')}, count(*) FILTER (n_lifetimes > 0) AS types_with_lifetimes, {u} AS type_unsafe_blocks FROM t",
        f"SELECT count(*) AS fields, {_counts('ownership', S.OWNERSHIPS, 'fields_')} FROM f",
        f"SELECT count(*) AS methods, {_counts('self_kind', S.SELF_KINDS, 'self_')}, count(*) FILTER (is_unsafe) AS methods_unsafe, count(*) FILTER (lifetime_flows_through) AS methods_lifetime_flow, {u} AS method_unsafe_blocks FROM m",
        f"SELECT count(*) AS free_fns, count(*) FILTER (is_unsafe) AS free_fns_unsafe, count(*) FILTER (lifetime_flows_through) AS free_fns_lifetime_flow, {u} AS free_fn_unsafe_blocks FROM n",
        "SELECT count(*) AS edges FROM e",
    ]
    whole = "SELECT CAST(sum(unsafe_blocks) AS BIGINT) AS unsafe_blocks FROM (SELECT unsafe_blocks FROM t UNION ALL SELECT unsafe_blocks FROM m UNION ALL SELECT unsafe_blocks FROM n) x"
    parts = [f"SELECT counter, n FROM (UNPIVOT ({r}) ON COLUMNS(*) INTO NAME counter VALUE n)" for r in (*rows, whole)]
    parts += [f"SELECT 'edges_{c}:' || {c} AS counter, count(*) AS n FROM e GROUP BY 1" for c in ("kind", "via")]
    return f"WITH {t}, {f}, {m}, {n}, {e} " + " UNION ALL ".join(parts)


@query("ag3_survey_counters", _counter_sql())
def ag3(spark: SparkSession, d: str) -> DataFrame:
    return S.global_counters(_scope(spark, d))


@query("fi1_crate_survey", _counter_sql("ASIA"))
def fi1(spark: SparkSession, d: str) -> DataFrame:
    return S.global_counters(_scope(spark, d, "ASIA"))


@query("ag4_module_lines", "SELECT g.module_id, coalesce(t.types, 0) AS types, " + ", ".join(f"coalesce(t.types_{k}, 0) AS types_{k}" for k in TYPE_KINDS[:5]) + ", coalesce(n.fns, 0) AS fns, coalesce(t.lifetime_types, 0) AS lifetime_types, CAST(coalesce(t.tu, 0) + g.mu AS BIGINT) AS unsafe_blocks, false AS is_tests FROM (SELECT module_id, sum(unsafe_blocks) AS mu FROM {mods} GROUP BY 1) g LEFT JOIN (SELECT module_id, count(*) AS types, " + _counts("kind", TYPE_KINDS[:5], "types_") + ", sum(unsafe_blocks) AS tu, count(*) FILTER (n_lifetimes > 0) AS lifetime_types FROM {types} GROUP BY 1) t ON t.module_id = g.module_id LEFT JOIN (SELECT owner, count(*) AS fns FROM {fns} WHERE owner_kind = 'module' GROUP BY 1) n ON n.owner = g.module_id")
def ag4(spark: SparkSession, d: str) -> DataFrame:
    return S.module_lines(_scope(spark, d))


_FIELD_COUNTS = ["fields", *(f"fields_{o}" for o in S.OWNERSHIPS)]
_METHOD_COUNTS = ["methods", *(f"self_{k}" for k in S.SELF_KINDS), "methods_unsafe", "methods_lifetime_flow", "method_unsafe_blocks"]
_TYPES = "SELECT t.full_path, t.kind, t.visibility, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _FIELD_COUNTS + _METHOD_COUNTS) + " FROM {types} t LEFT JOIN (SELECT type_path, count(*) AS fields, " + _counts("ownership", S.OWNERSHIPS, "fields_") + " FROM {members} GROUP BY 1) f ON f.type_path = t.full_path LEFT JOIN (SELECT owner, count(*) AS methods, " + _counts("self_kind", S.SELF_KINDS, "self_") + ", count(*) FILTER (is_unsafe) AS methods_unsafe, count(*) FILTER (lifetime_flows_through) AS methods_lifetime_flow, CAST(sum(unsafe_blocks) AS BIGINT) AS method_unsafe_blocks FROM {fns} WHERE owner_kind = 'type' GROUP BY 1) m ON m.owner = t.full_path"


def _type_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters are made before they meet the types, so members need no look-up of their types one by one."""
    return S.type_counters(read(spark, d, "types"), read(spark, d, "members"), read(spark, d, "fns").where("owner_kind = 'type'"))


@query("ag5_type_counters", _TYPES)
def ag5(spark: SparkSession, d: str) -> DataFrame:
    return _type_counters(spark, d)


@query("ag6_survey_types", "SELECT c.*, coalesce(i.n, 0) AS in_total, coalesce(o.n, 0) AS out_total FROM (" + _TYPES + ") c LEFT JOIN (SELECT to_id, count(*) AS n FROM {edges} GROUP BY 1) i ON i.to_id = c.full_path LEFT JOIN (SELECT from_id, count(*) AS n FROM {edges} GROUP BY 1) o ON o.from_id = c.full_path")
def ag6(spark: SparkSession, d: str) -> DataFrame:
    edges, names = numbered_edges(spark, d)
    return S.type_table(_type_counters(spark, d), named(E.edge_totals(edges), names, "id"))


_BUCKET = "CASE WHEN visibility = 'pub' THEN 'pub' WHEN visibility = 'pub(crate)' THEN 'pub_crate' WHEN visibility = 'pub(super)' THEN 'pub_super' WHEN visibility = 'pub(self)' THEN 'private' WHEN starts_with(visibility, 'pub(') THEN 'pub_in_path' ELSE 'private' END"
_GROUPS = f"SELECT owner, {_BUCKET} AS bucket, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM {{fns}} WHERE owner_kind = '%s' AND NOT starts_with(visibility, '<') GROUP BY 1, 2"
_PLACE = "list_position(['pub', 'pub_crate', 'pub_super', 'pub_in_path', 'private'], bucket)"
_LABEL = "CASE bucket WHEN 'pub' THEN 'pub fn' WHEN 'pub_crate' THEN 'pub(crate) fn' WHEN 'pub_super' THEN 'pub(super) fn' WHEN 'pub_in_path' THEN 'pub(in path) fn' ELSE 'local fn' END || ' (' || n || ')'"


@query("ag22_method_buckets", f"SELECT owner, bucket, CAST({_PLACE} AS INTEGER) AS place, n, names FROM ({_GROUPS % 'type'}) g")
def ag22_methods(spark: SparkSession, d: str) -> DataFrame:
    return S.method_buckets(_scope(spark, d).methods).withColumn("names", F.array_join("names", ","))


@query("ag22_function_groups", f"SELECT owner || '::__fn_' || bucket AS id, owner AS module_id, bucket, {_LABEL} AS label, n, names FROM ({_GROUPS % 'module'}) g")
def ag22_groups(spark: SparkSession, d: str) -> DataFrame:
    return S.function_groups(_scope(spark, d).functions).withColumn("names", F.array_join("names", ","))


@query("wn7_prelude_order", f"SELECT module_id, id, CAST(row_number() OVER (PARTITION BY module_id ORDER BY t, b, label, id) - 1 AS INTEGER) AS place FROM (SELECT owner AS module_id, owner || '::__fn_' || bucket AS id, 0 AS t, {_PLACE} AS b, {_LABEL} AS label FROM ({_GROUPS % 'module'}) g UNION ALL SELECT module_id, full_path, 1, 0, name FROM {{types}} WHERE kind = 'type_alias') x")
def wn7(spark: SparkSession, d: str) -> DataFrame:
    s = _scope(spark, d)
    return S.prelude_order(S.function_groups(s.functions), s.types.where("kind = 'type_alias'"))


@query("gr6_ownership_scope", "SELECT t.full_path AS item, t.module_id AS home, count(DISTINCT e.from_id) AS n_owners, min(e.from_module) AS first_module FROM {types} t LEFT JOIN (SELECT from_id, to_id, from_module FROM {edges} WHERE kind = 'owns' AND via IN ('struct_field', 'union_field') AND from_id IN (SELECT full_path FROM {types} WHERE split_part(full_path, '::', 2) = 'EUROPE')) e ON e.to_id = t.full_path WHERE split_part(t.full_path, '::', 2) = 'EUROPE' GROUP BY 1, 2")
def gr6(spark: SparkSession, d: str) -> DataFrame:
    types = read(spark, d, "types").withColumn("crate", F.split("full_path", "::")[1])
    items, owners = S.ownership_scope(types, read(spark, d, "edges"), "EUROPE")
    g = owners.groupBy(F.col("item").alias("_i")).agg(F.count_distinct("owner").alias("n"), F.min("owner_module").alias("first_module"))
    return items.join(g, F.col("item") == F.col("_i"), "left").select("item", "home", F.coalesce("n", F.lit(0)).alias("n_owners"), "first_module")
