"""Survey counters over the facts of a scope: types, fields, methods, free functions, edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import paths as P
from factloom.operators import edges as E
from factloom.operators.modules import TYPE_KINDS

# Names of ownerships and self kinds, bucket order and labels.
OWNERSHIPS = ("owned", "borrow_immut", "borrow_mut", "indirection", "primitive", "other")
SELF_KINDS = ("none", "by_value", "ref", "ref_mut")
BUCKETS = ("pub", "pub_crate", "pub_super", "pub_in_path", "private")
BUCKET_LABELS = {"pub": "pub fn", "pub_crate": "pub(crate) fn", "pub_super": "pub(super) fn", "pub_in_path": "pub(in path) fn", "private": "local fn"}


@dataclass
class Scope:
    modules: DataFrame
    types: DataFrame
    fields: DataFrame
    methods: DataFrame
    functions: DataFrame
    edges: DataFrame


def scope(modules: DataFrame, types: DataFrame, fields: DataFrame, functions: DataFrame, edges: DataFrame, crate: str | None = None) -> Scope:
    """The facts of one crate, or of all. Fields and methods follow their type, edges the type or free function they
    start from."""
    here = (lambda df: df) if crate is None else (lambda df: df.where(F.col("crate") == crate))
    types, functions = here(types), here(functions)
    known = types.select(F.col("full_path").alias("_p")).distinct()
    free = functions.where("owner_kind = 'module'")
    starts = known.union(free.select(F.concat_ws("::", "owner", "name"))).distinct()
    of_known = lambda df, c: df.join(known, F.col(c) == F.col("_p"), "left_semi")
    return Scope(here(modules), types, of_known(fields, "type_path"), of_known(functions.where("owner_kind = 'type'"), "owner"), free, edges.join(starts, F.col("from_id") == F.col("_p"), "left_semi"))


def _each(column: str, values: tuple[str, ...], prefix: str = "") -> list[Column]:
    return [F.count_if(F.col(column) == v).alias(prefix + v) for v in values]


def field_counters(fields: DataFrame) -> DataFrame:
    """Fields of each type by ownership."""
    return fields.groupBy(F.col("type_path").alias("full_path")).agg(F.count("*").alias("fields"), *_each("ownership", OWNERSHIPS, "fields_"))


def method_counters(methods: DataFrame) -> DataFrame:
    """Methods of each type by how they take self, unsafe ones and those that pass a lifetime through."""
    return methods.groupBy(F.col("owner").alias("full_path")).agg(F.count("*").alias("methods"), *_each("self_kind", SELF_KINDS, "self_"), F.count_if("is_unsafe").alias("methods_unsafe"), F.count_if("lifetime_flows_through").alias("methods_lifetime_flow"), F.sum("unsafe_blocks").cast("long").alias("method_unsafe_blocks"))


def type_counters(types: DataFrame, fields: DataFrame, methods: DataFrame) -> DataFrame:
    """Every type with the counters of its fields and methods."""
    f, m = field_counters(fields), method_counters(methods)
    out = types.select("full_path", "kind", "visibility").join(f, "full_path", "left").join(m, "full_path", "left")
    counts = [c for c in (*f.columns, *m.columns) if c != "full_path"]
    return out.select("full_path", "kind", "visibility", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def type_table(counters: DataFrame, totals: DataFrame) -> DataFrame:
    """``counters`` of types (``type_counters``) with their edges in and out, of which ``totals`` are the counts
    (``edges.edge_totals``)."""
    p = totals.select(F.col("id").alias("full_path"), "in_total", "out_total")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_total", "out_total")]
    return counters.join(p, "full_path", "left").select(*counters.columns, *zero)


def global_counters(s: Scope) -> DataFrame:
    """``counter``, ``n``: all totals of a scope. Every part is one pre-aggregated row, turned into rows."""
    def rows(df: DataFrame) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(c).alias("counter"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n")) for c in df.columns))
        return df.select(F.explode(pairs).alias("x")).select("x.*")

    unsafe = F.sum("unsafe_blocks")
    t = s.types.agg(F.count("*").alias("types"), *_each("kind", TYPE_KINDS[:5], "types_"), F.count_if(F.col("n_lifetimes") > 0).alias("types_with_lifetimes"), unsafe.alias("type_unsafe_blocks"))
    f = s.fields.agg(F.count("*").alias("fields"), *_each("ownership", OWNERSHIPS, "fields_"))
    m = s.methods.agg(F.count("*").alias("methods"), *_each("self_kind", SELF_KINDS, "self_"), F.count_if("is_unsafe").alias("methods_unsafe"), F.count_if("lifetime_flows_through").alias("methods_lifetime_flow"), unsafe.alias("method_unsafe_blocks"))
    n = s.functions.agg(F.count("*").alias("free_fns"), F.count_if("is_unsafe").alias("free_fns_unsafe"), F.count_if("lifetime_flows_through").alias("free_fns_lifetime_flow"), unsafe.alias("free_fn_unsafe_blocks"))
    by = lambda c: s.edges.groupBy(F.concat(F.lit(f"edges_{c}:"), c).alias("counter")).agg(F.count("*").alias("n"))
    counted = rows(t).union(rows(f)).union(rows(m)).union(rows(n))
    blocks = counted.where(F.col("counter").endswith("unsafe_blocks")).select(F.lit("unsafe_blocks").alias("counter"), "n").groupBy("counter").agg(F.sum("n").alias("n"))
    return counted.union(blocks).union(s.edges.agg(F.count("*").alias("n")).select(F.lit("edges"), "n")).union(by("kind")).union(by("via"))


def module_lines(s: Scope) -> DataFrame:
    """One row per module of the scope, empty ones too: types by kind, free functions, unsafe blocks, types with lifetimes."""
    t = s.types.groupBy("module_id").agg(F.count("*").alias("types"), *_each("kind", TYPE_KINDS[:5], "types_"), F.sum("unsafe_blocks").alias("_tu"), F.count_if(F.col("n_lifetimes") > 0).alias("lifetime_types"))
    n = s.functions.groupBy(F.col("owner").alias("module_id")).agg(F.count("*").alias("fns"))
    m = s.modules.groupBy("module_id").agg(F.sum("unsafe_blocks").alias("_mu"))
    j = m.join(t, "module_id", "left").join(n, "module_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    counts = ["types", *(f"types_{k}" for k in TYPE_KINDS[:5]), "fns", "lifetime_types"]
    return j.select("module_id", *(zero(c).alias(c) for c in counts), (zero("_tu") + zero("_mu")).alias("unsafe_blocks"), P.is_tests_path("module_id").alias("is_tests"))


def _bucketed(functions: DataFrame) -> DataFrame:
    """Functions with a real visibility by owner and bucket, their names in order."""
    f = functions.where(P.is_real_visibility("visibility")).withColumn("bucket", P.visibility_bucket("visibility"))
    place = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket")).cast("int").alias("place")
    return f.groupBy("owner", "bucket").agg(F.sort_array(F.collect_list("name")).alias("names"), F.count("*").alias("n")).select("owner", "bucket", place, "n", "names")


def method_buckets(methods: DataFrame) -> DataFrame:
    """A type's methods by visibility bucket, in bucket order, names sorted; empty buckets do not appear."""
    return _bucketed(methods)


def function_groups(functions: DataFrame) -> DataFrame:
    """The groups that stand for a module's free functions: ``id``, ``module_id``, ``bucket``, ``label``, ``n``, ``names``."""
    label = F.create_map(*(F.lit(x) for kv in BUCKET_LABELS.items() for x in kv))
    g = _bucketed(functions)
    return g.select(F.concat("owner", F.lit("::__fn_"), "bucket").alias("id"), F.col("owner").alias("module_id"), "bucket", F.concat(label[F.col("bucket")], F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("label"), "n", "names")


def prelude_order(groups: DataFrame, types: DataFrame) -> DataFrame:
    """Place of what stands before a module's ranked types: function groups in bucket order, then the types by label
    and path."""
    b = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket")).cast("int")
    rows = groups.select("module_id", "id", F.lit(0).alias("_t"), b.alias("_b"), "label").union(types.select("module_id", F.col("full_path").alias("id"), F.lit(1), F.lit(0), F.col("name").alias("label")))
    return rows.select("module_id", "id", (F.row_number().over(Window.partitionBy("module_id").orderBy("_t", "_b", "label", "id")) - 1).alias("place"))


def ownership_scope(types: DataFrame, edges: DataFrame, crate: str | None = None, with_payload: bool = False) -> tuple[DataFrame, DataFrame]:
    """What the drift operators take: ``items`` (item, home) and ``owners`` (item, owner, owner_module). Types of the crate
    outside tests; owners by structure (with payload edges of variants if wanted), of the same crate, in scope, not the
    item itself, from a module outside tests."""
    t = types if crate is None else types.where(F.col("crate") == crate)
    items = t.where(~P.is_tests_path("module_id")).select(F.col("full_path").alias("item"), F.col("module_id").alias("home"))
    e = edges.where(E.structural(with_payload)).where((F.col("from_id") != F.col("to_id")) & P.same_crate("from_id", "to_id"))
    e = E.scoped(e, items.select(F.col("item").alias("full_path")), both=True).withColumn("owner_module", P.module_of("from_id"))
    return items, e.where(~P.is_tests_path("owner_module")).select(F.col("to_id").alias("item"), F.col("from_id").alias("owner"), "owner_module").distinct()
