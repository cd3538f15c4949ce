"""Edge tables: profiles, rankings, dominance, emission from fields and functions.

An edge row has ``from_id``, ``to_id``, ``kind``, ``via``, ``cardinality``, ``origin`` and, where order matters, ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import paths as P

EDGE_KINDS = ("owns", "borrows_immut", "borrows_mut", "indirection", "trait_impl", "extends")
VIA_KINDS = ("struct_field", "union_field", "enum_variant_payload", "fn_param", "fn_return", "trait_impl_block")


def _sides(edges: DataFrame) -> DataFrame:
    """Each edge once for either end: one pass and one shuffle serve both directions."""
    both = F.array(F.struct(F.col("from_id").alias("id"), F.lit("out").alias("dir"), F.col("to_id").alias("other")), F.struct(F.col("to_id").alias("id"), F.lit("in").alias("dir"), F.col("from_id").alias("other")))
    return edges.select("kind", "via", F.explode(both).alias("e")).select("e.id", "e.dir", "e.other", "kind", "via")


def edge_profile(edges: DataFrame) -> DataFrame:
    """Counts of edges by direction and kind, totals and distinct ends, one row per id that has an edge.

    Edges of the same ends become one row, which serves both directions: hubs shrink before their rows meet, and
    distinct ends are rows."""
    of_kind = [F.count_if(F.col("kind") == k).alias(k) for k in EDGE_KINDS]
    pairs = edges.groupBy("from_id", "to_id").agg(F.count("*").alias("total"), *of_kind)
    columns, sides = ("total", "distinct", *EDGE_KINDS), []
    for here, own, other in (("in", "to_id", "from_id"), ("out", "from_id", "to_id")):
        side = pairs.groupBy(F.col(own).alias("id")).agg(F.sum("total").alias("total"), F.count(other).alias("distinct"), *(F.sum(k).alias(k) for k in EDGE_KINDS))
        sides.append(side.select("id", *((F.col(c) if d == here else F.lit(0).cast("long")).alias(f"{d}_{c}") for d in ("in", "out") for c in columns)))
    added = [F.sum(f"{d}_{c}").alias(f"{d}_{c}") for c in ("total", "distinct") for d in ("in", "out")]
    return sides[0].unionByName(sides[1]).groupBy("id").agg(*added, *(F.sum(f"{d}_{k}").alias(f"{d}_{k}") for d in ("in", "out") for k in EDGE_KINDS))


def edge_totals(edges: DataFrame) -> DataFrame:
    """``id``, ``in_total`` and ``out_total`` of every id that has an edge."""
    count = lambda own: edges.groupBy(F.col(own).alias("id")).agg(F.count("*").alias("n"))
    none = F.lit(0).cast("long")
    both = count("to_id").select("id", F.col("n").alias("in_total"), none.alias("out_total")).union(count("from_id").select("id", none, "n"))
    return both.groupBy("id").agg(F.sum("in_total").alias("in_total"), F.sum("out_total").alias("out_total"))


def profile_maps(edges: DataFrame) -> DataFrame:
    """The nested form: kind and via maps per direction, built from counted rows."""
    s = _sides(edges)
    by = {}
    for column in ("kind", "via"):
        n = s.groupBy("id", "dir", column).agg(F.count("*").alias("n"))
        entry = F.struct(F.col(column), F.col("n"))
        by[column] = n.groupBy("id").agg(*(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("dir") == d, entry)))).alias(f"{d}_{column}") for d in ("in", "out")))
    return by["kind"].join(by["via"], "id")


def top_profiles(profile: DataFrame, direction: str, n: int, order: DataFrame | None = None) -> DataFrame:
    """Ids by total, then distinct ends, then input order (the id itself where none is given)."""
    p = profile if order is None else profile.join(order, "id", "left")
    last = F.col("ord").asc_nulls_last() if order is not None else F.col("id").asc()
    return p.where(F.col(f"{direction}_total") > 0).orderBy(F.desc(f"{direction}_total"), F.desc(f"{direction}_distinct"), last, F.col("id")).limit(n).select("id", f"{direction}_total", f"{direction}_distinct")


def without_inbound(types: DataFrame, edges: DataFrame) -> DataFrame:
    return types.join(edges.select(F.col("to_id").alias("full_path")), "full_path", "left_anti")


def scoped(edges: DataFrame, ids: DataFrame, id_column: str = "full_path", both: bool = False) -> DataFrame:
    """Edges whose source is in scope, or both ends."""
    scope = ids.select(F.col(id_column).alias("_id"))
    out = edges.join(scope, F.col("from_id") == F.col("_id"), "left_semi")
    return out.join(scope, F.col("to_id") == F.col("_id"), "left_semi") if both else out


def structural(with_payload: bool = False) -> Column:
    """Ownership by structure."""
    vias = ["struct_field", "union_field"] + (["enum_variant_payload"] if with_payload else [])
    return (F.col("kind") == "owns") & F.col("via").isin(vias)


def dominant_cardinality(edges: DataFrame) -> DataFrame:
    return edges.groupBy("from_id", "to_id").agg(P.cardinality_of_rank(F.max(P.cardinality_rank("cardinality"))).alias("cardinality"))


def directed_edges(edges: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Distinct pairs of edges and calls."""
    e = edges.select("from_id", "to_id")
    if calls is not None:
        e = e.union(calls.select("caller", "callee"))
    return e.distinct()


def edge_exists(asked: DataFrame, directed: DataFrame) -> DataFrame:
    """For each asked pair whether it exists and whether the reverse does."""
    d = directed.select(F.col("from_id").alias("f"), F.col("to_id").alias("t")).withColumn("hit", F.lit(True))
    r = d.toDF("f2", "t2", "back")
    out = asked.join(d, (F.col("from_id") == F.col("f")) & (F.col("to_id") == F.col("t")), "left").join(r, (F.col("from_id") == F.col("t2")) & (F.col("to_id") == F.col("f2")), "left")
    return out.select(*asked.columns, F.coalesce("hit", F.lit(False)).alias("exists"), F.coalesce("back", F.lit(False)).alias("reverse_exists"))


_KIND_OF = {"owned": "owns", "borrow_immut": "borrows_immut", "borrow_mut": "borrows_mut", "indirection": "indirection"}


def kind_of_ownership(ownership: Column | str) -> Column:
    """Edge kind of an ownership; null for primitives and others, which emit no edge."""
    o = F.col(ownership) if isinstance(ownership, str) else ownership
    out = F.lit(None).cast("string")
    for k, v in _KIND_OF.items():
        out = F.when(o == k, v).otherwise(out)
    return out


def via_of_type(kind: Column | str) -> Column:
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k == "struct", "struct_field").when(k == "union", "union_field").when(k == "enum", "enum_variant_payload")


def field_edges(types: DataFrame, fields: DataFrame, resolve) -> DataFrame:
    """Edges of fields: every resolved reference of an owning or borrowing field; self loops go.

    ``resolve(refs)`` adds ``target`` to rows with ``ref_id``, ``source`` and ``name``."""
    t = types.select("full_path", F.col("kind").alias("type_kind")).distinct()
    rows = fields.join(t, fields["type_path"] == t["full_path"]).withColumn("edge_kind", kind_of_ownership("ownership")).withColumn("via", via_of_type("type_kind"))
    rows = rows.where("edge_kind is not null and via is not null")
    refs = rows.select(F.col("type_path").alias("source"), F.concat(F.lit("field "), F.col("name")).alias("origin"), F.col("edge_kind"), F.col("via"), F.posexplode("refs").alias("pos", "r"), F.col("ord"))
    refs = refs.select(F.concat_ws("\x1f", "source", "origin", F.col("ord").cast("string"), F.col("pos").cast("string")).alias("ref_id"), "source", "origin", "edge_kind", "via", F.col("r.name").alias("name"), F.col("r.cardinality").alias("cardinality"))
    out = resolve(refs).where("target <> source")
    return out.select(F.col("source").alias("from_id"), F.col("target").alias("to_id"), F.col("edge_kind").alias("kind"), "via", "cardinality", "origin")


def function_edges(functions: DataFrame, resolve) -> DataFrame:
    """Parameter and return edges. The source of a method is its type, of a free function its own id."""
    base = functions.withColumn("source", F.when(F.col("owner_kind") == "type", F.col("owner")).otherwise(F.regexp_replace(F.concat(F.col("owner"), F.lit("::"), F.col("name")), "::::", "::")))
    p = base.select("source", "name", F.posexplode("params").alias("pos", "p")).select("source", F.concat(F.lit("fn "), F.col("name"), F.lit(" param "), F.col("p.name")).alias("origin"), F.lit("fn_param").alias("via"), F.col("p.ownership").alias("ownership"), F.col("p.refs").alias("refs"), "pos")
    r = base.select("source", F.concat(F.lit("fn "), F.col("name"), F.lit(" -> ret")).alias("origin"), F.lit("fn_return").alias("via"), F.col("return_ownership").alias("ownership"), F.col("return_refs").alias("refs"), F.lit(-1).alias("pos"))
    rows = p.unionByName(r).withColumn("edge_kind", kind_of_ownership("ownership")).where("edge_kind is not null")
    refs = rows.select("source", "origin", "via", "edge_kind", "pos", F.posexplode("refs").alias("k", "x"))
    refs = refs.select(F.concat_ws("\x1f", "source", "origin", F.col("pos").cast("string"), F.col("k").cast("string")).alias("ref_id"), "source", "origin", "edge_kind", "via", F.col("x.name").alias("name"), F.col("x.cardinality").alias("cardinality"))
    out = resolve(refs).where("target <> source")
    return out.select(F.col("source").alias("from_id"), F.col("target").alias("to_id"), F.col("edge_kind").alias("kind"), "via", "cardinality", "origin")


def trait_edges(types: DataFrame, resolve) -> DataFrame:
    """Implementation edges; self loops stay."""
    refs = types.select(F.col("full_path").alias("source"), F.posexplode("trait_impls").alias("pos", "name"))
    refs = refs.select(F.concat_ws("\x1f", "source", F.col("pos").cast("string")).alias("ref_id"), "source", "name")
    return resolve(refs).select(F.col("source").alias("from_id"), F.col("target").alias("to_id"), F.lit("trait_impl").alias("kind"), F.lit("trait_impl_block").alias("via"), F.lit("one").alias("cardinality"), F.concat(F.lit("impl "), F.col("name")).alias("origin"))
