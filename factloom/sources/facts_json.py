"""The nested facts document: typed reader, validation, and the sink that rebuilds it from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<file: string, start_line: int, end_line: int>"
_REF = "referenced: array<string>, cardinality: array<string>"
FIELD = f"struct<name: string, ty_text: string, ownership: string, {_REF}, lifetimes: array<string>, span: {SPAN}, prev_span: {SPAN}, change_kind: string, side: string>"
PARAM = f"struct<name: string, ty_text: string, ownership: string, {_REF}, lifetimes: array<string>>"
FN = f"struct<name: string, impl_trait: string, visibility: string, self_kind: string, is_unsafe: boolean, is_const: boolean, is_async: boolean, lifetime_params: array<string>, params: array<{PARAM}>, return_ty_text: string, return_ownership: string, return_referenced: array<string>, return_cardinality: array<string>, lifetime_flows_through: boolean, unsafe_blocks: int, doc_first_line: string, span: {SPAN}, prev_span: {SPAN}, change_kind: string, side: string>"
TYPE = f"struct<name: string, full_path: string, kind: string, visibility: string, lifetime_params: array<string>, type_params: array<string>, derives: array<string>, fields: array<{FIELD}>, methods: array<{FN}>, trait_impls: array<string>, unsafe_blocks: int, doc_first_line: string, span: {SPAN}, prev_span: {SPAN}, change_kind: string, side: string>"
EXPORT = f"struct<exposed_name: string, target_path: string, visibility: string, kind: string, target_kind: string, span: {SPAN}>"
MODULE = f"struct<path: string, file: string, unsafe_blocks: int, side: string, types: array<{TYPE}>, functions: array<{FN}>, re_exports: array<{EXPORT}>>"
CRATE = f"struct<name: string, root: string, language: string, side: string, modules: map<string, {MODULE}>>"
EDGE = "struct<`from`: string, `to`: string, kind: string, via: string, cardinality: string, origin: string, side: string, ord: long>"
CALL = "struct<caller: string, callee: string, kind: string, resolution: string, origin: string, callsite_start_line: int, callsite_end_line: int, side: string, ord: long>"
FACTS = f"crates map<string, {CRATE}>, edges array<{EDGE}>, call_edges array<{CALL}>"

#: Known kinds; others are reported, not refused.
TYPE_KINDS = ("struct", "enum", "union", "trait", "type_alias", "class", "interface")


def read_facts(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """Tables of a facts document, or with ``lines`` of the many small ones that ``write_facts`` writes. A document that
    does not parse or lacks ``crates`` or ``edges`` is an error; the positions in the document become ``ord``, but for
    edges that carry their own. Absent sides read as ``both``."""
    doc = spark.read.schema(FACTS).option("mode", "FAILFAST").json(path, multiLine=not lines)
    if not doc.where("crates is null or edges is null").isEmpty():
        raise ValueError("a facts document needs crates and edges")
    side = lambda c: F.coalesce(F.col(c), F.lit("both"))
    crates = doc.select(F.explode("crates").alias("crate", "c"))
    modules = crates.select("crate", F.explode("c.modules").alias("path", "m"))
    mid = F.when(F.col("path") == "", F.col("crate")).otherwise(F.concat_ws("::", "crate", "path"))
    modules = modules.select("crate", mid.alias("module_id"), "path", "m")
    types = modules.select("crate", "module_id", F.posexplode("m.types").alias("ord", "t"))
    refs = lambda a, b: F.zip_with(a, b, lambda n, c: F.struct(n.alias("name"), c.alias("cardinality")))
    fns = modules.select("crate", F.col("module_id").alias("owner"), F.lit("module").alias("owner_kind"), F.lit(None).cast("int").alias("owner_ord"), F.posexplode("m.functions").alias("ord", "f"))
    methods = types.select("crate", F.col("t.full_path").alias("owner"), F.lit("type").alias("owner_kind"), F.col("ord").alias("owner_ord"), F.posexplode("t.methods").alias("ord", "f"))
    edges = doc.select(F.posexplode("edges").alias("pos", "e")).withColumn("ord", F.coalesce("e.ord", "pos"))
    calls = doc.select(F.posexplode("call_edges").alias("pos", "e")).withColumn("ord", F.coalesce("e.ord", "pos"))
    return {
        "packages": crates.select("crate", "c.root", F.coalesce("c.language", F.lit("rust")).alias("language"), side("c.side").alias("side")).distinct(),
        "modules": modules.select("crate", "module_id", "path", "m.file", "m.unsafe_blocks", side("m.side").alias("side")),
        "types": types.select("crate", "module_id", "ord", "t.name", "t.full_path", "t.kind", "t.visibility", "t.lifetime_params", "t.type_params", "t.derives", "t.trait_impls", F.coalesce("t.unsafe_blocks", F.lit(0)).alias("unsafe_blocks"), "t.doc_first_line", "t.span", "t.prev_span", "t.change_kind", side("t.side").alias("side")),
        "fields": types.select(F.col("t.full_path").alias("type_path"), F.col("ord").alias("type_ord"), F.posexplode("t.fields").alias("ord", "f")).select("type_path", "type_ord", "ord", "f.name", "f.ty_text", "f.ownership", refs("f.referenced", "f.cardinality").alias("refs"), "f.lifetimes", "f.span", "f.prev_span", "f.change_kind", side("f.side").alias("side")),
        "functions": fns.unionByName(methods).select("crate", "owner", "owner_kind", "owner_ord", "ord", "f.name", "f.impl_trait", "f.visibility", "f.self_kind", "f.is_unsafe", "f.is_const", "f.is_async", "f.lifetime_params", "f.params", "f.lifetime_flows_through", "f.doc_first_line", "f.return_ownership", "f.return_ty_text", refs("f.return_referenced", "f.return_cardinality").alias("return_refs"), "f.unsafe_blocks", "f.span", "f.prev_span", "f.change_kind", side("f.side").alias("side")),
        "re_exports": modules.select("module_id", F.posexplode("m.re_exports").alias("ord", "r")).select("module_id", "ord", "r.*"),
        "edges": edges.select(F.col("e.from").alias("from_id"), F.col("e.to").alias("to_id"), "e.kind", "e.via", F.coalesce("e.cardinality", F.lit("one")).alias("cardinality"), "e.origin", side("e.side").alias("side"), "ord"),
        "call_edges": calls.select("e.caller", "e.callee", "e.kind", "e.resolution", "e.origin", "e.callsite_start_line", "e.callsite_end_line", side("e.side").alias("side"), "ord"),
    }


def unknown_kinds(types: DataFrame) -> DataFrame:
    return types.where(~F.col("kind").isin(*TYPE_KINDS)).select("full_path", "kind")


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges as JSON lines in the document's field names."""
    edges.select(F.col("from_id").alias("from"), F.col("to_id").alias("to"), "kind", "via", "cardinality", "origin").write.json(path)


def module_documents(types: DataFrame, fields: DataFrame) -> DataFrame:
    """One JSON value per module: its types in order, each with its fields in order."""
    f = fields.groupBy("type_path", "type_ord").agg(F.sort_array(F.collect_list(F.struct("ord", "name", "ty_text", "ownership"))).alias("x")).select("type_path", "type_ord", F.transform("x", lambda s: F.struct(s["name"].alias("name"), s["ty_text"].alias("ty_text"), s["ownership"].alias("ownership"))).alias("fields"))
    t = types.join(f, (F.col("full_path") == F.col("type_path")) & (F.col("ord") == F.col("type_ord")), "left")
    t = t.groupBy("crate", "module_id").agg(F.sort_array(F.collect_list(F.struct("ord", "name", "full_path", "kind", "visibility", F.coalesce("fields", F.array().cast("array<struct<name: string, ty_text: string, ownership: string>>")).alias("fields")))).alias("x"))
    return t.select("crate", "module_id", F.to_json(F.struct(F.transform("x", lambda s: s.dropFields("ord")).alias("types"))).alias("json"))


def _nested(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """The values of each group as an array in the order of ``ord``."""
    g = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", value.alias("x")))).alias("_x"))
    return g.select(*(F.col(c).alias(f"_{name}_{c}") for c in by), F.transform("_x", lambda s: s["x"]).alias(name))


def module_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """One facts document per module, and one per package that has none: members are gathered into their types, types,
    functions and re-exports into their modules. No group is larger than a module."""
    names = lambda c: (F.transform(c, lambda r: r["name"]).alias("referenced"), F.transform(c, lambda r: r["cardinality"]).alias("cardinality"))
    marks = ["span", "prev_span", "change_kind", "side"]
    field = F.struct("name", "ty_text", "ownership", *names("refs"), "lifetimes", *marks)
    returned = [c.alias(f"return_{n}") for c, n in zip(names("return_refs"), ("referenced", "cardinality"), strict=True)]
    fn = F.struct("name", "impl_trait", "visibility", "self_kind", "is_unsafe", "is_const", "is_async", "lifetime_params", "params", "return_ty_text", "return_ownership", *returned, "lifetime_flows_through", "unsafe_blocks", "doc_first_line", *marks)
    kind = F.struct("name", "full_path", "kind", "visibility", "lifetime_params", "type_params", "derives", F.coalesce("fields", F.array().cast(f"array<{FIELD}>")).alias("fields"), F.coalesce("methods", F.array().cast(f"array<{FN}>")).alias("methods"), "trait_impls", "unsafe_blocks", "doc_first_line", *marks)
    cast = lambda df, c, t: df.withColumn(c, F.col(c).cast(f"array<{t}>"))

    fields = cast(_nested(tables["fields"], ["type_path", "type_ord"], field, "fields"), "fields", FIELD)
    methods = cast(_nested(tables["functions"].where("owner_kind = 'type'"), ["owner", "owner_ord"], fn, "methods"), "methods", FN)
    t = tables["types"].join(fields, (F.col("full_path") == F.col("_fields_type_path")) & (F.col("ord") == F.col("_fields_type_ord")), "left").join(methods, (F.col("full_path") == F.col("_methods_owner")) & (F.col("ord") == F.col("_methods_owner_ord")), "left")
    types = _nested(t, ["module_id"], kind, "types")
    functions = cast(_nested(tables["functions"].where("owner_kind = 'module'"), ["owner"], fn, "functions"), "functions", FN)
    exports = _nested(tables["re_exports"], ["module_id"], F.struct("exposed_name", "target_path", "visibility", "kind", "target_kind", "span"), "re_exports")

    m = tables["modules"].join(types, F.col("module_id") == F.col("_types_module_id"), "left").join(functions, F.col("module_id") == F.col("_functions_owner"), "left").join(exports, F.col("module_id") == F.col("_re_exports_module_id"), "left")
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    module = F.struct("path", "file", "unsafe_blocks", "side", empty("types", TYPE), empty("functions", FN), empty("re_exports", EXPORT))
    m = m.select(F.col("crate").alias("_c"), F.create_map("path", module).alias("_modules"))
    p = tables["packages"].join(m, F.col("crate") == F.col("_c"), "left")
    crate = F.struct(F.col("crate").alias("name"), "root", "language", "side", F.coalesce("_modules", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{MODULE}>"))).alias("modules"))
    none = [F.array().cast(f"array<{EDGE}>").alias("edges"), F.array().cast(f"array<{CALL}>").alias("call_edges")]
    return p.select(F.to_json(F.struct(F.create_map("crate", crate).alias("crates"), *none)).alias("value"))


def edge_lines(tables: dict[str, DataFrame], size: int = 1000) -> DataFrame:
    """Facts documents of up to ``size`` neighbouring edges or calls each."""
    crates = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{CRATE}>")).alias("crates")

    def lines(name: str, row: Column, kind: str) -> DataFrame:
        g = tables[name].groupBy(F.floor(F.col("ord") / size).alias("_k")).agg(F.array_sort(F.collect_list(F.struct("ord", row.alias("x")))).alias("_x"))
        own = F.transform("_x", lambda s: s["x"]).alias(name)
        other = F.array().cast(f"array<{CALL if kind == EDGE else EDGE}>").alias("call_edges" if name == "edges" else "edges")
        return g.select(F.to_json(F.struct(crates, own, other)).alias("value"))

    edge = F.struct(F.col("from_id").alias("from"), F.col("to_id").alias("to"), "kind", "via", "cardinality", "origin", "side", "ord")
    call = F.struct("caller", "callee", "kind", "resolution", "origin", "callsite_start_line", "callsite_end_line", "side", "ord")
    return lines("edges", edge, EDGE).union(lines("call_edges", call, CALL))


def write_facts(tables: dict[str, DataFrame], path: str) -> None:
    """All tables as facts documents, one on a line: by module, then by stretches of edges. ``read_facts(..., lines=True)``
    gives the tables back. A table of edges is cut by ``ord``, so nothing passes through one task whole."""
    module_lines(tables).union(edge_lines(tables)).write.text(path)
