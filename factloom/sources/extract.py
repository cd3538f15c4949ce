"""Source trees to fact tables: discovery by file listing, one parse per file, then joins.

``scan`` reads the sources once and freezes one typed row per entity; every fact table is a projection of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import paths as P
from factloom.operators import edges as E
from factloom.operators import resolve as R
from factloom.session import freeze, ship

REFS = "array<struct<name: string, cardinality: string>>"
FIELD = f"struct<name: string, ty_text: string, ownership: string, refs: {REFS}, lifetimes: array<string>, line: int>"
TYPE = f"full_path string, name string, module string, module_id string, kind string, visibility string, lifetime_params array<string>, type_params array<string>, derives array<string>, doc_first_line string, unsafe_blocks int, fields array<{FIELD}>, trait_impls array<string>, file string, start_line int, end_line int"
FN = f"owner_kind string, owner string, module string, name string, impl_trait string, visibility string, self_kind string, is_unsafe boolean, is_const boolean, is_async boolean, lifetime_params array<string>, params array<struct<name: string, ty_text: string, ownership: string, refs: {REFS}, lifetimes: array<string>>>, return_ty_text string, return_ownership string, return_refs {REFS}, lifetime_flows_through boolean, unsafe_blocks int, doc_first_line string, file string, start_line int, end_line int"
IMPL = "module string, module_id string, type_name string, impl_trait string, unsafe_blocks int"
EXPORT = "module_id string, exposed_name string, hint string, visibility string, line int, file string"
MODULE = "module string, module_id string, file string"
CALL = "caller string, kind string, path string, name string, self_type string, owner_type string, module_id string, hint string, type_hint string, origin string, callsite_start_line int, callsite_end_line int"
PRUNED = ("target", "tmp", ".git", "node_modules", "dist", "build")
#: Folders that hold no Rust package; below a package's ``src`` the names mean nothing.
PRUNED_RUST = ("target", "tmp", ".git", "node_modules")


@dataclass
class Facts:
    modules: DataFrame
    types: DataFrame
    functions: DataFrame
    exports: DataFrame
    edges: DataFrame
    calls: DataFrame


def list_files(spark: SparkSession, root: str, contents: bool = True, only: list[str] | None = None, names: str = "*.{rs,ts,tsx,toml,json}") -> DataFrame:
    """All source and manifest files below ``root``: ``rel``, the path relative to it, ``uri``, ``modificationTime``,
    ``length`` and, with ``contents``, ``source``. Pruned folders are left out, for Rust sources those that no ``src``
    folder lies above; ``only`` names the ``uri`` values to take. Both are told from a file's metadata, so Spark takes
    other files out of its listing and never opens them."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    uri = F.col("_metadata.file_path")
    path = F.url_decode(F.regexp_replace(uri, "\\+", "%2B"))
    rel = F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "^" + _quoted(root.rstrip("/")) + "/", "")
    rust = ~rel.rlike("^(?:(?!src/)[^/]+/)*(?:" + "|".join(map(_quoted, PRUNED_RUST)) + ")/")
    other = ~F.arrays_overlap(F.split(rel, "/"), F.array(*map(F.lit, PRUNED)))
    df = df.where(F.when(rel.rlike("\\.(rs|toml)$"), rust).otherwise(other))
    if only is not None:
        df = df.where(uri.isin(only))
    cols = [rel.alias("rel"), uri.alias("uri"), "modificationTime", "length"]
    return df.select(*cols, F.col("content").cast("string").alias("source")) if contents else df.select(*cols)


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in s)


def _folder(c: Column) -> Column:
    return F.regexp_replace(c, "/?[^/]*$", "")


def rust_packages(files: DataFrame) -> DataFrame:
    """``crate``, ``src`` folder: manifests with a package section beside a ``src`` folder that holds sources."""
    m = files.where(F.col("rel").rlike("(^|/)Cargo\\.toml$") & F.col("source").contains("[package]"))
    m = m.where(~F.arrays_overlap(F.split("rel", "/"), F.array(*map(F.lit, PRUNED_RUST))))
    root = _folder(F.col("rel"))
    section = F.regexp_extract("source", "(?ms)^\\s*\\[package\\]\\s*$(.*?)(?=^\\s*\\[|\\z)", 1)
    name = F.regexp_extract(section, "(?m)^\\s*name\\s*=\\s*\"([^\"]+)\"", 1)
    m = m.select(root.alias("root"), F.when(name != "", name).otherwise(F.element_at(F.split(root, "/"), -1)).alias("crate"))
    m = m.withColumn("src", F.when(F.col("root") == "", "src").otherwise(F.concat("root", F.lit("/src"))))
    has = files.where(F.col("rel").endswith(".rs")).select(F.explode(P.ancestors("rel", False, "/")).alias("_s")).distinct()
    return m.join(has, F.col("src") == F.col("_s"), "left_semi").select("crate", "root", "src", F.lit("rust").alias("language"))


def ts_packages(files: DataFrame) -> DataFrame:
    """Folders with ``tsconfig.json``, or ``package.json`` and some source; ``src`` below if it holds sources."""
    m = files.where(F.col("rel").rlike("(^|/)(tsconfig|package)\\.json$")).withColumn("root", _folder(F.col("rel")))
    strong = F.max(F.col("rel").endswith("tsconfig.json").cast("int"))
    name = F.max(F.when(F.col("rel").endswith("package.json"), F.get_json_object("source", "$.name")))
    m = m.groupBy("root").agg(strong.alias("strong"), name.alias("named"))
    src = files.where(P.is_source_path("rel") & F.col("rel").rlike("\\.tsx?$")).select(F.explode(F.concat(F.array(F.lit("")), P.ancestors("rel", False, "/"))).alias("d")).distinct()
    below = F.when(F.col("root") == "", "src").otherwise(F.concat("root", F.lit("/src")))
    j = m.withColumn("below", below).join(src.toDF("_a"), F.col("root") == F.col("_a"), "left_semi").join(src.toDF("_b"), F.col("below") == F.col("_b"), "left")
    j = j.select(F.coalesce("named", F.element_at(F.split("root", "/"), -1)).alias("crate"), "root", F.coalesce("_b", "root").alias("src"), "strong")
    w = Window.partitionBy("src").orderBy(F.desc("strong"), "root")
    return j.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("crate", "root", "src", F.lit("typescript").alias("language"))


def assigned(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Each source with the innermost package of its language around it and its module path."""
    ext = F.when(F.col("rel").endswith(".rs"), "rust").when(F.col("rel").rlike("\\.tsx?$") & ~F.col("rel").contains(".d.ts"), "typescript")
    s = files.withColumn("language", ext).where("language is not null")
    s = s.withColumn("up", F.explode(F.concat(F.array(F.lit("")), P.ancestors("rel", False, "/"))))
    j = s.join(packages.withColumnRenamed("language", "_l"), (F.col("up") == F.col("src")) & (F.col("language") == F.col("_l")))
    w = Window.partitionBy("rel", "language").orderBy(F.desc(F.length("src")))
    j = j.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    inner = F.when(F.col("src") == "", F.col("rel")).otherwise(F.expr("substring(rel, length(src) + 2)"))
    return j.select("crate", "language", "rel", F.when(F.col("language") == "rust", P.rust_module_path(inner)).otherwise(P.ts_module_path(inner)).alias("module"), "uri", "source", F.unix_micros("modificationTime").alias("mtime"), "length")


def scan(files: DataFrame, packages: DataFrame, language: str | None = None) -> DataFrame:
    """``crate``, ``language``, ``file``, ``what``, ``ord``, ``json``: one row per entity of every source."""
    ship(files.sparkSession)
    src = assigned(files, packages)
    if language:
        src = src.where(F.col("language") == language)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from factloom.sources.rust_parser import parse_rust
        from factloom.sources.ts_parser import parse_ts

        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                f = (parse_rust if r.language == "rust" else parse_ts)(r.crate, r.module, r.rel, r.source)
                if f is None:
                    continue
                modules = f.modules if r.language == "rust" else [{"module": f.module, "module_id": f.module_id, "file": f.file}]
                for what, items in (("module", modules), ("type", f.types), ("fn", f.functions), ("impl", getattr(f, "impls", [])), ("export", getattr(f, "exports", [])), ("call", f.calls)):
                    rows += [(r.crate, r.language, r.rel, what, k, json.dumps(x)) for k, x in enumerate(items)]
            yield pd.DataFrame(rows, columns=["crate", "language", "file", "what", "ord", "json"])

    return src.mapInPandas(run, "crate string, language string, file string, what string, ord long, json string")


def _of(rows: DataFrame, what: str, schema: str) -> DataFrame:
    cols = [c for c in ("crate", "language", "ord") if not schema.startswith(c)]
    f = rows.where(F.col("what") == what).select(*cols, F.col("file").alias("_file"), F.from_json("json", schema).alias("x"))
    return f.select(*cols, "_file", "x.*").withColumn("seq", F.struct("_file", "ord"))


def _impl_targets(types: DataFrame, impls: DataFrame) -> DataFrame:
    """Impl blocks with ``full_path``, the type of their name in their own file: that of the block's module, else the
    first of any module, else null; and ``target``, that path or the one the block's module would give."""
    t = types.select("_file", F.col("name").alias("_n"), F.col("module").alias("_m"), "full_path", F.col("ord").alias("_o"))
    i = impls.withColumn("impl_id", F.struct("_file", "ord"))
    j = i.join(t.withColumnRenamed("_file", "_f"), (F.col("_file") == F.col("_f")) & (F.col("type_name") == F.col("_n")), "left")
    best = F.row_number().over(Window.partitionBy("impl_id").orderBy((F.col("module") == F.col("_m")).cast("int").desc_nulls_last(), "_o"))
    return j.withColumn("rn", best).where("rn = 1").withColumn("target", F.coalesce("full_path", F.concat_ws("::", "module_id", "type_name")))


def impl_owners(types: DataFrame, impls: DataFrame) -> DataFrame:
    """``_file``, ``written``, ``owner``: for owners named by the module of an impl block, the type it belongs to,
    where that is another."""
    written = F.concat_ws("::", "module_id", "type_name")
    j = _impl_targets(types, impls).withColumn("written", written).where("full_path is not null and full_path <> written")
    return j.groupBy("_file", "written").agg(F.min("full_path").alias("owner"))


def with_owners(rows: DataFrame, owners: DataFrame, columns: list[str], member: str | None = None) -> DataFrame:
    """``rows`` whose ``columns`` name the true owners; ``member`` is an id below the first of them."""
    cols = rows.columns
    for c in columns:
        o = owners.select(F.col("_file").alias("_of"), F.col("written").alias("_w"), F.col("owner").alias("_o"))
        rows = rows.join(o, (F.col("_file") == F.col("_of")) & (F.col(c) == F.col("_w")), "left")
        if member and c == columns[0]:
            moved = F.concat("_o", F.substring(member, F.length("_w") + 1, F.length(member)))
            rows = rows.withColumn(member, F.when(F.col("_o").isNotNull() & F.col(member).startswith(F.concat("_w", F.lit("::"))), moved).otherwise(F.col(member)))
        rows = rows.withColumn(c, F.coalesce("_o", c)).select(cols)
    return rows


def attach_impls(types: DataFrame, impls: DataFrame) -> DataFrame:
    """Types with the traits and unsafe blocks of the impl blocks of their own file; a block without a type gives a
    stub row with visibility ``<orphan-impl>``."""
    j = _impl_targets(types, impls)
    g = j.groupBy("target").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("impl_trait").isNotNull(), F.struct("ord", "impl_trait")))), lambda s: s["impl_trait"]).alias("more"), F.sum("unsafe_blocks").cast("int").alias("blocks"), F.min(F.struct("crate", "language", "_file", "module", "module_id", "type_name")).alias("stub"), F.max(F.col("full_path").isNotNull()).alias("known"))
    out = types.join(g.where("known"), F.col("full_path") == F.col("target"), "left").withColumn("trait_impls", F.concat("trait_impls", F.coalesce("more", F.array().cast("array<string>")))).withColumn("unsafe_blocks", F.col("unsafe_blocks") + F.coalesce("blocks", F.lit(0)))
    out = out.select(types.columns)
    empty = F.array().cast("array<string>")
    stubs = g.where("not known").select(F.col("stub.crate").alias("crate"), F.col("stub.language").alias("language"), F.lit(1 << 40).alias("ord"), F.col("stub._file").alias("_file"), F.col("target").alias("full_path"), F.col("stub.type_name").alias("name"), F.col("stub.module").alias("module"), F.col("stub.module_id").alias("module_id"), F.lit("struct").alias("kind"), F.lit("<orphan-impl>").alias("visibility"), empty.alias("lifetime_params"), empty.alias("type_params"), empty.alias("derives"), F.lit(None).cast("string").alias("doc_first_line"), F.col("blocks").alias("unsafe_blocks"), F.array().cast(f"array<{FIELD}>").alias("fields"), F.col("more").alias("trait_impls"), F.col("stub._file").alias("file"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    return out.drop("seq").unionByName(stubs).withColumn("seq", F.struct("_file", "ord"))


def _ts_edges(types: DataFrame) -> DataFrame:
    """Extends, implements and field edges; a name that is not unique stays as it is; self loops stay."""
    known = types.select("name", F.col("full_path").alias("path")).distinct()
    t = types.withColumn("parents", F.transform(F.filter("derives", lambda d: d.startswith("@extends ")), lambda d: F.regexp_replace(d, "^@extends ", "")))
    ext = t.select(F.col("full_path").alias("source"), F.explode("parents").alias("name")).select("source", "name", F.lit("extends").alias("kind"), F.lit("trait_impl_block").alias("via"), F.lit("one").alias("cardinality"), F.concat(F.lit("extends "), F.col("name")).alias("origin"))
    imp = t.select(F.col("full_path").alias("source"), F.explode("trait_impls").alias("name")).select("source", "name", F.lit("trait_impl").alias("kind"), F.lit("trait_impl_block").alias("via"), F.lit("one").alias("cardinality"), F.concat(F.lit("implements "), F.col("name")).alias("origin"))
    fld = t.where(F.col("kind").isin("class", "interface")).select(F.col("full_path").alias("source"), F.explode("fields").alias("f")).select("source", F.col("f.name").alias("fname"), F.explode("f.refs").alias("r")).select("source", F.col("r.name").alias("name"), F.lit("owns").alias("kind"), F.lit("struct_field").alias("via"), F.col("r.cardinality").alias("cardinality"), F.concat(F.lit("field "), F.col("fname")).alias("origin"))
    refs = ext.unionByName(imp).unionByName(fld)
    return R.resolve_unique(refs, known).select(F.col("source").alias("from_id"), F.col("target").alias("to_id"), "kind", "via", "cardinality", "origin")


def _rust_calls(sites: DataFrame, types: DataFrame, functions: DataFrame) -> DataFrame:
    """Free, associated and method calls of Rust sources, resolved and deduplicated."""
    sites = sites.withColumn("call_id", F.xxhash64("_file", "ord"))
    keep = ["call_id", "caller", "kind", "origin", "callsite_start_line", "callsite_end_line"]
    fns = functions.where("owner_kind = 'module'").select("name", F.concat_ws("::", "owner", "name").alias("target"), F.col("owner").alias("fn_module")).distinct()
    free = sites.where("kind = 'function'")
    local = free.where(~F.col("path").contains("::")).join(fns.select(F.col("name").alias("_n"), "target", "fn_module"), (F.col("path") == F.col("_n")) & (F.col("module_id") == F.col("fn_module"))).select(*keep, "target", F.lit("exact").alias("resolution"))
    local = local.dropDuplicates(["call_id"])
    wide = free.join(local.select("call_id"), "call_id", "left_anti")
    ladder = lambda df: R.candidate_ladder(df.select(*keep, F.regexp_replace("path", "^(crate|self|super)::", "").alias("path"), "module_id"), fns.select("name", "target")).select(*keep, "target", "resolution")
    methods = functions.where("owner_kind = 'type'").select(F.col("owner").alias("type_path"), "name").distinct()
    assoc = sites.where("kind = 'associated_function'").withColumn("segs", P.segments("path"))
    assoc = assoc.withColumn("type_ref", F.regexp_replace(P.joined(F.slice("segs", F.lit(1), F.size("segs") - 1)), "^(crate|self|super)::", "")).drop("segs")
    own = assoc.where("type_ref = 'Self'").select(*keep, "name", F.col("owner_type").alias("type_path"), F.lit("exact").alias("owner_res"))
    t = types.select("name", F.col("full_path").alias("target"), "module_id").distinct()
    named = assoc.where("type_ref <> 'Self'")
    here = named.join(t.select(F.col("name").alias("_n"), F.col("target").alias("type_path"), F.col("module_id").alias("_m")), (F.col("type_ref") == F.col("_n")) & (F.col("module_id") == F.col("_m"))).select(*keep, "name", "type_path", F.lit("exact").alias("owner_res")).dropDuplicates(["call_id"])
    far = named.join(here.select("call_id"), "call_id", "left_anti")
    far = R.candidate_ladder(far.select(*keep, F.col("name").alias("fname"), F.col("type_ref").alias("path"), "module_id"), t.select("name", "target")).select(*keep, F.col("fname").alias("name"), F.col("target").alias("type_path"), F.col("resolution").alias("owner_res"))
    owners = own.unionByName(here).unionByName(far)
    hit = owners.join(methods.select(F.col("type_path").alias("_t"), F.col("name").alias("_m")), (F.col("type_path") == F.col("_t")) & (F.col("name") == F.col("_m"))).withColumn("target", F.concat_ws("::", "type_path", "name"))
    hit = hit.select(*keep, "target", "owner_res").distinct().withColumn("n", F.count("*").over(Window.partitionBy("call_id")))
    hit = hit.select(*keep, "target", F.when(F.col("n") > 1, "ambiguous").otherwise(F.col("owner_res")).alias("resolution"))
    missed = ladder(assoc.join(hit.select("call_id").distinct(), "call_id", "left_anti"))
    meth = R.resolve_methods(sites.where("kind = 'method'").select(*keep, "name", "self_type"), methods).select(*keep, "target", "resolution")
    out = local.unionByName(ladder(wide)).unionByName(hit).unionByName(missed).unionByName(meth)
    first = out.groupBy("caller", F.col("target").alias("callee"), "kind", "resolution", "origin").agg(F.min(F.struct("callsite_start_line", "callsite_end_line")).alias("at"))
    return first.select("caller", "callee", "kind", "resolution", "origin", "at.callsite_start_line", "at.callsite_end_line")


def _ts_calls(sites: DataFrame, types: DataFrame, functions: DataFrame) -> DataFrame:
    """TypeScript calls, every site kept."""
    t = types.groupBy("name").agg(F.count_distinct("full_path").alias("n"), F.min("full_path").alias("path")).where("n = 1").select(F.col("name").alias("_t"), "path")
    known = functions.select("name", F.concat_ws("::", "owner", "name").alias("path")).union(types.select("name", "full_path")).distinct()
    s = sites.drop("path").withColumn("call_id", F.xxhash64("_file", "ord")).join(t, F.col("type_hint") == F.col("_t"), "left").withColumn("hint", F.coalesce("hint", "path")).drop("path", "_t")
    made = F.col("origin").startswith("new ")
    s = s.withColumn("new", made).withColumn("name", F.when(made, F.col("type_hint")).otherwise(F.col("name"))).withColumn("hint", F.when(made, F.lit(None)).otherwise(F.col("hint")))
    out = R.resolve_hinted(s.select("call_id", "caller", "kind", "origin", "callsite_start_line", "callsite_end_line", "name", "hint", "new"), known)
    callee = F.when(F.col("new"), F.concat("target", F.lit("::constructor"))).otherwise(F.col("target"))
    return out.select("caller", callee.alias("callee"), "kind", "resolution", "origin", "callsite_start_line", "callsite_end_line")


def checked_language(language: str | None) -> str | None:
    if language not in (None, "rust", "typescript"):
        raise ValueError(f"unknown frontend {language!r}")
    return language


def found_packages(files: DataFrame, root: str, language: str | None = None) -> DataFrame:
    """The packages of the listed files; none of the wanted language is an error."""
    packages = freeze(rust_packages(files).unionByName(ts_packages(files)), "packages")
    if packages.where(F.lit(True) if language is None else F.col("language") == language).isEmpty():
        raise ValueError(f"no package found below {root}")
    return packages


def extract(spark: SparkSession, root: str, language: str | None = None) -> Facts:
    """All facts of a source tree. Nothing found is an error, as is an unknown language."""
    checked_language(language)
    files = freeze(list_files(spark, root), "files")
    return facts_of(freeze(scan(files, found_packages(files, root, language), language), "entities"))


def facts_of(rows: DataFrame) -> Facts:
    """The fact tables of parsed entities, names resolved over all of them."""
    types = freeze(attach_impls(_of(rows, "type", TYPE), _of(rows, "impl", IMPL)).drop("seq"), "types")
    owners = freeze(impl_owners(_of(rows, "type", TYPE), _of(rows, "impl", IMPL)), "impl_owners")
    functions = freeze(with_owners(_of(rows, "fn", FN), owners, ["owner"]).drop("seq"), "functions")
    modules = _of(rows, "module", MODULE).groupBy("crate", "language", "module", "module_id").agg(F.min("file").alias("file"))
    rust_t, rust_f = types.where("language = 'rust'"), functions.where("language = 'rust'")
    known = R.registry(rust_t)
    resolve = lambda refs: R.resolve_types(refs, known)
    fields = rust_t.select(F.col("full_path").alias("type_path"), "ord", F.explode("fields").alias("f")).select("type_path", "ord", "f.*")
    edges = E.field_edges(rust_t.select("full_path", "kind").distinct(), fields, resolve).unionByName(E.function_edges(rust_f, resolve)).unionByName(E.trait_edges(rust_t, resolve)).unionByName(_ts_edges(types.where("language = 'typescript'")))
    exports = _of(rows, "export", EXPORT).withColumn("export_id", F.xxhash64("_file", "ord")).drop("seq")
    fns = rust_f.where("owner_kind = 'module'").select("name", F.concat_ws("::", "owner", "name").alias("path"), "ord")
    exports = R.resolve_reexports(exports, rust_t.select("name", "full_path", "kind", "ord"), fns)
    sites = with_owners(_of(rows, "call", CALL), owners, ["owner_type", "self_type"], "caller")
    calls = _rust_calls(sites.where("language = 'rust'"), rust_t, rust_f).unionByName(_ts_calls(sites.where("language = 'typescript'"), types.where("language = 'typescript'"), functions.where("language = 'typescript'")))
    return Facts(modules, types, functions, exports, edges, calls)
