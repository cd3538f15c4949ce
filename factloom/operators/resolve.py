"""Name resolution as ranked joins. The tie rules differ between kinds of references and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import paths as P


def registry(types: DataFrame) -> DataFrame:
    """name, path, ord; one row per path."""
    return types.groupBy("name", F.col("full_path").alias("path")).agg(F.min("ord").alias("ord"))


def _prefixes(path: Column | str) -> Column:
    """(n, prefix) for every leading part of a path, the empty one first; null has just that."""
    s = P.segments(path)
    parts = F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.struct(i.alias("n"), P.joined(F.slice(s, F.lit(1), i)).alias("prefix")))
    none = F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("prefix")))
    return F.when(F.col(path).isNull() if isinstance(path, str) else path.isNull(), none).otherwise(F.concat(none, parts))


def _nearest(keys: DataFrame, known: DataFrame) -> DataFrame:
    """``keys`` (``_name``, ``_at``, one row each) with ``target``: of the paths of that name those whose module shares
    the longest prefix with ``_at``. Only equal prefixes meet, so a name with many paths costs its ties, not all of them."""
    reg = known.select(F.col("name").alias("_k"), F.col("path").alias("target"), F.explode(_prefixes(P.module_of("path"))).alias("_p")).select("_k", "target", F.col("_p.n").alias("_pn"), F.col("_p.prefix").alias("_pp"))
    heads = reg.select("_k", "_pn", "_pp").distinct()
    same = (F.col("_name") == F.col("_k")) & (F.col("_n") == F.col("_pn")) & (F.col("_prefix") == F.col("_pp"))
    wanted = keys.select("_name", "_at", F.explode(_prefixes("_at")).alias("_p")).select("_name", "_at", F.col("_p.n").alias("_n"), F.col("_p.prefix").alias("_prefix"))
    best = wanted.join(heads, same, "left_semi").groupBy("_name", "_at").agg(F.max(F.struct("_n", "_prefix")).alias("_b"))
    best = best.select("_name", "_at", F.col("_b._n").alias("_n"), F.col("_b._prefix").alias("_prefix"))
    return best.join(reg, same).select("_name", "_at", "target")


def resolve_types(refs: DataFrame, known: DataFrame) -> DataFrame:
    """References (``ref_id``, ``source``, ``name``, …) with ``target``: one candidate is taken as it is, of several
    all those whose module shares the longest prefix with the source stay (all, if none shares any). Only names of
    several candidates are compared by prefixes, once for each source; references without a name or a source have no target."""
    ends = known.where("name is not null").groupBy(F.col("name").alias("_k")).agg(F.min("path").alias("target"), F.max("path").alias("_last"))
    one = ends.where("target = _last").select("_k", "target")
    out = refs.where("source is not null").join(one, F.col("name") == F.col("_k")).select(*refs.columns, "target")
    several = ends.where("target <> _last").select("_k")
    if several.isEmpty():  # references are then shuffled once
        return out
    rest = refs.where("source is not null").join(several, F.col("name") == F.col("_k"), "left_semi")
    keys = rest.select(F.col("name").alias("_name"), F.col("source").alias("_at")).distinct()
    found = _nearest(keys, known.join(several, F.col("name") == F.col("_k"), "left_semi"))
    return out.union(rest.join(found, (F.col("name") == F.col("_name")) & (F.col("source") == F.col("_at"))).select(*refs.columns, "target"))


def resolve_reexports(exports: DataFrame, types: DataFrame, functions: DataFrame) -> DataFrame:
    """Re-exports (``export_id``, ``hint`` path, ``module_id``) with ``target`` and ``target_kind``.

    Types come first; functions, which have no kind, only where no type has the name. Of several candidates: the first with the longest
    suffix of modules in common with the hint, else with the module itself, else the smallest path."""
    e = exports.withColumn("_h", F.filter(P.segments("hint"), lambda s: ~s.isin("crate", "self", "super", "Self")))
    e = e.withColumn("_leaf", F.element_at("_h", -1))
    t = types.select("name", F.col("full_path").alias("path"), F.col("kind").alias("target_kind"), F.col("ord").alias("_ord"), F.lit(0).alias("tier"))
    f = functions.select("name", "path", F.lit(None).cast("string").alias("target_kind"), F.col("ord").alias("_ord"), F.lit(1).alias("tier"))
    c = e.join(t.unionByName(f).withColumnRenamed("name", "_n"), F.col("_leaf") == F.col("_n"))
    own = Window.partitionBy("export_id")
    c = c.withColumn("_first", F.min("tier").over(own)).where("tier = _first")
    mod = P.segments(P.module_of("path"))
    hint = F.slice("_h", F.lit(1), F.greatest(F.size("_h") - 1, F.lit(0)))
    src = P.segments("module_id")
    s1 = F.when(F.size("_h") >= 2, P.common_suffix_length(hint, mod)).otherwise(0)
    s2 = P.common_suffix_length(F.slice(src, F.lit(1), F.greatest(F.size(src) - 1, F.lit(0))), mod)
    c = c.withColumn("s1", s1).withColumn("s2", s2).withColumn("m1", F.max("s1").over(own)).withColumn("m2", F.max("s2").over(own)).withColumn("n", F.count("*").over(own))
    pool = F.when(F.col("n") == 1, True).when(F.col("m1") > 0, F.col("s1") == F.col("m1")).when(F.col("m2") > 0, F.col("s2") == F.col("m2")).otherwise(True)
    by_order = (F.col("m1") > 0) | (F.col("m2") > 0)
    pick = Window.partitionBy("export_id").orderBy(F.when(by_order, F.col("_ord")).asc_nulls_last(), "path")
    return c.where(pool).withColumn("rn", F.row_number().over(pick)).where("rn = 1").select(*exports.columns, F.col("path").alias("target"), "target_kind")


def candidate_ladder(calls: DataFrame, candidates: DataFrame, name: Column | None = None) -> DataFrame:
    """Calls (``call_id``, ``path`` as written, ``module_id``) against candidates (``name``, ``target``): those that end
    in the written path; else those of the longest common module prefix; else all. Resolution says how sure it is."""
    keys = calls.select(F.col("path").alias("_path"), F.col("module_id").alias("_at")).distinct().withColumn("_name", P.leaf_of("_path"))
    s = P.segments("target")
    ends = candidates.select(F.col("name").alias("_k"), "target", F.explode(F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: P.joined(F.slice(s, i, F.size(s))))).alias("_end"))
    exact = keys.join(ends, (F.col("_name") == F.col("_k")) & (F.col("_path") == F.col("_end"))).select("_path", "_at", "target", F.lit("exact").alias("_sure"))
    met = exact.select(F.col("_path").alias("_mp"), F.col("_at").alias("_ma")).distinct()
    rest = keys.join(met, (F.col("_path") == F.col("_mp")) & F.col("_at").eqNullSafe(F.col("_ma")), "left_anti")
    near = _nearest(rest.select("_name", "_at").distinct(), candidates.select("name", F.col("target").alias("path")))
    near = near.withColumnsRenamed({"_name": "_nn", "_at": "_na"})
    near = rest.join(near, (F.col("_name") == F.col("_nn")) & F.col("_at").eqNullSafe(F.col("_na"))).select("_path", "_at", "target", F.lit("heuristic").alias("_sure"))
    found = exact.unionByName(near).withColumn("_ties", F.count("*").over(Window.partitionBy("_path", "_at")))
    label = F.when(F.col("_ties") > 1, "ambiguous").otherwise(F.col("_sure"))
    found = found.select("_path", "_at", "target", label.alias("resolution"))
    return calls.join(found, (F.col("path") == F.col("_path")) & F.col("module_id").eqNullSafe(F.col("_at"))).select(*calls.columns, "target", "resolution")


def resolve_unique(refs: DataFrame, known: DataFrame) -> DataFrame:
    """One candidate gives its path; none or several keep the bare name."""
    one = known.groupBy("name").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path")).where("n = 1").select(F.col("name").alias("k"), "path")
    return refs.join(one, F.col("name") == F.col("k"), "left").select(*refs.columns, F.coalesce("path", "name").alias("target"))


def resolve_hinted(calls: DataFrame, known: DataFrame) -> DataFrame:
    """Calls (``call_id``, ``name``, nullable ``hint`` prefix): ``hint::name`` if it exists, exact; one candidate, exact;
    none keeps the bare name, heuristic; several keep it, ambiguous."""
    every = known.select("path").distinct().withColumn("hinted", F.lit(True)).withColumnRenamed("path", "_hp")
    n = known.groupBy("name").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path")).withColumnRenamed("name", "k")
    c = calls.withColumn("_want", F.concat_ws("::", "hint", "name")).join(every, F.col("hint").isNotNull() & (F.col("_want") == F.col("_hp")), "left").join(n, F.col("name") == F.col("k"), "left")
    target = F.when(F.col("hinted"), F.col("_want")).when(F.col("n") == 1, F.col("path")).otherwise(F.col("name"))
    label = F.when(F.col("hinted") | (F.col("n") == 1), "exact").when(F.col("n") > 1, "ambiguous").otherwise("heuristic")
    return c.select(*calls.columns, target.alias("target"), label.alias("resolution"))


def resolve_methods(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Method calls (``call_id``, ``name``, nullable ``self_type``): on the current type they are exact, or ambiguous if
    it has several; elsewhere only a name that is unique everywhere counts, heuristically; others are dropped."""
    m = methods.select(F.col("type_path"), F.col("name").alias("_m"), F.concat_ws("::", "type_path", "name").alias("target")).distinct()
    total = m.groupBy("_m").agg(F.count("*").alias("n_all")).withColumnRenamed("_m", "_t")
    c = calls.join(m, F.col("name") == F.col("_m")).join(total, F.col("name") == F.col("_t"))
    here = F.col("self_type").isNotNull() & (F.col("type_path") == F.col("self_type"))
    c = c.where(here | (F.col("self_type").isNull() & (F.col("n_all") == 1)))
    n = F.count("*").over(Window.partitionBy("call_id"))
    return c.select(*calls.columns, "target", F.when(F.col("self_type").isNull(), "heuristic").when(n > 1, "ambiguous").otherwise("exact").alias("resolution"))
