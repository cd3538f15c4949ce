"""Two snapshots of a fact table: full-outer merges with sides and change kinds, hunks, text diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positional(df: DataFrame, keys: list[str], ord: str = "ord") -> DataFrame:
    """The place of a row among those with equal keys."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(ord)))


def last_wins(df: DataFrame, keys: list[str], ord: str = "ord") -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ord)))).where("_rn = 1").drop("_rn")


def first_wins(df: DataFrame, keys: list[str], ord: str = "ord") -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(ord))).where("_rn = 1").drop("_rn")


def change_kind(head_add: Column, base_del: Column) -> Column:
    """add, del, mixed, or null where nothing overlaps."""
    return F.when(head_add & base_del, "mixed").when(head_add, "add").when(base_del, "del")


def side_of(in_base: Column, in_head: Column, head_add: Column, base_del: Column, hunks_given: Column | bool = True) -> Column:
    """Side of a merged row. A matched row is modified where a hunk overlaps. An unmatched one belongs to its side,
    unless hunks are known and none touches it: then it is in both."""
    given = hunks_given if isinstance(hunks_given, Column) else F.lit(hunks_given)
    matched = in_base & in_head
    return F.when(matched & (head_add | base_del), "modified").when(matched, "both").when(in_head, F.when(~given | head_add, "head").otherwise("both")).otherwise(F.when(~given | base_del, "base").otherwise("both"))


def merge(base: DataFrame, head: DataFrame, keys: list[str], positional_pairs: bool = False) -> DataFrame:
    """Full-outer merge. Keys compare null-safely. With ``positional_pairs`` the n-th row of a key meets the n-th of the
    other side; without, the last base row of a key meets the first head row, and further head rows stay alone.
    Columns come back as structs ``base`` and ``head``."""
    b = positional(base, keys) if positional_pairs else last_wins(base, keys).withColumn("pos", F.lit(1))
    h = positional(head, keys)
    b = b.select(F.struct(*base.columns).alias("base"), *(F.col(k).alias(f"b_{k}") for k in keys), F.col("pos").alias("b_pos"))
    h = h.select(F.struct(*head.columns).alias("head"), *(F.col(k).alias(f"h_{k}") for k in keys), F.col("pos").alias("h_pos"))
    on = F.col("b_pos") == F.col("h_pos")
    for k in keys:
        on = on & F.col(f"b_{k}").eqNullSafe(F.col(f"h_{k}"))
    return b.join(h, on, "full_outer").select(*(F.coalesce(f"h_{k}", f"b_{k}").alias(k) for k in keys), F.coalesce("h_pos", "b_pos").alias("pos"), "base", "head")


def merge_edges(base: DataFrame, head: DataFrame, keys: tuple[str, ...] = ("from_id", "to_id", "kind", "via")) -> DataFrame:
    """Edges of two snapshots by key, the first of a key in each; side both, head or base."""
    b = first_wins(base, list(keys)).select(*keys, F.lit(True).alias("_b"))
    h = first_wins(head, list(keys)).select(*keys, F.lit(True).alias("_h"))
    j = b.join(h, list(keys), "full_outer")
    return j.select(*keys, F.when(F.col("_b") & F.col("_h"), "both").when(F.col("_h"), "head").otherwise("base").alias("side"))


def merge_reexports(base: DataFrame, head: DataFrame, keys: tuple[str, ...] = ("exposed_name", "target_path")) -> DataFrame:
    """All head rows, then base rows whose key head lacks."""
    return head.unionByName(base.join(head.select(*keys).distinct(), list(keys), "left_anti"))


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """A parent on one side forces its side on its children."""
    forced = parents.where(F.col("side").isin("base", "head")).select(F.col(key).alias("_k"), F.col("side").alias("forced"))
    return children.join(forced, F.col(key) == F.col("_k"), "left").withColumn("side", F.coalesce("forced", "side")).drop("_k", "forced")


def bar_state(members: DataFrame, by: str) -> DataFrame:
    """add, del or split for a type from itself and its members; modified counts on both sides."""
    adds = F.count_if(F.col("side").isin("head", "modified"))
    dels = F.count_if(F.col("side").isin("base", "modified"))
    g = members.groupBy(by).agg(adds.alias("adds"), dels.alias("dels"))
    return g.select(by, "adds", "dels", F.when((F.col("adds") > 0) & (F.col("dels") > 0), "split").when(F.col("adds") > 0, "add").when(F.col("dels") > 0, "del").otherwise("none").alias("state"))


def parse_unified(diffs: DataFrame, key: str = "file", text: str = "text", parity: bool = False) -> DataFrame:
    """Lines of unified diffs: ``key``, ``hunk``, ``ord``, ``kind``, ``text``, ``old``, ``new``.

    A hunk header without a count means one line; lines that begin with a backslash are dropped. ``parity`` also
    takes removed or added lines that look like a file header as headers, wherever they stand."""
    lines = diffs.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)).alias("ord", "line"))
    head = "^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@"
    w = Window.partitionBy(key).orderBy("ord")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("is_head", F.col("line").rlike(head)).withColumn("hunk", F.sum(F.col("is_head").cast("int")).over(run))
    at = lambda g: F.regexp_extract("line", head, g)
    number = lambda g: F.when(F.col("is_head"), F.when(at(g) == "", F.lit(1)).otherwise(at(g).cast("long")))
    lines = lines.withColumn("old0", number(1)).withColumn("old_n", number(2)).withColumn("new0", number(3)).withColumn("new_n", number(4))
    within = Window.partitionBy(key, "hunk").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = lines.where("hunk > 0")
    body = body.withColumn("o0", F.max("old0").over(within)).withColumn("n0", F.max("new0").over(within)).withColumn("on", F.max("old_n").over(within)).withColumn("nn", F.max("new_n").over(within)).where("not is_head")
    c = F.substring("line", 1, 1)
    kind = F.when(c == "+", "add").when(c == "-", "del").when(c == " ", "context")
    body = body.withColumn("kind", kind).where("kind is not null")
    if parity:
        body = body.where(~F.col("line").startswith("--- ") & ~F.col("line").startswith("+++ "))
    prior = Window.partitionBy(key, "hunk").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    used = lambda k: F.coalesce(F.sum(F.col("kind").isin("context", k).cast("long")).over(prior), F.lit(0))
    body = body.withColumn("ou", used("del")).withColumn("nu", used("add"))
    # lines behind the counts of the header belong to the next file's preamble
    body = body.where(((F.col("kind") == "add") & (F.col("nu") < F.col("nn"))) | ((F.col("kind") == "del") & (F.col("ou") < F.col("on"))) | ((F.col("kind") == "context") & (F.col("ou") < F.col("on")) & (F.col("nu") < F.col("nn"))))
    return body.select(key, F.col("hunk").cast("int").alias("hunk"), "ord", "kind", F.expr("substring(line, 2)").alias("text"), F.when(F.col("kind") != "add", F.col("o0") + F.col("ou")).alias("old"), F.when(F.col("kind") != "del", F.col("n0") + F.col("nu")).alias("new"))


def diff_files(diffs: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """Old and new path of each diff; ``/dev/null`` is null."""
    side = lambda mark: F.regexp_extract(text, f"(?m)^{mark} (?:[ab]/)?([^\\t\\n\\r]+)", 1)
    null = lambda c: F.when((c == "") | (c == "/dev/null"), F.lit(None)).otherwise(c)
    return diffs.select(key, null(side("---")).alias("old_path"), null(side("\\+\\+\\+")).alias("new_path"))


def hunk_ranges(lines: DataFrame, key: str = "file") -> DataFrame:
    """Least and greatest changed line of each hunk and side; null where a side did not change."""
    add, rem = F.when(F.col("kind") == "add", F.col("new")), F.when(F.col("kind") == "del", F.col("old"))
    return lines.groupBy(key, "hunk").agg(F.min(add).alias("add_start"), F.max(add).alias("add_end"), F.min(rem).alias("del_start"), F.max(rem).alias("del_end"))


def numstat(lines: DataFrame, column: str = "line") -> DataFrame:
    """Rows of ``git diff --numstat``; binary files are left out."""
    p = F.split(column, "\t", 3)
    out = lines.select(F.element_at(p, 1).try_cast("int").alias("added"), F.try_element_at(p, F.lit(2)).try_cast("int").alias("deleted"), F.try_element_at(p, F.lit(3)).alias("path"))
    return out.where("added is not null and deleted is not null and path is not null")


_SIDE_RANK = {"modified": 0, "both": 1, "head": 2, "base": 3}


def _side_rank() -> Column:
    out = F.lit(4)
    for k, v in _SIDE_RANK.items():
        out = F.when(F.col("side") == k, v).otherwise(out)
    return out


def canonical_types(types: DataFrame) -> DataFrame:
    """One row per full path: the richest variant (fields and methods; an alias counts 100 less; the first of equals),
    the strongest side, the previous span of the first modified variant; in order of first appearance."""
    score = F.col("n_fields") + F.col("n_methods") - F.when(F.col("kind") == "type_alias", 100).otherwise(0)
    g = types.withColumn("_score", score).withColumn("_side", _side_rank())
    best = g.groupBy("full_path").agg(F.max(F.struct("_score", (-F.col("ord")).alias("m"), "kind", "ord")).alias("b"), F.min("_side").alias("s"), F.min("ord").alias("first_ord"), F.min(F.when(F.col("side") == "modified", F.struct("ord", "prev_start"))).alias("p"), F.count("*").alias("variants"))
    names = F.array(*map(F.lit, ("modified", "both", "head", "base", "both")))
    side = F.element_at(names, F.col("s") + 1)
    return best.select("full_path", F.col("b.kind").alias("kind"), F.col("b.ord").alias("ord"), side.alias("side"), F.when(side == "modified", F.col("p.prev_start")).alias("prev_start"), "first_ord", "variants")


def canonical_members(members: DataFrame, keys: list[str]) -> DataFrame:
    """One member per key: the first, unless a later one is modified; ordered by first appearance."""
    first = F.col("side") == "modified"
    w = Window.partitionBy(*keys)
    m = members.withColumn("_rn", F.row_number().over(w.orderBy(first.cast("int").desc(), "ord"))).withColumn("first_ord", F.min("ord").over(w))
    return m.where("_rn = 1").drop("_rn")


#: Levels of a snapshot, the columns that name a row, its parent's columns, and whether equal keys pair by position.
LEVELS = {
    "packages": (["crate"], [], False),
    "modules": (["crate", "module_id"], ["crate"], False),
    "types": (["crate", "module_id", "full_path"], ["crate", "module_id"], True),
    "fields": (["crate", "module_id", "full_path", "name"], ["crate", "module_id", "full_path"], False),
    "functions": (["crate", "module_id", "owner", "name"], ["crate", "module_id"], True),
}


def merge_snapshots(base: dict[str, DataFrame], head: dict[str, DataFrame], hunks: bool = True) -> dict[str, DataFrame]:
    """Two snapshots level by level: crates by name, modules by path, then their types, fields and functions.

    Tables of levels below modules have ``ord`` and ``hit``, whether a hunk of their side touches the row; absent tables
    are left out. A row is on both sides, on one, or modified; what is on one side takes all below it along, whatever
    hunks say. Each level gives its keys, ``pos``, ``side`` and the rows ``base`` and ``head``. A type is on one side for its
    fields if all variants of its path are."""
    out: dict[str, DataFrame] = {}
    for level, (keys, parent, by_position) in LEVELS.items():
        if level not in base and level not in head:
            continue
        b, h = base.get(level, head.get(level)), head.get(level, base.get(level))
        b, h = (b if level in base else b.limit(0)), (h if level in head else h.limit(0))
        if not parent or level == "modules":  # no hunks at these levels, and one row per key
            b, h = b.withColumn("hit", F.lit(False)), h.withColumn("hit", F.lit(False))
            b, h = (x if "ord" in x.columns else x.withColumn("ord", F.lit(0)) for x in (b, h))
        m = merge(b, h, keys, by_position)
        given = hunks and parent and level != "modules"
        side = side_of(F.col("base").isNotNull(), F.col("head").isNotNull(), F.coalesce("head.hit", F.lit(False)), F.coalesce("base.hit", F.lit(False)), bool(given))
        m = m.withColumn("side", side)
        if parent:
            above = {1: "packages", 2: "modules", 3: "types"}[len(parent)]
            if above in out:
                up = out[above].groupBy(*parent).agg(F.min("side").alias("_lo"), F.max("side").alias("_hi"))
                forced = up.where("_lo = _hi and _lo in ('base', 'head')").select(*(F.col(k).alias(f"_{k}") for k in parent), F.col("_lo").alias("_forced"))
                on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in parent]
                m = m.join(forced, on, "left").withColumn("side", F.coalesce("_forced", "side")).drop("_forced", *(f"_{k}" for k in parent))
        out[level] = m.select(*keys, "pos", "side", "base", "head")
    return out


def merge_profiles(base: DataFrame, head: DataFrame, key: str) -> DataFrame:
    """Per key the row of head, and that of base where head has none."""
    return head.unionByName(base.join(head.select(key).distinct(), key, "left_anti"))


def merge_nested(base: DataFrame, head: DataFrame, key: str = "crate", modules: str = "modules") -> DataFrame:
    """The same for documents that hold a crate's modules as a map from path to a struct with ``side``: maps are merged
    in place, key by key. ``key``, ``side`` and ``modules``; a module that both have is that of head."""
    b, h = base.select(F.col(key).alias("_b"), F.col(modules).alias("_bm")), head.select(F.col(key).alias("_h"), F.col(modules).alias("_hm"))
    side = F.when(F.col("_b").isNull(), "head").when(F.col("_h").isNull(), "base").otherwise("both")
    one = lambda k, x, y: F.coalesce(y, x).withField("side", F.when(x.isNull(), "head").when(y.isNull(), "base").otherwise("both"))
    empty = F.map_from_arrays(F.array(), F.array()).cast(base.schema[modules].dataType)
    merged = F.map_zip_with(F.coalesce("_bm", empty), F.coalesce("_hm", empty), one)
    return b.join(h, F.col("_b") == F.col("_h"), "full_outer").select(F.coalesce("_h", "_b").alias(key), side.alias("side"), merged.alias(modules))
