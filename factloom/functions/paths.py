"""Path and label functions over ``::`` ids, as column expressions (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "::"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def segments(path: Column | str, sep: str = SEP) -> Column:
    return F.split(_c(path), sep, -1)


def joined(parts: Column, sep: str = SEP) -> Column:
    return F.array_join(parts, sep)


def module_of(path: Column | str) -> Column:
    """All but the last segment; the path itself if it has one segment."""
    s = segments(path)
    return F.when(F.size(s) > 1, joined(F.slice(s, F.lit(1), F.size(s) - 1))).otherwise(_c(path))


def leaf_of(path: Column | str) -> Column:
    return F.element_at(segments(path), -1)


def crate_of(path: Column | str) -> Column:
    return F.element_at(segments(path), 1)


def same_crate(a: Column | str, b: Column | str) -> Column:
    return crate_of(a) == crate_of(b)


def is_tests_path(path: Column | str) -> Column:
    return F.array_contains(segments(path), "tests")


def strictly_below(path: Column | str, ancestor: Column | str) -> Column:
    """``path`` lies under ``ancestor`` on a segment boundary; everything lies under the empty path."""
    p, a = _c(path), _c(ancestor)
    return F.when(a == "", p != "").otherwise(p.startswith(F.concat(a, F.lit(SEP))))


def depth(path: Column | str) -> Column:
    return F.when(_c(path) == "", F.lit(0)).otherwise(F.size(segments(path)))


def common_prefix_length(a: Column, b: Column) -> Column:
    """Equal leading elements of two arrays."""
    n = F.least(F.size(a), F.size(b))
    flags = F.transform(F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), F.lit(1), n), lambda z: z["x"] == z["y"])
    first = F.array_position(flags, F.lit(False))
    return F.when(n == 0, F.lit(0)).otherwise(F.when(first == 0, n).otherwise((first - 1).cast("int")))


def common_suffix_length(a: Column, b: Column) -> Column:
    return common_prefix_length(F.reverse(a), F.reverse(b))


def common_ancestor(a: Column | str, b: Column | str) -> Column:
    x, y = segments(a), segments(b)
    return joined(F.slice(x, F.lit(1), common_prefix_length(x, y)))


def tree_distance(a: Column | str, b: Column | str) -> Column:
    """Steps from ``a`` up to the common ancestor and down to ``b``; the empty path has no segments."""
    both = F.when((_c(a) == "") | (_c(b) == ""), F.lit(0)).otherwise(common_prefix_length(segments(a), segments(b)))
    return depth(a) + depth(b) - 2 * both


def ancestors(path: Column | str, include_self: bool = False, sep: str = SEP) -> Column:
    """Prefix chain from the root; without the path itself unless asked for."""
    s = segments(path, sep)
    last = F.size(s) - (0 if include_self else 1)
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: joined(F.slice(s, F.lit(1), i), sep)))


def strip_crate(path: Column | str, crate: Column | str) -> Column:
    """``path`` without its crate where that is ``crate``."""
    p = _c(path)
    pre = F.concat(_c(crate), F.lit(SEP))
    return F.when(p.startswith(pre), p.substr(F.length(pre) + 1, F.length(p))).otherwise(p)


def split_label(path: Column | str, callable_flag: Column | None = None) -> Column:
    """(crate, prefix, name) of an id; callables show ``()`` behind the name."""
    s = segments(path)
    name = F.element_at(s, -1)
    if callable_flag is not None:
        name = F.concat(name, F.when(callable_flag, "()").otherwise(""))
    middle = F.when(F.size(s) > 2, joined(F.slice(s, F.lit(2), F.greatest(F.size(s) - 2, F.lit(0))))).otherwise("")
    return F.struct(F.when(F.size(s) > 1, F.element_at(s, 1)).otherwise("").alias("crate"), middle.alias("prefix"), name.alias("name"))


def short_file(path: Column | str) -> Column:
    s = F.split(_c(path), "/")
    return F.array_join(F.slice(s, F.greatest(F.size(s) - 1, F.lit(1)), F.lit(2)), "/")


def truncate(text: Column | str, width: int) -> Column:
    """At most ``width`` characters, the last one an ellipsis if something was cut."""
    t = _c(text)
    return F.when(F.length(t) <= width, t).otherwise(F.concat(t.substr(F.lit(1), F.lit(width - 1)), F.lit("…")))


def normalise_type_text(text: Column | str) -> Column:
    """White space of printed types: single spaces, none around brackets, paths and references."""
    t = F.trim(F.regexp_replace(_c(text), "\\s+", " "))
    for pattern, to in (("\\s*(::|[<(\\[])\\s*", "$1"), ("\\s*([>)\\],;])", "$1"), ("([,;])(?=\\S)", "$1 "), ("&\\s+", "&"), ("\\s+:", ":")):
        t = F.regexp_replace(t, pattern, to)
    return t


def rust_module_path(rel_file: Column | str) -> Column:
    """Module path of a source file below ``src``: ``mod``, ``lib`` and ``main`` name their folder."""
    parts = F.split(F.regexp_replace(_c(rel_file), "\\.rs$", ""), "/")
    last = F.element_at(parts, -1)
    return joined(F.when(last.isin("mod", "lib", "main"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def ts_module_path(rel_file: Column | str) -> Column:
    parts = F.split(F.regexp_replace(_c(rel_file), "\\.tsx?$", ""), "/")
    return joined(F.when(F.element_at(parts, -1) == "index", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def is_source_path(path: Column | str, ignored: tuple[str, ...] = ("target", ".git", "node_modules", "tmp")) -> Column:
    """A Rust or TypeScript source outside ignored folders."""
    p = _c(path)
    return p.rlike("\\.(rs|ts|tsx)$") & ~p.contains(".d.ts") & ~F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, ignored)))


def visibility_bucket(text: Column | str) -> Column:
    v = _c(text)
    return F.when(v == "pub", "pub").when(v == "pub(crate)", "pub_crate").when(v == "pub(super)", "pub_super").when(v == "pub(self)", "private").when(v.startswith("pub("), "pub_in_path").otherwise("private")


def is_real_visibility(text: Column | str) -> Column:
    return ~_c(text).startswith("<")


def borrow_flavor(type_text: Column | str) -> Column:
    t = F.trim(_c(type_text))
    return F.when(t.rlike("^\\*\\s*(const|mut)(\\s|$)"), "raw").when(t.rlike("^&\\s*('[^\\s>),]*+\\s*)?mut(\\s|$)"), "mut").when(t.startswith("&"), "shared").otherwise("move")


def cardinality_rank(card: Column | str) -> Column:
    """one < optional < many < many_keyed."""
    c = _c(card)
    return F.when(c == "one", 0).when(c == "optional", 1).when(c == "many", 2).when(c == "many_keyed", 3)


def cardinality_of_rank(rank: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, ("one", "optional", "many", "many_keyed"))), _c(rank) + 1)


def ownership_code(ownership: Column | str) -> Column:
    o = _c(ownership)
    out = F.when(o == "owned", "own")
    for k, v in (("borrow_immut", "&"), ("borrow_mut", "&mut"), ("indirection", "ind"), ("primitive", "prim")):
        out = out.when(o == k, v)
    return out.otherwise("other")


def field_of_origin(origin: Column | str) -> Column:
    """X of an origin ``field X``; null for other origins."""
    x = F.regexp_extract(_c(origin), "^field (.*)$", 1)
    return F.when(_c(origin).startswith("field "), x)


def method_id(type_path: Column | str, name: Column | str, impl_trait: Column | str) -> Column:
    """``T::m`` or ``T::m@Trait``."""
    return F.concat(_c(type_path), F.lit(SEP), _c(name), F.coalesce(F.concat(F.lit("@"), _c(impl_trait)), F.lit("")))


def field_id(type_path: Column | str, name: Column | str) -> Column:
    return F.concat(_c(type_path), F.lit(SEP), _c(name))


def signature(name: Column | str, params: Column, returns: Column) -> Column:
    """``name(a: T, b) -> R``; ``params`` is an array of (name, ty_text)."""
    shown = F.array_join(F.transform(params, lambda p: F.when(p["ty_text"] == "", p["name"]).otherwise(F.concat(p["name"], F.lit(": "), p["ty_text"]))), ", ")
    return F.concat(_c(name), F.lit("("), shown, F.lit(")"), F.when(F.coalesce(returns, F.lit("")) == "", "").otherwise(F.concat(F.lit(" -> "), returns)))
