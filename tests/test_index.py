"""Indexes, trees and gating."""

from factloom.operators import index


def test_file_tree(spark):
    df = spark.createDataFrame([("ws/src/a/x.rs",), ("ws/src/a/y.rs",), ("ws/src/main.rs",)], "path string")
    got = {(r.id, r.parent, r.is_dir, r.place) for r in index.file_tree(df).collect()}
    assert got == {("a", "", True, 1), ("main.rs", "", False, 2), ("a/x.rs", "a", False, 1), ("a/y.rs", "a", False, 2)}
    crumbs = [(r.segment, r.upto) for r in index.breadcrumbs(df.limit(1)).orderBy("pos").collect()]
    assert crumbs[0] == ("ws", "ws") and crumbs[-1][1].endswith(".rs")


def test_order_and_visibility(spark):
    n = spark.createDataFrame([("c", "", "module", "c"), ("c::b", "c", "type", "b"), ("c::A", "c", "type", "A"), ("c::m", "c", "module", "m"), ("c::m::T", "c::m", "type", "T")], "id string, parent string, kind string, label string")
    assert [r.label for r in index.tree_order(n).where("parent = 'c'").orderBy("place").collect()] == ["m", "A", "b"]
    assert {r.id for r in index.visible(n, spark.createDataFrame([("c",)], "id string")).collect()} == {"c", "c::b", "c::A", "c::m"}


def test_spans_and_stale_ids(spark):
    types = spark.createDataFrame([("c::A", "a.rs", 1, 9, "modified"), ("c::B", "b.rs", 2, 3, "base")], "full_path string, file string, start_line int, end_line int, side string")
    fns = spark.createDataFrame([("c::A", "go", "type", "a.rs", 3, 4, "head"), ("c", "run", "module", "a.rs", None, None, "both")], "owner string, name string, owner_kind string, file string, start_line int, end_line int, side string")
    e = index.span_entries(types, fns)
    assert {(r.element_id, r.kind) for r in e.collect()} == {("c::A", "type"), ("c::B", "type"), ("c::A::go", "method")}
    assert {(r.element_id, r.snapshot) for r in index.by_side(e).collect()} == {("c::A", "head"), ("c::A", "base"), ("c::B", "base"), ("c::A::go", "head")}
    mods = spark.createDataFrame([("c", "a.rs"), ("c::z", "a.rs")], "module_id string, file string")
    assert index.module_of_file(mods).first().module_id == "c"
    chosen = spark.createDataFrame([("c::A", "type"), ("c::gone", "type"), ("c::run", "function")], "id string, kind string")
    assert {r.id for r in index.still_there(chosen, index.known_ids(mods, types, fns)).collect()} == {"c::A", "c::run"}


def test_arrows_and_outline(spark):
    a = spark.createDataFrame([("T", "x", "at_lca"), ("T", "y", "drift_below"), ("U", "z", "drift_above")], "from_id string, row string, drift string")
    sel = spark.createDataFrame([("T", "y")], "type_id string, row string")
    assert {r.row for r in index.gated_arrows(a, sel).collect()} == {"x", "y"}
    ex = spark.createDataFrame([("c", "E", "c::core::E"), ("c", "F", "c::E")], "module_id string, exposed_name string, target string")
    t = spark.createDataFrame([("c::core::E", "struct", "c::core"), ("c::m::A", "struct", "c::m")], "full_path string, kind string, module_id string")
    assert [r.exposed_name for r in index.ghosts(ex, t).collect()] == ["E"]
    d = spark.createDataFrame([("c::m::A", "at_lca")], "item string, drift string")
    e = spark.createDataFrame([("c::m::A", "c::m::k::B", "owns"), ("c::m::A", "c::Z", "owns"), ("c::m::A", "c::m::C", "owns"), ("c::m::A", "c::q::D", "owns")], "from_id string, to_id string, kind string")
    rows = [(r.to_id, r.direction) for r in index.outline(t, d, e).where("module_id = 'c::m'").orderBy("place").collect()]
    assert rows == [("c::Z", "up"), ("c::m::C", "same"), ("c::m::k::B", "down"), ("c::q::D", "across")]
