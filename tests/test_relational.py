"""Operator cases, and every query with SQL held against DuckDB at the smallest scale."""

import datetime as dt
import os
import subprocess

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factloom.functions import paths as P
from factloom.operators import drift, edges, graph, layout, modules, resolve, snapshots, spans
from factloom.plans.adapters import TABLES

SF = "/root/testdata/sf0.001"
CORE = sorted(k for k in entry._core.QUERIES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, duck, name):
    df = entry._core.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(cols).collect())
    if name not in entry._core.ORACLES:
        assert len(set(cols)) == len(cols)
        return
    want = duck.sql(entry._core.ORACLES[name])
    assert sorted(want.columns) == cols
    assert got == sorted(map(repr, want.project(", ".join(f'"{c}"' for c in cols)).fetchall()))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_paths(spark):
    p = lambda s: F.lit(s)
    r = one(spark, P.module_of(p("a::b::c")), P.module_of(p("a")), P.crate_of(p("a::b")), P.common_ancestor(p("a::b::c"), p("a::b::d::e")), P.tree_distance(p("a::b"), p("a::c::d")), P.ancestors(p("a::b::c")), P.strictly_below(p("a::bc"), p("a::b")), P.strictly_below(p("x"), p("")), P.rust_module_path(p("net/mod.rs")), P.rust_module_path(p("lib.rs")), P.ts_module_path(p("a/index.ts")), P.visibility_bucket(p("pub(in a::b)")), P.borrow_flavor(p("&'a mut T")), P.field_of_origin(p("field Some::value")), P.method_id(p("T"), p("m"), p("Tr")), P.short_file(p("a/b/c.rs")), P.truncate(p("abcdef"), 4))
    assert list(r) == ["a::b", "a", "a", "a::b", 3, ["a", "a::b"], False, True, "net", "", "a", "pub_in_path", "mut", "Some::value", "T::m@Tr", "b/c.rs", "abc…"]


@pytest.mark.parametrize(
    ("owners", "home", "want"),
    [
        (["c::a", "c::b"], "c", "at_lca"),
        (["c::a"], "c::a::sub", "within_budget"),
        (["c::a"], "c::a::sub::deeper", "drift_below"),
        (["c::a::sub"], "c", "drift_above"),
        (["c::x::a", "c::x::b"], "c::y", "drift_sideways"),
        ([], "c::q", "at_lca"),
    ],
)
def test_drift_view(spark, owners, home, want):
    o = spark.createDataFrame([(1, f"{m}::O{k}", m) for k, m in enumerate(owners)], "item int, owner string, owner_module string")
    assert drift.drift_view(spark.createDataFrame([(1, home)], "item int, home string"), o).first().drift == want


def test_depth_and_cycles(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "C")], "src string, dst string")
    assert {r.node: r.depth for r in graph.longest_depth(e).collect()} == {"A": 0, "B": 1, "C": 2}
    c = spark.createDataFrame([("w", "A", "B", 0), ("w", "B", "A", 1), ("w", "C", "A", 2)], "workspace string, src string, dst string, ord int")
    back = {(r.src, r.dst) for r in graph.back_edges(c).collect()}
    assert back == {("B", "A")}
    acyclic = c.where("not (src = 'B' and dst = 'A')")
    assert {r.node: r.depth for r in graph.longest_depth(acyclic.select("src", "dst")).collect()} == {"C": 0, "A": 1, "B": 2}
    with pytest.raises(RuntimeError):
        graph.longest_depth(c.select("src", "dst"), limit=5)


def test_components(spark):
    rows = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7)]
    got = {r.node: r.scc for r in graph.strong_components(spark.createDataFrame(rows, "src int, dst int")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}


def test_component_with_a_long_way_back(spark):
    rows = [(0, k) for k in range(1, 9)] + [(k, k - 1) for k in range(1, 9)]
    got = {r.node: r.scc for r in graph.strong_components(spark.createDataFrame(rows, "src int, dst int"), limit=3).collect()}
    assert got == dict.fromkeys(range(9), 0)


def test_forest(spark):
    rows = [("w", "R", "A"), ("w", "R", "B"), ("w", "A", "C"), ("w", "B", "C"), ("w", "S", "C"), ("w", "X", "Y"), ("w", "Y", "X")]
    nodes = spark.createDataFrame([("w", "Z")], "workspace string, node string")
    got = [(r.depth, r.node, r.note) for r in graph.ownership_forest(spark.createDataFrame(rows, "workspace string, src string, dst string"), nodes).orderBy("seq").collect()]
    assert got == [(0, "R", ""), (1, "A", ""), (2, "C", "also owned by B, S"), (1, "B", ""), (2, "C", "expanded above under A"), (0, "S", ""), (1, "C", "expanded above under A"), (0, "Z", "leaf root")]


def test_reexports(spark):
    """Modules of the hint decide, then those above the exporter, then the order of paths; types hide functions."""
    types = [("Lamp", "k::hall::east::Lamp", "struct", 3), ("Lamp", "k::hall::west::Lamp", "enum", 1), ("Lamp", "k::yard::Lamp", "union", 0), ("Door", "k::yard::Door", "trait", 2)]
    t = spark.createDataFrame(types, "name string, full_path string, kind string, ord int")
    f = spark.createDataFrame([("ring", "k::yard::ring", 0), ("Door", "k::hall::Door", 1)], "name string, path string, ord int")
    cases = {
        "east::Lamp": ("q", "k::hall::east::Lamp", "struct"),
        "self::hall::west::Lamp": ("q", "k::hall::west::Lamp", "enum"),
        "Lamp": ("q::yard::own", "k::yard::Lamp", "union"),
        "super::Lamp": ("q::none", "k::hall::east::Lamp", "struct"),
        "hall::Door": ("q", "k::yard::Door", "trait"),
        "deep::ring": ("q", "k::yard::ring", None),
    }
    e = spark.createDataFrame([(h, h, m) for h, (m, _, _) in cases.items()], "export_id string, hint string, module_id string")
    got = {r.export_id: (r.target, r.target_kind) for r in resolve.resolve_reexports(e, t, f).collect()}
    assert got == {h: (p, k) for h, (_, p, k) in cases.items()}


def test_field_edges(spark):
    types = spark.createDataFrame([("c::A", "struct"), ("c::B", "enum"), ("c::T", "type_alias")], "full_path string, kind string")
    ref = "refs array<struct<name: string, cardinality: string>>"
    fields = spark.createDataFrame([("c::A", "b", "owned", [("B", "many")], 0), ("c::A", "me", "owned", [("A", "one")], 1), ("c::B", "V", "borrow_mut", [("A", "one")], 0), ("c::T", "<alias>", "owned", [("A", "one")], 0), ("c::A", "n", "primitive", [], 2)], f"type_path string, name string, ownership string, {ref}, ord int")
    known = spark.createDataFrame([("A", "c::A", 0), ("B", "c::B", 1)], "name string, path string, ord int")
    got = {tuple(r) for r in edges.field_edges(types, fields, lambda x: resolve.resolve_types(x, known)).collect()}
    assert got == {("c::A", "c::B", "owns", "struct_field", "many", "field b"), ("c::B", "c::A", "borrows_mut", "enum_variant_payload", "one", "field V")}


DIFF = """diff --git a/x.rs b/x.rs
--- a/x.rs
+++ b/x.rs
@@ -1,3 +1,4 @@ fn
 a
-b
+B
+C
 d
\\ No newline at end of file
@@ -5 +6 @@
-q
+r
"""


def test_unified_diff(spark):
    df = spark.createDataFrame([("x.rs", DIFF), ("new.rs", "--- /dev/null\n+++ b/new.rs\n@@ -0,0 +1,2 @@\n+one\n+two\n"), ("same.rs", "")], "file string, text string")
    got = [tuple(r) for r in snapshots.parse_unified(df).orderBy("file", "ord").select("file", "hunk", "kind", "text", "old", "new").collect()]
    assert got == [("new.rs", 1, "add", "one", None, 1), ("new.rs", 1, "add", "two", None, 2), ("x.rs", 1, "context", "a", 1, 1), ("x.rs", 1, "del", "b", 2, None), ("x.rs", 1, "add", "B", None, 2), ("x.rs", 1, "add", "C", None, 3), ("x.rs", 1, "context", "d", 3, 4), ("x.rs", 2, "del", "q", 5, None), ("x.rs", 2, "add", "r", None, 6)]
    assert {tuple(r) for r in snapshots.diff_files(df).collect()} == {("x.rs", "x.rs", "x.rs"), ("new.rs", None, "new.rs"), ("same.rs", None, None)}
    ranges = {(r.file, r.hunk): (r.add_start, r.add_end, r.del_start, r.del_end) for r in snapshots.hunk_ranges(snapshots.parse_unified(df)).collect()}
    assert ranges == {("x.rs", 1): (2, 3, 2, 2), ("x.rs", 2): (6, 6, 5, 5), ("new.rs", 1): (1, 2, None, None)}
    lines = spark.createDataFrame([("3\t1\ta b.rs",), ("-\t-\tbin.png",), ("x",)], "line string")
    assert [tuple(r) for r in snapshots.numstat(lines).collect()] == [(3, 1, "a b.rs")]


@pytest.mark.parametrize(
    ("base", "head", "hb", "hh", "want"),
    [((10, 20), (10, 20), None, None, ("both", None)), ((10, 18), (12, 22), (15, 16), (15, 16), ("modified", "mixed")), ((10, 20), (10, 22), None, (15, 16), ("modified", "add")), ((10, 22), (10, 20), (15, 16), None, ("modified", "del")), (None, (1, 5), None, (2, 2), ("head", None)), (None, (1, 5), None, None, ("both", None)), ((1, 5), None, (3, 3), None, ("base", None))],
)
def test_sides(spark, base, head, hb, hh, want):
    hit = lambda s, h: bool(s and h and s[0] <= h[1] and s[1] >= h[0])
    cols = [F.lit(base is not None), F.lit(head is not None), F.lit(hit(head, hh)), F.lit(hit(base, hb))]
    change = F.when(cols[0] & cols[1], snapshots.change_kind(cols[2], cols[3]))
    assert tuple(one(spark, snapshots.side_of(*cols), change)) == want


def test_merge_keys(spark):
    base = spark.createDataFrame([("f", None, 1), ("f", None, 2), ("g", "T", 3)], "name string, impl_trait string, ord int")
    head = spark.createDataFrame([("f", None, 1), ("f", "T", 2), ("g", "T", 3), ("g", "T", 4)], "name string, impl_trait string, ord int")
    got = sorted((r.name, r.impl_trait or "", r.base.ord if r.base else 0, r.head.ord if r.head else 0) for r in snapshots.merge(base, head, ["name", "impl_trait"]).collect())
    assert got == [("f", "", 2, 1), ("f", "T", 0, 2), ("g", "T", 0, 4), ("g", "T", 3, 3)]
    pos = sorted((r.name, r.impl_trait or "", r.base.ord if r.base else 0, r.head.ord if r.head else 0) for r in snapshots.merge(base, head, ["name", "impl_trait"], True).collect())
    assert pos == [("f", "", 1, 1), ("f", "", 2, 0), ("f", "T", 0, 2), ("g", "T", 0, 4), ("g", "T", 3, 3)]


def test_line_ladder(spark):
    s = spark.createDataFrame([("f", "outer", 10, 50), ("f", "inner", 20, 30), ("f", "later", 70, 80)], "file string, element_id string, start_line int, end_line int")
    c = spark.createDataFrame([("f", "later", 22, 24), ("f", "gone", 40, 40)], "file string, callee string, start_line int, end_line int")
    m = spark.createDataFrame([("f", "mod"), ("g", "modg")], "file string, module_id string")
    p = spark.createDataFrame([(1, "f", 23), (2, "f", 25), (3, "f", 40), (4, "f", 60), (5, "f", 99), (6, "g", 1), (7, "h", 1)], "probe int, file string, line int")
    got = {r.probe: (r.element_id, r.how) for r in spans.resolve_lines(p, s, c, m).collect()}
    assert got == {1: ("later", "callsite"), 2: ("inner", "containing"), 3: ("outer", "containing"), 4: ("later", "next"), 5: ("later", "previous"), 6: ("modg", "module"), 7: (None, "unknown")}


def test_tour(spark):
    steps = spark.createDataFrame([(1, None, "a", "b"), (2, None, "b", "a"), (3, None, "a", "a"), (4, None, "a", "z"), (5, "r", None, None), (6, "r", "a", "b")], "step int, ref string, a string, b string")
    directed = spark.createDataFrame([("a", "b")], "from_id string, to_id string")
    assert {r.step for r in spans.tour_errors(steps, directed).collect()} == {2, 3, 4, 6}


def test_roles_and_tree(spark):
    m = spark.createDataFrame([("c", "src/lib.rs"), ("c::a", "src/a/mod.rs"), ("c::a::b", "src/a/b.rs"), ("c::a::b::t", "src/a/b.rs"), ("c::d", "src/d.rs")], "module_id string, file string")
    assert {r.module_id: r.role for r in modules.file_roles(m).collect()} == {"c": "crate-root", "c::a": "dir", "c::a::b": "dir", "c::a::b::t": "inline", "c::d": "leaf-file"}
    t = modules.module_tree(spark.createDataFrame([("c::x::y",)], "module_id string"))
    assert {(r.id, r.real, r.children) for r in t.collect()} == {("c", False, 1), ("c::x", False, 1), ("c::x::y", True, 0)}


def test_layout(spark):
    boxes = spark.createDataFrame([("r", "a", 0, 0, 10, 10), ("r", "b", 12, 0, 20, 10), ("r", "c", 500, 0, 510, 9), ("q", "d", 0, 0, 9, 9)], "region string, id string, x0 int, y0 int, x1 int, y1 int")
    assert layout.conflicts(boxes).count() == 0
    assert [(r.a, r.b) for r in layout.conflicts(boxes, 3).collect()] == [("a", "b")]
    assert {r.n: r.groups for r in layout.band_groups(spark.createDataFrame([(1,), (4,), (16,)], "n int")).collect()} == {1: 1, 4: 3, 16: 6}
    pts = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (5, 0), (9, 0), (9, 7)])], "path int, ord int, x double, y double")
    assert [r.ord for r in layout.simplified(pts).orderBy("ord").collect()] == [0, 2, 3]
    assert layout.path_lengths(pts).first().length == 16
    req = spark.createDataFrame([("L", 1, 0.0, 5.0, 20.0, 5.0)], "layout string, request long, x0 double, y0 double, x1 double, y1 double")
    wall = spark.createDataFrame([("L", 8.0, 0.0, 12.0, 9.0)], "layout string, x0 double, y0 double, x1 double, y1 double")
    way = [(r.x, r.y) for r in layout.routes(req, wall).orderBy("ord").collect()]
    assert way[0] == (0.0, 5.0) and way[-1] == (20.0, 5.0) and any(y in (-1.0, 10.0) for _, y in way)
    items = spark.createDataFrame([("r", "a", 0, 0, 0, 2, 2), ("r", "b", 0, 0, 1, 1, 1), ("r", "c", 1, 0, 0, 1, 1)], "region string, id string, rank int, group int, index int, w int, h int")
    assert {r.id: (r.x, r.y) for r in layout.placed(items).collect()} == {"a": (0, 0), "b": (0, 2), "c": (2, 0)}
    rows = spark.createDataFrame([("b", k, w) for k, w in enumerate([100.0, 120.0, 500.0, 90.0])], "box string, ord int, width double")
    frag = layout.fragments(layout.long_rows(rows))
    assert [(r.ord, r.long, r.fragment) for r in frag.orderBy("ord").collect()] == [(0, False, 1), (1, False, 1), (2, True, 2), (3, False, 3)]


def test_facts_json(spark, tmp_path):
    from factloom.sources import facts_json

    doc = '{"crates": {"c": {"name": "c", "root": "/c", "modules": {"": {"path": "", "file": "lib.rs", "types": [{"name": "A", "full_path": "c::A", "kind": "struct", "visibility": "pub", "fields": [{"name": "x", "ty_text": "B", "ownership": "owned", "referenced": ["B"], "cardinality": ["one"]}], "methods": [], "trait_impls": []}], "functions": [], "re_exports": []}}}}, "edges": [{"from": "c::A", "to": "c::B", "kind": "owns", "via": "struct_field", "origin": "field x"}], "call_edges": []}'
    (tmp_path / "f.json").write_text(doc)
    t = facts_json.read_facts(spark, str(tmp_path / "f.json"))
    assert [tuple(r) for r in t["edges"].collect()] == [("c::A", "c::B", "owns", "struct_field", "one", "field x", "both", 0)]
    assert t["fields"].first().refs[0].name == "B"
    assert '"full_path":"c::A"' in facts_json.module_documents(t["types"], t["fields"]).first().json
    (tmp_path / "bad.json").write_text('{"edges": []}')
    with pytest.raises(ValueError):
        facts_json.read_facts(spark, str(tmp_path / "bad.json"))


def test_git(spark, tmp_path):
    from factloom.sources import git

    assert [git.parse_revspec(x) for x in ("", "m", "a..b", "a..", "..b")] == [git.RevSpec(None, None), git.RevSpec(None, "m"), git.RevSpec("a", "b", True), git.RevSpec("a", None, True), git.RevSpec(None, "b", True)]
    repo = tmp_path / "r"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@e.x", *a], check=True, capture_output=True)
    run("init", "-q")
    (repo / "a.rs").write_text("one\ntwo\n")
    run("add", "-A")
    run("commit", "-qm", "first")
    (repo / "a.rs").write_text("one\n2\n")
    (repo / "b.rs").write_text("new\n")
    assert git.changed_files(str(repo), "HEAD", None) == ["a.rs"] and git.untracked_sources(str(repo)) == ["b.rs"]
    assert [(r.kind, r.text) for r in git.diff_lines(spark, str(repo), "HEAD").orderBy("ord").collect()] == [("context", "one"), ("del", "two"), ("add", "2")]
    assert [tuple(r) for r in git.changed_counts(spark, str(repo), "HEAD").collect()] == [(1, 1, "a.rs")]
    sha = git.resolve_sha(str(repo), "HEAD")
    assert git.read_source(str(repo), "a.rs", sha) == "one\ntwo\n" and git.show_blob(str(repo), sha, "b.rs") is None
    tree = git.materialize(str(repo), sha, str(tmp_path / "cache"))
    assert open(f"{tree}/a.rs").read() == "one\ntwo\n" and git.materialize(str(repo), sha, str(tmp_path / "cache")) == tree
    with pytest.raises(ValueError):
        git.read_source(str(repo), "../x")


def test_snapshot_store_and_feed(spark, tmp_path):
    from factloom.streaming import feed

    store = feed.SnapshotStore(spark, str(tmp_path / "store"))
    with pytest.raises(LookupError):
        store.read("types")
    inbox, told = tmp_path / "in", []
    inbox.mkdir()

    def rebuild(hits, epoch):
        if not hits.where("path = 'src/bad.rs'").isEmpty():
            raise RuntimeError("cannot parse")
        return {"types": hits.select("path")}

    def drop(n, path):
        (inbox / f"{n}.json").write_text(f'{{"path": "{path}", "kind": "modify", "ts": "2024-01-01T00:00:0{n}Z"}}\n')
        q = feed.follow(feed.file_versions(spark, str(inbox)), store, rebuild, told.append, str(tmp_path / "cp"))
        q.awaitTermination(120)

    drop(1, "src/a.rs")
    first = store.current()
    drop(2, "target/b.rs")
    assert store.current() == first
    drop(3, "src/bad.rs")
    assert store.current() == first and [t["event"] for t in told] == ["facts_updated", "error"] and told[0]["types_count"] == 1
    drop(4, "src/c.ts")
    assert [r.path for r in store.read("types").collect()] == ["src/c.ts"]
    assert store.collect_garbage(1) == 1 and [r.path for r in store.read("types").collect()] == ["src/c.ts"]


def test_debounce_and_cache(spark):
    from factloom.streaming import feed

    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    e = spark.createDataFrame([("a", at(0)), ("b", at(200)), ("a", at(450)), ("c", at(900))], "path string, ts timestamp")
    assert [(r.n, r.paths) for r in feed.debounced(e).orderBy("first").collect()] == [(3, ["a", "b"]), (1, ["c"])]
    cols = "path string, mtime long, length long, crate string, module string"
    files = spark.createDataFrame([("a", 1, 5, "c", ""), ("b", 2, 5, "c", "b")], cols)
    cache = spark.createDataFrame([("a", 1, 5, "c", ""), ("b", 1, 5, "c", "b"), ("gone", 1, 1, "c", "")], cols)
    stale = feed.stale_files(files, cache)
    assert [r.path for r in stale.collect()] == ["b"]
    assert sorted((r.path, r.mtime) for r in feed.merged_cache(cache, stale, files).collect()) == [("a", 1), ("b", 2)]
    assert feed.workspace_signature(files) == feed.workspace_signature(files.orderBy(F.desc("path"))) != feed.workspace_signature(cache)


def test_entry_without_extras(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rules_at_their_edges(spark):
    p = lambda s: F.lit(s)
    assert list(one(spark, P.visibility_bucket(p("pub(self)")), P.borrow_flavor(p("* const T")), P.borrow_flavor(p("&mut(T)")), P.borrow_flavor(p("&'a mut T")))) == ["private", "raw", "shared", "mut"]
    probes = spark.createDataFrame([(1, "f", None), (2, "f", 5)], "probe int, file string, line long")
    found = spans.resolve_lines(probes, spark.createDataFrame([("f", "e", 1, 3)], "file string, element_id string, start_line long, end_line long"), modules=spark.createDataFrame([("f", "m")], "file string, module_id string"))
    assert {r.probe: (r.element_id, r.how) for r in found.collect()} == {1: ("m", "module"), 2: ("e", "previous")}
    boxes = spark.createDataFrame([("a", 400.0, 300.0), ("b", 400.0, 100.0)], "box string, width double, header double")
    assert {r.box: r.long for r in layout.long_rows(boxes).collect()} == {"a": False, "b": True}


def test_the_empty_path(spark):
    rows = spark.createDataFrame([("", "a"), ("", ""), ("a::b", "a::c"), ("a", "")], "a string, b string")
    assert [r[0] for r in rows.select(P.tree_distance("a", "b")).collect()] == [1, 0, 2, 1]
    items = spark.createDataFrame([("i", "a::b")], "item string, home string")
    owners = spark.createDataFrame([("i", "o1", "a::x"), ("i", "o2", "z")], "item string, owner string, owner_module string")
    got = drift.drift_cli(items, owners).collect()[0]
    assert (got.lca, got.drift, got.severity) == ("", "sideways", 2)


def test_a_request_without_a_way(spark):
    req = spark.createDataFrame([("l", 1, 0.0, 0.0, 10.0, 0.0)], "layout string, request long, x0 double, y0 double, x1 double, y1 double")
    ring = spark.createDataFrame([("l", 8.0, -4.0, 9.0, 4.0), ("l", 11.0, -4.0, 12.0, 4.0), ("l", 7.0, -5.0, 13.0, -2.0), ("l", 7.0, 2.0, 13.0, 5.0)], "layout string, x0 double, y0 double, x1 double, y1 double")
    with pytest.raises(Exception, match="no way for request 1"):
        layout.routes(req, ring).collect()


def test_bucketed_overlaps_of_reversed_spans(spark):
    """A span that ends before it starts may be the last of its file; hunks are not clamped below its start."""
    rows = [(1, 1, 300, 5), (1, 2, 0, 4), (2, 1, 90, 90), (3, 1, None, 7), (None, 1, 0, 9)]
    s = spark.createDataFrame(rows, "file long, id long, start_line long, end_line long")
    h = spark.createDataFrame([(1, 5, 400), (2, 91, 95), (2, 90, 2**40), (3, 0, 9), (1, 4, 2)], "file long, start long, end long")
    want = sorted((f, i, a, b, any(f == g and None not in (a, b) and a <= z and b >= y for g, y, z in [tuple(r) for r in h.collect()])) for f, i, a, b in rows if f)
    for found in (spans.overlaps(s, h), spans.bucketed_overlaps(s, h)):
        assert {tuple(r) for r in found.where("file is not null").collect()} == set(want)


def test_only_names_of_several_types_are_compared_by_prefixes(spark):
    known = spark.createDataFrame([("A", "c::x::A", 0), ("A", "c::y::A", 1), ("B", "c::B", 2), (None, "c::N", 3)], "name string, path string, ord int")
    refs = spark.createDataFrame([(1, "c::y::S", "A"), (2, "c::z::S", "A"), (3, "d::S", "B"), (4, None, "B"), (5, "d::S", None), (6, "d::S", "C")], "ref_id int, source string, name string")
    targets = lambda df: sorted((r.ref_id, r.target) for r in df.collect())
    assert targets(resolve.resolve_types(refs, known)) == [(1, "c::y::A"), (2, "c::x::A"), (2, "c::y::A"), (3, "c::B")]
    unique = resolve.resolve_types(refs, known.where("ord > 0"))
    assert targets(unique) == [(1, "c::y::A"), (2, "c::y::A"), (3, "c::B")]
    assert "Generate" not in unique._jdf.queryExecution().optimizedPlan().toString()


def test_a_type_told_twice_has_its_fields_once(spark):
    types = spark.createDataFrame([("c::A", "struct"), ("c::A", "struct")], "full_path string, kind string")
    fields = spark.createDataFrame([("c::A", "b", "owned", [("B", "one")], 0)], "type_path string, name string, ownership string, refs array<struct<name: string, cardinality: string>>, ord int")
    known = spark.createDataFrame([("B", "c::B", 1)], "name string, path string, ord int")
    assert edges.field_edges(types, fields, lambda x: resolve.resolve_types(x, known)).count() == 1
