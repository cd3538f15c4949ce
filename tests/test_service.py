"""Facts documents there and back, plug-in front ends, event sinks, tours and merges."""

import json
import os
import random

from pyspark.sql import functions as F

from factloom.operators import snapshots as S
from factloom.operators import survey
from factloom.operators import tours as T
from factloom.sources import facts_json as J


def _rows(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.collect())


def _document(rng):
    span = lambda: rng.choice([None, {"file": "a.rs", "start_line": rng.randrange(9), "end_line": 9}])
    refs = lambda: (lambda k: {"referenced": [f"T{i}" for i in range(k)], "cardinality": [rng.choice(["one", "many"]) for _ in range(k)]})(rng.randrange(3))
    marks = lambda: {"span": span(), "prev_span": span(), "change_kind": rng.choice([None, "add"]), "side": rng.choice(["both", "head"])}
    field = lambda i: {"name": f"f{i}", "ty_text": "u8", "ownership": "owned", **refs(), "lifetimes": ["'a"][: rng.randrange(2)], **marks()}
    param = lambda: {"name": "p", "ty_text": "&T", "ownership": "borrow_immut", **refs(), "lifetimes": []}
    fn = lambda i: {"name": f"g{i}", "impl_trait": rng.choice([None, "Run"]), "visibility": "pub", "self_kind": "ref", "is_unsafe": rng.random() < 0.5, "is_const": False, "is_async": True, "lifetime_params": ["'a"], "params": [param() for _ in range(rng.randrange(3))], "return_ty_text": rng.choice([None, "T"]), "return_ownership": rng.choice([None, "owned"]), **{f"return_{k}": v for k, v in refs().items()}, "lifetime_flows_through": rng.random() < 0.5, "unsafe_blocks": rng.randrange(3), "doc_first_line": rng.choice([None, 'says "x"\nand more']), **marks()}
    crates = {}
    for c in range(3):
        modules = {}
        for path in [[], ["", "a", "a::b"], ["x"]][c]:
            name = "::".join(x for x in (f"c{c}", path) if x)
            types = [{"name": f"T{i % 3}", "full_path": f"{name}::T{i % 3}", "kind": "struct", "visibility": "pub", "lifetime_params": [], "type_params": ["T"], "derives": ["Debug"], "fields": [field(k) for k in range(rng.randrange(3))], "methods": [fn(k) for k in range(rng.randrange(3))], "trait_impls": ["Run"], "unsafe_blocks": i, "doc_first_line": None, **marks()} for i in range(rng.randrange(5))]
            exports = [{"exposed_name": f"E{i}", "target_path": "c::E", "visibility": "pub", "kind": "named", "target_kind": rng.choice([None, "type"]), "span": span()} for i in range(rng.randrange(3))]
            modules[path] = {"path": path, "file": "src/a.rs", "unsafe_blocks": 1, "side": "both", "types": types, "functions": [fn(k) for k in range(rng.randrange(3))], "re_exports": exports}
        crates[f"c{c}"] = {"name": f"c{c}", "root": f"/r{c}", "language": "rust", "side": "both", "modules": modules}
    edges = [{"from": f"a{i}", "to": "b", "kind": "owns", "via": "struct_field", "cardinality": "one", "origin": "field f", "side": "both"} for i in range(25)]
    calls = [{"caller": f"a{i}", "callee": "b", "kind": "function", "resolution": "exact", "origin": "b()", "callsite_start_line": i, "callsite_end_line": i, "side": "base"} for i in range(7)]
    return {"crates": crates, "edges": edges, "call_edges": calls}


def test_facts_come_back_as_they_were(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps(_document(random.Random(4))))
    tables = J.read_facts(spark, str(tmp_path / "f.json"))
    assert all(t.count() for t in tables.values())
    J.write_facts(tables, str(tmp_path / "out"))
    again = J.read_facts(spark, str(tmp_path / "out"), lines=True)
    for name, t in tables.items():
        assert _rows(again[name]) == _rows(t), name
    assert J.edge_lines(tables, size=10).count() == 4
    for part in os.listdir(tmp_path / "out"):
        if part.startswith("part-"):
            for line in (tmp_path / "out" / part).read_text().splitlines():
                assert {"crates", "edges", "call_edges"} <= set(json.loads(line))


def _tour(spark, rows):
    ref = lambda x: None if x is None else {"file": x[0], "line": x[1]}
    made = []
    for name, version, subject, steps in rows:
        made.append((name, version, "title", ref(subject), None if steps is None else [{"say": s, "ref": ref(r), "arrow": None if a is None else {"from": ref(a[0]), "to": ref(a[1])}} for s, r, a in steps]))
    return spark.createDataFrame(made, T.TOURS)


def test_tours_are_taken_whole_or_refused_with_every_error(spark, tmp_path):
    spans = spark.createDataFrame([("a.rs", "m::A", 1, 10), ("a.rs", "m::A::f", 3, 5), ("b.rs", "n::B", 2, 4)], "file string, element_id string, start_line long, end_line long")
    modules = spark.createDataFrame([("a.rs", "m"), ("b.rs", "n"), ("c.rs", "o")], "file string, module_id string")
    directed = spark.createDataFrame([("m::A", "n::B"), ("m::A", "n::B"), ("m", "n")], "from_id string, to_id string")
    good = ("good", 1, ("a.rs", None), [("one", ("a.rs", 4), None), ("two", None, (("a.rs", 1), ("b.rs", 2))), ("three", None, None), ("four", ("c.rs", 7), None)])
    bad = ("bad", 1, ("no.rs", 1), [("both", ("a.rs", 1), (("a.rs", 1), ("b.rs", 2))), ("lost", ("no.rs", None), None), ("from", None, (("no.rs", 1), ("gone.rs", 2))), ("to", None, (("a.rs", 1), ("gone.rs", 2))), ("same", None, (("a.rs", 4), ("a.rs", 3))), ("back", None, (("b.rs", 2), ("a.rs", 1))), ("none", None, (("a.rs", 4), ("c.rs", None))), ("fine", None, None)])
    c = T.check(_tour(spark, [good, bad, ("old", 2, None, []), ("empty", 1, None, []), ("null", None, None, None)]), spans, modules, directed)
    assert {(r.tour, r.step, r.ref): r.msg for r in c.errors.collect()} == {
        ("bad", 0, 0): "subject: file not in index: no.rs",
        ("bad", 1, 0): "step sets both ref and arrow; pick one",
        ("bad", 2, 1): "file not in index: no.rs",
        ("bad", 3, 1): "arrow.from: file not in index: no.rs",
        ("bad", 4, 2): "arrow.to: file not in index: gone.rs",
        ("bad", 5, 0): "both ends of the arrow are the same element",
        ("bad", 6, 0): "no edge from n::B to m::A; the reverse exists",
        ("bad", 7, 0): "no edge from m::A::f to o",
        ("old", 0, 0): "schema_version 2 not supported; expected 1",
        ("empty", 0, 0): "tour has no steps",
        ("null", 0, 0): "schema_version null not supported; expected 1",
    }
    got = {(r.tour, r.step): (r.focus, [(x.id, x.kind) for x in r.refs]) for r in c.resolved.collect()}
    assert got == {("good", 0): ("element", [("m", "module")]), ("good", 1): ("element", [("m::A::f", "element")]), ("good", 2): ("arrow", [("m::A", "element"), ("n::B", "element")]), ("good", 3): ("none", []), ("good", 4): ("element", [("o", "module")])}
    path = str(tmp_path / "tours")
    assert T.ingest(c, path).count() == 11 and not os.path.exists(path)
    assert T.ingest(T.check(_tour(spark, [good]), spans, modules, directed), path).isEmpty() and spark.read.parquet(path).count() == 5


def test_steps_without_an_arrow_do_not_meet(spark, monkeypatch):
    """Steps that ask for no edge are dealt by tour and step, not under the null ends that they share."""
    spans = spark.createDataFrame([], "file string, element_id string, start_line long, end_line long")
    modules = spark.createDataFrame([("a.rs", "m"), ("b.rs", "n")], "file string, module_id string")
    directed = spark.createDataFrame([("m", "n")], "from_id string, to_id string")
    tours = _tour(spark, [(f"t{i}", 1, None, [("one", ("a.rs", None), None), ("two", None, (("a.rs", None), ("b.rs", None))), *[("say", None, None)] * 8]) for i in range(40)])
    sizes, own = {}, T.freeze

    def seen(df, name):
        sizes[name] = [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), *map(F.max, df.columns)).collect()]
        return own(df, name)

    monkeypatch.setattr(T, "freeze", seen)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert T.check(tours, spans, modules, directed).errors.isEmpty()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes["judged_steps"]) == 400 and max(sizes["judged_steps"]) < 200


def test_snapshots_merge_by_levels(spark):
    t = lambda rows: spark.createDataFrame(rows, "crate string, module_id string, full_path string, ord int, hit boolean")
    tables = lambda x: {"packages": x.select("crate").distinct(), "modules": x.select("crate", "module_id").distinct(), "types": x, "fields": x.withColumn("name", F.lit("f"))}
    base = t([("a", "a", "a::T", 0, False), ("a", "a", "a::T", 1, True), ("a", "a::x", "a::x::U", 2, False), ("gone", "gone", "gone::V", 3, False), ("a", "a", "a::W", 4, False)])
    head = t([("a", "a", "a::T", 0, False), ("new", "new", "new::V", 1, False), ("a", "a", "a::N", 2, True)])
    m = S.merge_snapshots(tables(base), tables(head))
    assert {r.crate: r.side for r in m["packages"].collect()} == {"a": "both", "gone": "base", "new": "head"}
    assert {r.module_id: r.side for r in m["modules"].collect()} == {"a": "both", "a::x": "base", "gone": "base", "new": "head"}
    sides = {("a::T", 1): "both", ("a::T", 2): "base", ("a::x::U", 1): "base", ("gone::V", 1): "base", ("a::W", 1): "both", ("new::V", 1): "head", ("a::N", 1): "head"}
    assert {(r.full_path, r.pos): r.side for r in m["types"].collect()} == sides
    assert {r.full_path: r.side for r in m["fields"].collect()} == {"a::T": "modified", "a::x::U": "base", "gone::V": "base", "a::W": "both", "new::V": "head", "a::N": "head"}
    assert S.merge_snapshots({}, {}) == {}


def test_scope_of_ownership(spark):
    types = spark.createDataFrame([("c::A", "c", "c"), ("c::B", "c", "c"), ("c::tests::H", "c::tests", "c"), ("d::A", "d", "d")], "full_path string, module_id string, crate string")
    rows = [("c::A", "c::B", "owns", "struct_field"), ("c::A", "c::A", "owns", "struct_field"), ("d::A", "c::A", "owns", "struct_field"), ("c::tests::H", "c::B", "owns", "struct_field"), ("c::B", "c::A", "owns", "enum_variant_payload"), ("c::B", "c::A", "borrows_immut", "struct_field")]
    edges = spark.createDataFrame(rows, "from_id string, to_id string, kind string, via string")
    items, owners = survey.ownership_scope(types, edges, "c")
    assert sorted(r.item for r in items.collect()) == ["c::A", "c::B"]
    assert [(r.item, r.owner, r.owner_module) for r in owners.collect()] == [("c::B", "c::A", "c")]
    assert survey.ownership_scope(types, edges, None, with_payload=True)[1].count() == 2
