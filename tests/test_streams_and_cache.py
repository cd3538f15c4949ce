"""Reachable sets, incremental extraction, signed changes and keyed streaming state."""

import json
import os
import random
import time
import uuid
from collections import Counter

import pandas as pd

from factloom.operators import graph as G
from factloom.session import freeze, shared_dir
from factloom.sources import extract as X
from factloom.sources import incremental as I
from factloom.streaming import deltas, subscribers
from factloom.streaming.feed import SnapshotStore


def _reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    sets = {}
    for n in out:
        seen, todo = set(), list(out[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        sets[n] = seen
    return sets


def test_reachable_sets(spark):
    rng = random.Random(1)
    n = 30
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(34)] + [(100 + i, 101 + i) for i in range(4)] + [(3, 3), (50, 50)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = _reach(edges)
    got = {r.node: r.size for r in G.closure_size(df, spark.createDataFrame([(i,) for i in [*want, 999]], "node long")).collect()}
    assert got == {k: len(v - {k}) for k, v in want.items()} | {999: 0}
    pairs = [(rng.choice(list(want)), rng.choice(list(want))) for _ in range(60)] + [(3, 3), (50, 50), (100, 104), (104, 100), (999, 3)]
    hit = {(r.src, r.dst): r.reached for r in G.reaches(spark.createDataFrame(pairs, "src long, dst long"), df).collect()}
    assert hit == {(a, b): b in want.get(a, ()) for a, b in pairs}


def test_reachable_sets_by_every_route(spark, monkeypatch):
    # rows of three members, and sets that become bitmaps by their size, by what they gather and by a dense successor
    for name, value in (("CHUNK", 3), ("GATHER", 12), ("FEW", 6)):
        monkeypatch.setattr(G, name, value)
    rng = random.Random(2)
    edges = [(rng.randrange(24), rng.randrange(24)) for _ in range(26)] + [(100 + i, 101 + i) for i in range(9)] + [(200, 300 + i) for i in range(14)] + [(199, 200), (100, 3), (7, 7)]
    edges += [(400 + i, 400 + (i + 1) % 14) for i in range(14)] + [(400, 500), (398, 405)]
    df, want = spark.createDataFrame(edges, "src long, dst long"), _reach(edges)
    assert {r.node: r.size for r in G.closure_size(df).collect()} == {k: len(v - {k}) for k, v in want.items()}
    pairs = [(rng.choice(list(want)), rng.choice(list(want))) for _ in range(90)] + [(100, 109), (109, 100), (199, 313), (398, 500), (500, 398), (410, 410), (7, 7), (109, 109)]
    hit = sorted((r.src, r.dst, r.reached) for r in G.reaches(spark.createDataFrame(pairs, "src long, dst long"), df).collect())
    assert hit == sorted((a, b, b in want[a]) for a, b in pairs)


def test_reachable_sets_take_room_by_their_members(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(G, "freeze", lambda df, name: tables.append(freeze(df, name)) or tables[-1])
    edges = spark.range(1500).selectExpr("id AS src", "1500 + (id * 7919) % 1500 AS dst")
    assert G.closure_size(edges).groupBy("size").count().sort("size").collect() == [(0, 1500), (1, 1500)]
    room = {"bits": "octet_length(bits)", "few": "4 * size(few)"}
    taken = sum(t.selectExpr(f"sum({how})").first()[0] or 0 for t in tables for c, how in room.items() if c in t.columns)
    assert taken <= 3000 * 8


def _write(root, name, text, at=None):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    if at:
        os.utime(path, (at, at))


def _rows(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.collect())


def _equal(spark, root, facts):
    whole = X.extract(spark, root)
    for t in I.TABLES:
        assert _rows(getattr(facts, t)) == _rows(getattr(whole, t)), t


def test_only_changed_files_are_parsed(spark, tmp_path):
    root, cache = str(tmp_path / "tree"), str(tmp_path / "cache")
    _write(root, "Cargo.toml", '[package]\nname = "app"\n')
    _write(root, "src/lib.rs", "pub mod a;\npub struct Engine { p: a::Piston, w: Wheel }\nimpl Engine { pub fn go(&self) { a::make(); } }\n")
    _write(root, "src/a.rs", "pub struct Piston;\npub fn make() -> Piston { Piston }\n")
    _write(root, "src/b.rs", "pub struct Wheel;\n")
    _write(root, "target/src_gen.rs", "pub struct Hidden;\n")
    first = I.extract_incremental(spark, root, cache)
    assert (first.parsed, first.resolved) == (3, True)

    again = I.extract_incremental(spark, root, cache)
    assert (again.parsed, again.resolved, again.version) == (0, False, first.version)
    assert _rows(again.facts.edges) == _rows(first.facts.edges)

    _write(root, "src/b.rs", "pub struct Whee1;\n", os.stat(f"{root}/src/b.rs").st_mtime + 0.25)  # same length, within a second
    os.remove(f"{root}/src/a.rs")
    _write(root, "src/c.rs", "pub struct Piston;\npub struct Rim { e: crate::Engine }\n")
    mixed = I.extract_incremental(spark, root, cache)
    assert (mixed.parsed, mixed.resolved) == (2, True)
    _equal(spark, root, mixed.facts)

    os.remove(f"{root}/src/c.rs")
    _write(root, "Cargo.toml", '[package]\nname = "other"\n')  # each file's key holds its crate
    last = I.extract_incremental(spark, root, cache)
    assert (last.parsed, last.resolved) == (2, True)
    assert sorted(r.full_path for r in last.facts.types.collect()) == ["other::Engine", "other::b::Whee1"]
    assert I.cache_folder(cache, root) != I.cache_folder(cache, root + "2") != I.cache_folder(cache, root + "2", "rust")


def test_pruned_folders_are_not_opened(spark, tmp_path):
    root = str(tmp_path / "a b+c%d")
    for name in ("src/x.rs", "target/y.rs", "node_modules/z.ts", "ui/w.ts"):
        _write(root, name, "// text")
    df = X.list_files(spark, root)
    assert sorted(r.rel for r in df.collect()) == ["src/x.rs", "ui/w.ts"]
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    assert _metric(plan, "numFiles") == 2
    uri = df.where("rel = 'ui/w.ts'").first().uri
    assert [r.rel for r in X.list_files(spark, root, only=[uri]).collect()] == ["ui/w.ts"]


def _metric(plan, name):
    if plan.metrics().contains(name):
        return plan.metrics().apply(name).value()
    return next((m for i in range(plan.children().size()) if (m := _metric(plan.children().apply(i), name)) is not None), None)


def _place(spark):
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def test_views_follow_signed_changes(spark):
    rng = random.Random(5)
    place, state = _place(spark), {}
    views = deltas.DeltaViews(SnapshotStore(spark, f"{place}/views"), "kind string, via string, size long", {"by_kind": (["kind"], ["size"]), "by_both": (["kind", "via"], [])})
    for step in range(4):
        batch = []
        for f in rng.sample(range(12), 8):
            rows = None if rng.random() < 0.25 else [{"kind": rng.choice("ab"), "via": rng.choice("xyz"), "size": rng.randrange(5)} for _ in range(rng.randrange(4))]
            batch.append((f, step, json.dumps([{"kind": "never"}])))  # an older version in the same batch
            batch.append((f, step + 1, None if rows is None else json.dumps(rows)))
            state[f] = rows or []
        if step == 2:
            batch.append((3, 0, json.dumps([{"kind": "late", "via": "x", "size": 9}])))
        spark.createDataFrame(batch, "file long, version long, rows string").repartition(2).write.mode("append").parquet(f"{place}/feed")
        feed = spark.readStream.schema("file long, version long, rows string").parquet(f"{place}/feed")
        deltas.follow_views(feed, views, f"{place}/checkpoint").awaitTermination()
        rows = [r for rs in state.values() for r in rs]
        assert {r.kind: (r.n, r["size"]) for r in views.store.read("by_kind").collect()} == {k: (n, sum(r["size"] for r in rows if r["kind"] == k)) for k, n in Counter(r["kind"] for r in rows).items()}
        assert {(r.kind, r.via): r.n for r in views.store.read("by_both").collect()} == Counter((r["kind"], r["via"]) for r in rows)
    current, epoch = views.store.current(), views.store.read("applied").first().epoch
    assert views.apply(spark.createDataFrame([(1, '{"kind": "a"}', 1)], "file long, row string, weight long"), epoch) is None
    assert views.store.current() == current


def _mailboxes(events, capacity):
    held, out = {}, []
    for s, at, e, poll in sorted(events, key=lambda x: (x[1], x[2])):
        if not poll:
            held.setdefault(s, []).append(e)
            continue
        box = held.pop(s, [])
        if len(box) > capacity:
            out.append((s, e, 0, None, len(box) - capacity))
        out += [(s, e, k, x, 0) for k, x in enumerate(box[-capacity:], 1)]
    return sorted(out, key=str)


def test_slow_subscribers_get_one_resync(spark):
    rng = random.Random(8)
    events = [(rng.randrange(4), t // 2, t, rng.random() < 0.06) for t in range(400)]
    place, schema = _place(spark), "subscriber long, at long, event_id long, poll boolean"
    for part in (events[:150], events[150:]):
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(f"{place}/feed")
        feed = spark.readStream.schema(schema).parquet(f"{place}/feed")
        q = subscribers.bounded_delivery(feed).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{place}/out")).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(f"{place}/out").collect()), key=str)
    assert got == _mailboxes(events, 16) and any(r[3] is None for r in got)


def test_reloads_coalesce(spark):
    rng = random.Random(9)
    requests = sorted((rng.randrange(3), rng.randrange(600)) for _ in range(120))
    requests += [(0, 5_000), (9, 7)]
    want = []
    for s in {r[0] for r in requests}:
        until, queued = -1, False
        for t in [*sorted(t for k, t in requests if k == s), None]:
            if queued and (t is None or until <= t):
                want.append((s, until, True))
                until, queued = until + 20, False
            if t is not None and t < until:
                queued = True
            elif t is not None:
                want.append((s, t, False))
                until = t + 20
    place = _place(spark)
    for low, high in ((0, 300), (300, 10_000)):
        spark.createDataFrame([r for r in requests if low <= r[1] < high], "subscriber long, t long").selectExpr("subscriber", "timestamp_seconds(t) AS ts").write.mode("append").parquet(f"{place}/feed")
        feed = spark.readStream.schema("subscriber long, ts timestamp").parquet(f"{place}/feed")
        q = subscribers.coalesced_reloads(feed, 20_000).writeStream.format("parquet").outputMode("append").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.subscriber, r.start_ms // 1000, r.queued) for r in spark.read.parquet(f"{place}/out").collect())
    assert (sorted(set(got) - set(want)), sorted(set(want) - set(got))) == ([], []) and got == sorted(want)


class _Handle:
    """State of one bucket in memory."""

    def getMapState(self, *_):
        self.held = {}
        self.exists, self.getValue, self.updateValue = lambda: bool(self.held), self.held.get, self.held.__setitem__
        return self


def test_a_call_of_a_keyed_processor_serves_many_keys():
    p, handle = deltas._Changes(), _Handle()
    p.init(handle)
    one = lambda v: pd.DataFrame({"file": ["a", "b", None], "version": [v] * 3, "rows": ['[{"n": %d}]' % v, '[{"n": 0}]', None]})
    rows = lambda v: sorted(map(tuple, pd.concat(p.handleInputRows((0,), iter([one(v)]), None))[["file", "row", "weight"]].values.tolist()))
    assert rows(1) == [("a", '{"n": 1}', 1), ("b", '{"n": 0}', 1)]
    assert rows(2) == [("a", '{"n": 1}', -1), ("a", '{"n": 2}', 1)] and rows(2) == []
    assert set(handle.held) == {("a",), ("b",), (None,)}
    m, handle = subscribers._Mailbox(1), _Handle()
    m.init(handle)
    parts = [pd.DataFrame({"subscriber": ["a", "b", "a"], "at": [3, 1, 1], "event_id": [3, 5, 1], "poll": [True, True, False]}), pd.DataFrame({"subscriber": ["a", "b"], "at": [2, 2], "event_id": [2, 6], "poll": [False, False]})]
    got = pd.concat(m.handleInputRows((0,), iter(parts), None))
    assert [tuple(None if x is pd.NA else x for x in r) for r in got.itertuples(index=False)] == [("a", 3, 0, None, 1), ("a", 3, 1, 2, 0)]
    assert handle.held == {("a",): ("[]", 0), ("b",): ("[6]", 0)}


def test_keys_of_a_bucket_stay_apart(spark):
    keys, place = [*range(40), *(2**53 + i for i in range(40)), None], _place(spark)
    for version in (1, 2):
        rows = [(k, version, json.dumps([{"n": version if k is None or k % 3 == 0 else 0}])) for k in keys]
        spark.createDataFrame(rows, "file long, version long, rows string").write.mode("append").parquet(f"{place}/feed")
        feed = spark.readStream.schema("file long, version long, rows string").parquet(f"{place}/feed")
        sink = deltas.signed_changes(feed).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{place}/out/epoch={n}"))
        sink.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    changed = [k for k in keys if k is None or k % 3 == 0]
    want = Counter([(k, '{"n": 0}', 1) for k in keys if k not in changed] + [(k, '{"n": %d}' % n, w) for k in changed for n, w in ((1, 1), (1, -1), (2, 1))])
    assert Counter(tuple(r) for r in spark.read.parquet(f"{place}/out").select("file", "row", "weight").collect()) == want
