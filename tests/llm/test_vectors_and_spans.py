"""Hard negatives, vector codes and repeated passages against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from common import awkward, frame
from factloom.llm import hardneg, registry, suffixdup, vectorcodes

VECTORS = "vec_id long, embedding array<float>, label int, block long, place int, rank int, score long, v string, key string, code string, n long"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, x, *[None] * 8) for i, v, x in rows], VECTORS)


def _random(seed, count, dim=16, kinds=4):
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-0.5, 0.0, 0.25, 1.0, rng.gauss(0, 0.3))) for _ in range(dim)], rng.randrange(kinds)) for i in range(count)]
    rows += [(count + i, rows[i % 7][1], rows[i % 3][2]) for i in range(count // 4)]  # equal vectors: ties
    return rows + [(5_000, None, 1), (5_001, rows[0][1], None), (5_002, [math.nan] * dim, 1), (5_003, [math.inf] + [0.0] * (dim - 1), 1), (5_004, [None] * dim, 2), (None, rows[1][1], 1)]


def _ints(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def _good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _mined(rows, every, k, low):
    own = [(i, _ints(v), x) for i, v, x in rows if i is not None and x is not None and _good(v)]
    out = []
    for n, (a, va, x) in enumerate(own):
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(va, v)), i, y) for m, (i, v, y) in enumerate(own) if m != n and len(v) == len(va))
        for p, i, _ in [s for s in scored if s[2] == x][:k]:
            hit = [s for s in scored if s[2] != x and low * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(a, i, r, s[1], -p, -s[0]) for r, s in enumerate(hit, 1)]
    return sorted(out)


@pytest.mark.parametrize(("group", "size"), [(3, 7), (512, 4096)])
def test_hard_negatives(spark, group, size):
    rows = _random(1, 200) + [(7_000, [1.0, 0.5], 1), (7_010, [1.0, 0.25], 1), (7_011, [0.9, 0.5], 2), (7_012, [], 1)]
    got = hardneg.mine(_vectors(spark, rows), F.col("vec_id") % 10 == 0, group=group, size=size)
    assert sorted(tuple(r)[:6] for r in got.collect()) == _mined(rows, 10, 5, 80)


def test_anchor_copies_stay_out_of_the_driver(spark):
    """Anchors are copied once for each place of row blocks; the copies are no broadcast and do not grow with the partitions."""
    assert [hardneg._slots(g, 600) for g in (1, 15, 600, 5000)] == [600, 40, 1, 1]
    blocks = hardneg._packed(spark.range(40).selectExpr("id", "id % 3 AS label", "id % 10 = 0 AS is_anchor", "array(id, 1L) AS v"), 7).withColumn("block", F.monotonically_increasing_id())
    anchors = hardneg._anchor_rows(blocks).withColumn("wanted", F.array().cast("array<long>"))
    plan = hardneg._meet(blocks, hardneg._grouped(anchors, F.lit(0).alias("group")), 1, 4)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan


def test_hard_negatives_at_the_edges(spark):
    assert hardneg.mine(_vectors(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    rows = [(0, [1.0], 1), (0, [1.0], 1), (1, [1.0], 1), (2, [1.0], 2), (2, [1.0], 2), (3, [-1.0], 1), (4, [0.0], 2)]  # repeated anchors and rows
    got = hardneg.mine(_vectors(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r)[:6] for r in got) == _mined(rows, 10, 5, 80)
    with pytest.raises(Exception, match="beyond"):
        hardneg.mine(_vectors(spark, [(0, [1e30], 1), (1, [1.0], 1)]), F.col("vec_id") % 10 == 0).collect()


def _coded(rows, parts, entries, rounds):
    own = sorted(((i is None, i or 0, _ints(v)), x) for i, v, x in rows if _good(v))
    w = len(own[0][0][2]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(k[2], p) for k, _ in own[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (far(cut(k[2], p), books[p][e]), e)) for p in range(parts)] for k, _ in own]
        if step == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(k[2], p) for (k, _), c in zip(own, codes) if c[p] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    error = [sum(far(cut(k[2], p), books[p][c[p]]) for p in range(parts)) for (k, _), c in zip(own, codes)]
    by = {}
    for (_, x), e in zip(own, error):
        by[x] = by.get(x, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((-1 if k[0] else k[1], "".join(f"{e:02x}" for e in c), e, by[x], sha) for (k, x), c, e in zip(own, codes, error))


@pytest.mark.parametrize(("parts", "entries", "rounds", "count"), [(4, 8, 2, 150), (2, 64, 4, 200), (16, 64, 2, 40)])
def test_vector_codes(spark, parts, entries, rounds, count):
    rows = _random(parts, count)
    got = vectorcodes.compress(_vectors(spark, rows), parts=parts, entries=entries, rounds=rounds).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, *tuple(r)[1:]) for r in got) == _coded(rows, parts, entries, rounds)


def test_bounds_spare_distances_and_change_nothing():
    rng = np.random.default_rng(3)
    x = rng.integers(-60, 60, (400, 4)) + rng.integers(0, 9, (400, 1)) * 300
    book = x[:32].copy()
    at, upper, lower, _ = vectorcodes.nearest(x, book)
    moved = book + rng.integers(-3, 4, book.shape)
    shift = np.sqrt(np.square(moved - book).sum(axis=1))
    got, up, low, computed = vectorcodes.nearest(x, moved, at, upper + shift[at], lower - shift)
    d = np.square(x[:, None] - moved[None]).sum(axis=2)
    assert (got == d.argmin(axis=1)).all() and computed < d.size / 4
    assert (low <= np.sqrt(d) + 1e-9).all() and (up + 1e-9 >= np.sqrt(d.min(axis=1))).all()


def test_vector_codes_at_the_edges(spark):
    assert vectorcodes.compress(_vectors(spark, [])).count() == 0
    assert vectorcodes.compress(_vectors(spark, [(1, None, 1)])).count() == 0
    same = [(i, [0.5] * 16, None) for i in range(70)]
    assert {(r.code, r.error, r.label_error) for r in vectorcodes.compress(_vectors(spark, same)).collect()} == {("00" * 16, 0, 0)}
    with pytest.raises(Exception, match="length"):
        vectorcodes.compress(_vectors(spark, [(1, [1.0] * 15, 1)])).collect()
    with pytest.raises(Exception, match="components"):
        vectorcodes.compress(_vectors(spark, [(i, [1.0] * 16, 1) for i in range(64)] + [(99, [1.0] * 32, 1)])).collect()
    state, books = vectorcodes.fit(_vectors(spark, _random(1, 50)), parts=4, entries=64)
    code = vectorcodes._coded(state, books).where("key = 3").first().code
    assert len(vectorcodes.decode(code, books)) == 16


def _stripped(rows, span):
    raw = [(t or "").encode() for _, t in rows]
    seen = {}
    for r in raw:
        for i in range(len(r) - span + 1):
            seen[r[i : i + span]] = seen.get(r[i : i + span], 0) + 1
    out = []
    for (k, _), r in zip(rows, raw):
        gone = [False] * len(r)
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                gone[i : i + span] = [True] * span
        kept = bytes(c for c, g in zip(r, gone) if not g)
        runs = sum(g and not b for g, b in zip(gone, [False, *gone]))
        out.append((-1 if k is None else k, len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def _held(spark, rows, **k):
    got = suffixdup.without_repeats(frame(spark, rows), content=False, **k).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got) == _stripped(rows, k.get("span", 200))


@pytest.mark.parametrize(("span", "q"), [(200, 48), (20, 5), (9, 8), (70, 3)])
def test_repeated_passages(spark, span, q):
    rng = random.Random(span)
    words = ["alpha", "beta", "é", "日本", "x" * 30, "gamma delta", "0123456789", "  ", "\n"]
    text = lambda n: "".join(rng.choice(words) + rng.choice("  .,;") for _ in range(n))
    shared = [text(span // 2) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(20))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a, b = sorted(rng.randrange(len(s)) for _ in range(2))
            parts += [s if rng.random() < 0.3 else s[a:b], text(rng.randrange(20))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + "!"), (102, None), (None, rows[4][1]), (None, rows[4][1]), (103, "a" * (span + 5)), (104, "b" * span), (105, "ab" * span), (106, rows[5][1]), (106, rows[5][1]), (107, "")]
    _held(spark, rows, span=span, q=q)


def test_repeated_passages_of_awkward_texts(spark):
    rows = [(i, t) for i, t in awkward(4, 60) if not t or len(t) < 5_000]
    _held(spark, rows)
    assert suffixdup.without_repeats(frame(spark, [])).count() == 0


def test_edges_of_repeats_are_exact(spark):
    """A passage of 200 bytes goes, one of 199 stays; contents and spans are returned."""
    rng = random.Random(7)
    noise = lambda n: "".join(chr(rng.randrange(97, 123)) for _ in range(n))
    p, short = noise(200), noise(199)
    rows = [(1, noise(300) + "1" + p + "2" + noise(90)), (2, "3" + p + "4"), (3, noise(50) + "5" + short + "6"), (4, "7" + short + "8")]
    _held(spark, rows)
    got = {r.doc_id: r for r in suffixdup.without_repeats(frame(spark, rows)).collect()}
    assert bytes(got[2].kept) == b"34" and [tuple(s) for s in got[2].spans] == [(1, 201)] and got[4].n_removed == 0


def test_a_very_long_text_is_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffixdup, "CHUNK", 1 << 10)
    suffixdup._powers.cache_clear()
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghij") for _ in range(9_000))
    own = np.concatenate([np.stack([at, lo, hi]) for at, _, lo, hi in suffixdup.suffixes(long.encode())], axis=1)
    assert own[1, 0] == 0 and own[2, -1] == len(long) - 200 and (own[1, 1:] == own[2, :-1] + 1).all()
    suffixdup._powers.cache_clear()
    _held(spark, [(1, long), (2, long[3_000:4_500]), (3, "z" * 4_000)])


def test_new_queries_agree_with_their_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ("op11_hard_negatives", "op12_vector_codes"):
        got = registry.QUERIES[name](spark, sf)
        want = con.execute(registry.ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = registry.QUERIES["op13_repeated_passages"](spark, sf).collect()
    assert sorted(tuple(r) for r in got) == _stripped([tuple(r) for r in docs], 200)
