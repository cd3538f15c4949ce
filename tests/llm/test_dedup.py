"""Exact and near deduplication, components and the pipeline against brute force."""

import random
import re
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from common import awkward, frame
from factloom.llm import exactdup, neardup
from factloom.llm.components import components


def _exact(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((i is None, i or 0, k))
    out = []
    for norm, members in groups.items():
        first = min(members)
        for null, i, k in members:
            out.append((-1 if null else i, -1 if first[0] else first[1], len(members), (null, i, k) == first, sha256(norm.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block", [8, 4096])
def test_exact_duplicates(spark, block):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", " ", "a  b", "a b", "ab" * 100, "ab" * 101, "ab" * 99 + "xa", "é😀" * 50])) for i in range(80)]
    rows += [*((1_000 + i, t) for i, t in awkward(1, 30)), (None, "a b"), (None, "only here"), (None, "only here")]
    _held(exactdup.exact_duplicates(frame(spark, rows), block=block).collect(), rows)


def test_blocks_that_share_a_digest(spark, monkeypatch):
    """With a digest that only tells lengths apart, the blocks themselves are joined."""
    weak = lambda b: F.struct(F.length(b).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"))
    named = exactdup.name_documents
    monkeypatch.setattr(exactdup, "name_documents", lambda *a: named(*a, digest=weak))
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "ab", "ba", "abcdefgh", "abcdefgx", "abcdefghabcdefgx", "abcdefgxabcdefgh", "é😀" * 9])) for i in range(60)]
    _held(exactdup.exact_duplicates(frame(spark, rows), block=8).collect(), rows)


def _held(got, rows):
    show = lambda x: -1 if x is None else x
    assert sorted((show(r.doc_id), show(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == _exact(rows)


def test_exact_names_and_empty(spark):
    assert exactdup.exact_duplicates(frame(spark, [])).count() == 0
    named = exactdup.name_documents(frame(spark, [(1, "x" * 50), (2, "x" * 50), (3, "x" * 49 + "y")]), block=4).collect()
    by = {r.doc_id: (r.level, r.name) for r in named}
    assert by[1] == by[2] != by[3]


def test_keep_first(spark):
    docs = frame(spark, [(2, "a b"), (1, "a\tb"), (3, "c"), (4, None), (5, "")])
    kept = exactdup.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4}


def test_keep_first_repeated_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a  b"), (2, "a b"), (3, "c"), (3, "d"), (4, None), (4, ""), (None, "n"), (None, "n"), (5, "z")]
    docs = frame(spark, rows).repartition(3)
    kept = exactdup.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in kept.collect())
    assert got == [(-1, "n"), (1, "a  b"), (3, "c"), (3, "d"), (4, ""), (5, "z")]


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_components(spark, bound):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(7, 7), (None, 3), (3, None)] + [(500 + i, 501 + i) for i in range(40)] + [(999, i) for i in range(600, 700)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    nodes = {x for p in links if None not in p and p[0] != p[1] for x in p}
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), bound=bound).collect()}
    assert got == {x: root(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long"), bound=bound).count() == 0


def _sets(rows, words=5):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    return out


def _near(rows, percent=85):
    sets, inv, up = _sets(rows), {}, {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i, s in sets.items():
        for y in s:
            inv.setdefault(y, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for y in s for j in inv[y] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def _copies(seed, groups=12, size=25):
    """Groups of mutated copies with many rates of change, chains, shared passages, short texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passage = some(60)
    texts = []
    for g in range(groups):
        base = some(rng.choice([6, 30, 80, 200, 400]))
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                k = rng.randrange(len(w))
                w[k] = rng.choice(words)
            texts.append(" ".join(w))
            if g % 3 == 0:
                base = w  # a chain drifts away from its first text
    texts += [" ".join([*some(rng.randint(1, 20)), *passage, *some(rng.randint(1, 20))]) for _ in range(30)]
    texts += [" ".join(some(rng.randint(1, 6))) for _ in range(20)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("rounds", [0, 8])
def test_near_duplicates(spark, rounds):
    rows = [*_copies(3), *((10_000 + i, t) for i, t in awkward(3, 20) if i != 5_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows), rounds=rounds).collect()}
    assert got == _near(rows)


def test_near_duplicate_edges(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    rows = [(1, None), (2, ""), (3, "One two"), (4, "one\ttwo"), (None, "one two"), (3, "one two"), (5, "x " * 30)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id if r.component_id is not None else -1, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect())
    assert got == [(-1, 1, 3, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True)] or got[0][0] == -1 and got[1:] == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True)]


def test_bands_follow_the_threshold():
    assert (neardup.bands_for(85), neardup.bands_for(80)) == (neardup.BANDS, 35)
    for percent in (50, 80, 85, 95):
        miss = lambda n, p=percent / 100: (1 - p**neardup.ROWS) ** n
        n = neardup.bands_for(percent)
        assert miss(n) < 1e-6 <= miss(n - 1)


def test_pipeline_stage_links_from_80_percent(spark):
    import corpus_pipeline as c

    words = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:44], "x", *words[45:95], *"abcde"]))]  # 86 of 106 shingles
    rows += [(3, " ".join(f"v{k}" for k in range(100))), (4, " ".join([*(f"v{k}" for k in range(80)), *(f"u{k}" for k in range(20))]))]  # 76 of 116
    (a, b), sets = (1, 2), _sets(rows)
    assert 0.8 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.85
    assert {r.doc_id for r in c._near(spark, frame(spark, rows), "").collect()} == {1, 3, 4}
    assert all(r.kept for r in neardup.near_duplicates(frame(spark, rows)).collect())


def test_near_duplicates_at_80_percent(spark):
    rows = _copies(7)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows), percent=80).collect()}
    assert got == _near(rows, 80)


def test_signatures():
    a, b = set(range(1000)), set(range(150, 1150))
    import numpy as np

    sig = lambda s: neardup.signature(neardup._mix(np.array(sorted(s), np.uint64)))
    x, y = sig(a), sig(b)
    assert len(x) == 2 * neardup.PERMUTATIONS
    assert abs((x == y).mean() - 850 / 1150) < 0.15


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c
    from factloom.llm import quality

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    rows = [(i, "\n".join(line(15) for _ in range(8))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200 + i, rows[10 + i][1] + " more words") for i in range(5)]
    rows += [(300 + i, " ".join(w + "***" for w in line(90).split())) for i in range(10)]
    rows += [(400, rows[20][1] + " password=abcdef123"), (401, None), (402, "short")]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0 if 300 <= i < 308 else 1) for i, _ in rows if i < 308 and i not in (0, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in c.STAGES] == ["quality rules", "exact dedup", "MinHash near-dedup", "secret scans", "best-fit packing"]
    state, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, state, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        state = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept.append({r.doc_id for r in state.select("doc_id").collect()})
        if k < 4:
            assert state.columns == docs.columns
    assert kept[0] == {i for i, t in rows if i < 300 or i == 400}
    assert kept[1] == kept[0] - {100 + i for i in range(5)}
    near = _near([(i, t) for i, t in rows if i in kept[1]])
    assert kept[2] == {i for i in kept[1] if near[i][2]} == kept[1] - {200 + i for i in range(5)} - {400}
    assert kept[3] == kept[4] == kept[2]
    run = c.run(spark, str(tmp_path))
    assert sorted(map(tuple, run.drop("sequence_id", "offset").collect())) == sorted(map(tuple, state.drop("sequence_id", "offset").collect()))
    assert quality is not None and run.where(F.col("length") > 4096).count() == 0


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Rows without a key and other texts under one key stay, a repeated row counts once, a very long text is packed whole; and an empty table gives no rows."""
    import corpus_pipeline as c
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(1, 9))) for _ in range(900)]
    text = lambda lines: "\n".join(" ".join(rng.choice(words) for _ in range(15)).capitalize() + "." for _ in range(lines))
    rows = [(i, text(8)) for i in range(12)] + [(None, text(8)), (None, text(9)), (5, text(8)), (20, text(4_000))]
    repeated = [(6, rows[6][1]), (6, rows[6][1])]
    for folder, given in (("full", [*rows, *repeated, (30, None), (31, ""), (None, None)]), ("empty", [])):
        frame(spark, given).write.parquet(str(tmp_path / folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / folder / "labels.parquet"))
    assert c.run(spark, str(tmp_path / "empty")).count() == 0
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, got = {}, {}
    for i, t in rows:
        want[i] = want.get(i, 0) + len(tok.encode(t, add_special_tokens=False).ids) + 1
    for r in c.run(spark, str(tmp_path / "full")).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert 0 < r.length <= 4096
    assert got == want
