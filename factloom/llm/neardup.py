"""Operator 5: near-duplicates by min-max hashing.

A text's set holds its distinct shingles of ``words`` words (ASCII letters lower-cased, words parted by ASCII
white space; a text with fewer words has its whole sequence as the one shingle). Every permutation yields two
signature values, its minimum and its maximum, so half as many hashes are computed. Bands of values name
buckets; texts that share a bucket are candidates, and a link is made only after counting both full sets.

Texts with equal sets collapse into one class first. Inside a bucket, candidates are compared with one member
in each round, with another member each time, and only members whose components still differ go on; the rounds
end when one links few of the pairs it compares. What is left, members outside the largest component of their bucket, is compared with all
candidates of other components that share a rare shingle early enough to reach the threshold, which loses no link.
So candidate pairs end in one component, are compared, or cannot be similar, without making all pairs of a group. The number of bands of 5 values follows from the threshold: a pair at it shares no bucket with probability
below 1e-6 (24 bands at 0.85, 35 at 0.8).

Null and empty texts have an empty set and link with nothing. Rows without a key link with nothing and have a
null component. Rows that share a key are one node with several texts. Ties go to the smaller key. Keys are integers. A
very long text is one set, read whole. An empty table gives no rows. Columns of the input other than key and text are
not looked at, whatever their names.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.session import freeze, ship

PERMUTATIONS, BANDS, ROWS = 60, 24, 5
_SLOTS = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    from xxhash import xxh3_64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, w), np.uint64, len(w))
    n = min(words, len(w))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        acc = acc * _P + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(acc))


def _hashers(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, permutations, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, permutations, np.uint64)


def bands_for(percent: int, rows: int = ROWS, miss: float = 1e-6) -> int:
    """Least number of bands with which a pair at the threshold shares no bucket with probability below ``miss``."""
    return 1 if percent >= 100 else int(np.log(miss) / np.log1p(-((percent / 100) ** rows))) + 1


def signature(sets: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """All minima, then all maxima, as unsigned 32-bit values."""
    a, b = _hashers(permutations)
    lo, hi = np.full(permutations, 0xFFFFFFFF, np.uint32), np.zeros(permutations, np.uint32)
    for at in range(0, len(sets), 2048):
        v = ((sets[at : at + 2048, None] * a + b) >> np.uint64(32)).astype(np.uint32)
        np.minimum(lo, v.min(axis=0), out=lo)
        np.maximum(hi, v.max(axis=0), out=hi)
    return np.concatenate((lo, hi))


def sketch(docs: DataFrame, key: str, text: str, words: int, n_bands: int = BANDS) -> DataFrame:
    """``doc``, set size, identity of the set (null when empty), band names and the signature of every row."""
    kind = docs.schema[key].dataType.simpleString()
    permutations = -(-n_bands * ROWS // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        for b in batches:
            n, ident, bands, sigs = [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), words)
                n.append(len(s))
                if not len(s):
                    ident.append(None), bands.append([]), sigs.append(None)
                    continue
                sig = signature(s, permutations)
                ident.append(xxh3_128_digest(s.tobytes()))
                bands.append([xxh3_64_intdigest(sig[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(n_bands)])
                sigs.append(sig.astype("<u4").tobytes())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ident, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "n", "ident", "bands", "sig"])

    return docs.select(key, text).mapInArrow(run, f"doc {kind}, n long, ident binary, bands array<long>, sig binary")


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(i: int, t: str) -> np.ndarray:
            got = kept.get((i, len(t)))
            if got is None:
                got = kept[(i, len(t))] = shingles(t, words)
                if len(kept) > 64:
                    kept.popitem(last=False)
            return got

        for batch in batches:
            hit = []
            for i, (a, b, ta, tb) in enumerate(zip(*(batch.column(c) for c in range(4)), strict=True)):
                x, y = of(a.as_py(), ta.as_py()), of(b.as_py(), tb.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    hit.append(i)
            hit = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(hit), batch.column(1).take(hit)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def _sharing(texts: DataFrame, side: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components, ``a`` marked ``out``, that can still reach the threshold.

    In one order of all shingles, rare ones first, two sets that are similar enough share an element that stands so
    early in both that the rest of each still allows the overlap they need. That holds for any order. Rarity only
    keeps the lists of common elements apart; it comes from a table of ``_SLOTS`` counters, whatever the input."""

    slot_of = lambda s: (s % np.uint64(_SLOTS)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SLOTS, np.int64)
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for t in b.column(0):
                held.append(slot_of(shingles(t.as_py(), words)))
                size += len(held[-1])
                if size > _SLOTS:
                    total += np.bincount(np.concatenate(held), minlength=_SLOTS)
                    held.clear()
                    size = 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=_SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    counted = texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # _SLOTS rows at most
    seen = np.zeros(_SLOTS, np.uint32)
    seen[counted.column("slot").to_numpy()] = counted.column("n").to_numpy().clip(max=0xFFFFFFFF)

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, first = [], []
            for t in b.column(1):
                s = shingles(t.as_py(), words)
                s = s[np.lexsort((s, seen[slot_of(s)]))]
                n.append(len(s))
                first.append(s[: len(s) + percent * len(s) // -100 + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(first, pa.list_(pa.int64()))], names=["doc", "n", "first"])

    kind = texts.schema["doc"].dataType.simpleString()
    rows = texts.mapInArrow(early, f"doc {kind}, n long, first array<long>").join(side.withColumnRenamed("doc", "d"), F.col("doc") == F.col("d"))
    rows = freeze(rows.select("doc", "n", "comp", "out", "first"), "early")
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice("first", F.lit(1), F.greatest(F.size("first") - 1, F.lit(0))))
    each = F.posexplode(F.arrays_zip(F.col("first").alias("s"), before.alias("r")))
    a = rows.where("out").select("doc", "n", "comp", each.alias("p", "z")).select(F.col("z.s").alias("s"), F.col("z.r").alias("ra"), F.col("p").alias("pa"), F.col("doc").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    b = rows.select("doc", "n", "comp", "out", each.alias("p", "z")).select(F.col("z.s").alias("s2"), F.col("z.r").alias("rb"), F.col("p").alias("pb"), F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("out").alias("ob"))
    # a pair once, and not again for elements that follow a shared one: its first shared element decides
    fits = F.expr(f"ca <> cb and (not ob or a < b) and not coalesce(ra = rb, false) and 100 * least(na, nb) >= {percent} * greatest(na, nb) and {100 + percent} * least(na - pa, nb - pb) >= {percent} * (na + nb)")
    return a.join(b, (F.col("s") == F.col("s2")) & fits).select("a", "b")


def _plausible(pairs: DataFrame, sigs: DataFrame, percent: int, n_bands: int = BANDS) -> DataFrame:
    """Pairs whose signatures agree up to six standard deviations below the threshold. The minimum and the maximum under a
    permutation need not be independent (of a set of one they are equal); the mean of both varies no more than that of either, so the
    deviation is that of one value for each permutation. A pair at the threshold is lost with probability below 1e-7."""
    j = percent / 100
    least = j - 6 * (j * (1 - j) / (n_bands * ROWS / 2)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([(np.frombuffer(x.as_py(), "<u4") == np.frombuffer(y.as_py(), "<u4")).mean() >= least for x, y in zip(b.column(2), b.column(3), strict=True)], pa.bool_())
            yield b.select(["a", "b"]).filter(keep)

    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(sigs.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("doc").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 85, rounds: int = 8) -> DataFrame:
    """One row per input row: ``key``, ``n_shingles``, ``component_id`` and ``kept``."""
    spark = docs.sparkSession
    ship(spark)
    n_bands = bands_for(percent)
    rows = freeze(sketch(docs, key, text, words, n_bands), "sketch")
    least = rows.where("ident is not null and doc is not null").groupBy("ident").agg(F.min("doc").alias("rep"))
    least = freeze(least, "classes").withColumnRenamed("ident", "of")
    own = F.col("doc") == F.col("rep")
    member = rows.join(least, F.col("ident") == F.col("of"), "left").select("doc", "n", "rep", F.when(own, F.col("bands")).alias("bands"), F.when(own, F.col("sig")).alias("sig"))
    member = freeze(member, "members")
    classes = member.where("doc = rep")
    named = classes.select("doc", "n", F.posexplode("bands").alias("band", "name"))
    crowded = named.groupBy("band", "name").agg(F.min("doc").alias("lead"), F.max("doc").alias("hi"), F.min_by("n", "doc").alias("lead_n")).where("lead <> hi").select("band", "name", "lead", "lead_n")
    crowded = freeze(crowded, "crowded")
    state = freeze(named.join(crowded.select("band", "name"), ["band", "name"], "left_semi").withColumn("comp", F.col("doc")), "buckets")
    wanted = freeze(state.select(F.col("doc").alias("w")).distinct(), "wanted")
    texts = freeze(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("text is not null").join(wanted, F.col("doc") == F.col("w"), "left_semi"), "texts")
    near = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    links, labels, fruitful = None, None, True
    for turn in range(rounds + 1):
        if turn == 0:  # every bucket against its smallest member
            lead = crowded.select("band", "name", F.col("lead").alias("b"), F.col("lead_n").alias("nb"))
            pairs = state.select("band", "name", F.col("doc").alias("a"), F.col("n").alias("na")).join(lead, ["band", "name"]).where("a <> b").where(near).select(*ends).distinct()
            last = False
        else:
            named_as = labels.select("node", "label")
            state = state.drop("comp").join(named_as, F.col("doc") == F.col("node"), "left").select("band", "name", "doc", "n", F.coalesce("label", "doc").alias("comp"))
            state = freeze(state, "state")
            parts = state.groupBy("band", "name", "comp").agg(F.count("*").alias("size"))
            order = F.struct(F.xxhash64("doc", F.lit(turn)).alias("place"), "doc", "n", "comp")
            lead = state.groupBy("band", "name").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(order).alias("lead")).where("lo <> hi")
            largest = parts.groupBy("band", "name").agg(F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("all"))
            mixed = lead.join(largest, ["band", "name"]).select("band", "name", F.col("top.comp").alias("main"), F.col("top.size").alias("main_size"), "all", F.col("lead.doc").alias("b"), F.col("lead.n").alias("nb"), F.col("lead.comp").alias("cb"))
            mixed = freeze(mixed, "mixed")
            left = mixed.agg(F.sum((F.col("all") - F.col("main_size")) * F.col("all")), F.sum("all")).first()
            if not left[1]:
                break
            state = freeze(state.join(mixed.select("band", "name"), ["band", "name"], "left_semi"), "mixed_rows")
            last = turn == rounds or not fruitful or left[0] <= 8 * left[1]
            if last:
                side = state.join(mixed.select("band", "name", "main"), ["band", "name"])
                side = side.groupBy("doc").agg(F.min("comp").alias("comp"), F.max(F.col("comp") != F.col("main")).alias("out"))
                pairs = _plausible(freeze(_sharing(texts, freeze(side, "side"), words, percent).select(*ends).distinct(), "pairs"), classes, percent, n_bands)
            else:  # against another member of another component
                against = mixed.select("band", "name", "b", "nb", "cb")
                pairs = state.select("band", "name", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca")).join(against, ["band", "name"]).where("ca <> cb").where(near)
                pairs = pairs.select(*ends).distinct()
        if not last:
            pairs = freeze(pairs, "pairs")
        found = freeze(_confirm(pairs, texts, words, percent), "confirmed")
        fruitful = last or turn == 0 or 20 * found.count() >= pairs.count()
        links = found if links is None else links.union(found)
        labels = freeze(components(links), "labels")
        if last:
            break
    out = member.select(F.col("doc"), F.col("n").alias("n_shingles"), "rep")
    if labels is None:
        comp = F.coalesce("rep", "doc")
    else:
        out = out.join(labels.select(F.col("node"), F.col("label")), F.col("rep") == F.col("node"), "left")
        comp = F.coalesce("label", "rep", "doc")
    return out.select(F.col("doc").alias(key), "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc") == comp, F.lit(True)).alias("kept"))


#: All pairs of a shared shingle, counted; reachable keys by recursion.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents) x),
g AS (SELECT DISTINCT doc_id, CASE WHEN n < 5 THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS shingle FROM w WHERE n >= 5 OR i >= 1 WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY i = 1 OR i <= n - 4),
k AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN k ka ON ka.doc_id = a JOIN k kb ON kb.doc_id = b WHERE 100 * c >= 85 * (ka.n + kb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(k.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
