"""Operator 4: personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are what the base patterns find: emails, addresses, cards and phone numbers. Candidates are stretches without
white space that hold a digit or an at sign, and runs of such numbers parted by single spaces. The words around an
occurrence, marks of punctuation and line ends among them, are its lexical patterns: one to three to its left, one on
both sides, and one to its left or one to three to its right together with the shape of the identifier (letters, digits
and separators); what follows says too little on its own. Patterns and instances form a graph whose scores are computed in rounds. A pattern is worth the summed
score of its known instances of one kind over that of all its known instances, a quarter for each unknown one, and a
quarter: a share, so that it means the same in a small and a large corpus, and one in which an unknown instance is no
negative but no confirmation either. An instance is worth the best of its patterns when it was first discovered (a
seed 1). A pattern is trusted when enough distinct known instances stand behind it and its worth is high; instances of
trusted patterns that no base pattern knows are discovered and vouch for further patterns. Rounds end when one
discovers nothing new. The spans found are the candidates outside base spans that a pattern trusted at the end points
at, as the kind of the best one.

Positions come from the lengths of matches and of the stretches between them, summed in order. Null and empty texts
have no spans; an empty table gives no rows. Very long texts and words are read whole. Repeated rows and keys and rows
without a key are handled row by row. Of the input only key and text are read, so other columns cannot clash. Base
matches that fail their test are dropped and not tried again. Base spans of different kinds may overlap; discovered
spans overlap no base span. Ties between kinds go to the first as listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import freeze

#: Possessive and anchored forms of the base patterns: the same matches, in time linear in the text.
BASE = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++)(?:\\.[0-9]++)(?:\\.[0-9]++)",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
_NUMBER = "[(+]*+[0-9][0-9().+/-]*+"
#: Numbers parted by single spaces, or a stretch without white space that holds a digit or an at sign.
TOKEN = f"(?<!\\S)(?:{_NUMBER}(?:\\x20{_NUMBER})*+[^\\s0-9@]*+(?!\\S)|[^\\s0-9@]*+[0-9@]\\S*+)"
#: White space within a line.
_BLANK = "[\\s&&[^\\n]]+"
KINDS = [*BASE, *(f"found_{k}" for k in BASE)]
#: Words on one side that a pattern holds at most.
WORDS = 3
_TOKEN_KIND = 99


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    value = lambda i: d.substr(i, F.lit(1)).cast("int")
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.when(i % 2 == 1, value(i)).when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _accepted(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(999)) <= 255)
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _as_kind(i: int):
    return lambda x, n: F.struct(F.lit(i).alias("kind"), n.alias("i"), *(x[c].alias(c) for c in ("gap", "len", "m", "left", "right")))


def _is_kind(i: int):
    return lambda s: s["kind"] == i


def _ends(gap: Column, last: bool) -> Column:
    """The last or first words of a stretch, as many as a pattern may hold, whatever their length."""
    words = F.split(gap, _BLANK)
    return F.array_join(F.slice(words, F.greatest(F.size(words) - WORDS, F.lit(1)) if last else F.lit(1), WORDS + 1), " ")


def _words(context: Column) -> Column:
    """Words, marks of punctuation at their edges, and line ends as ``^``; digits as one zero."""
    t = F.regexp_replace(F.regexp_replace(F.lower(context), "[0-9]+", "0"), "\\s*\\n\\s*", " ^ ")
    t = F.regexp_replace(F.regexp_replace(t, "(?<=\\S)(\\p{Punct}+)(?=\\s|$)", " $1"), "(?<=\\s|^)(\\p{Punct}+)(?=[^\\s\\p{Punct}])", "$1 ")
    return F.filter(F.split(t, "\\s+"), lambda w: w != "")


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All rows (``row``, ``key``), and one row for each match of a base pattern or candidate with its place, its
    text and, for a candidate, the words to its left and right."""
    patterns = [*((i, k, p) for i, (k, p) in enumerate(BASE.items())), (_TOKEN_KIND, "token", TOKEN)]
    none = F.array().cast("array<string>")
    t = F.col("t")
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    has = base.select("row", "key", "t", t.contains("@").alias("at"), t.rlike("[0-9]").alias("digit"))
    guard = {"email": F.col("at"), "ip": F.col("digit"), "card": F.col("digit"), "phone": F.col("digit") & t.contains("+"), "token": F.col("at") | F.col("digit")}
    found = has.select("row", "key", "t", *(F.when(guard[k], F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none).alias(k) for _, k, p in patterns))
    parts = []
    for i, k, p in patterns:
        gaps = F.when(F.size(k) > 0, F.split(t, p, -1)).otherwise(none)
        n = F.greatest(F.size(k), F.lit(0))
        around = F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n), lambda g, h: F.struct(F.length(g).alias("gap"), (_ends(g, True) if i == _TOKEN_KIND else F.lit("")).alias("left"), (_ends(h, False) if i == _TOKEN_KIND else F.lit("")).alias("right")))  # noqa: B023
        rows = F.zip_with(F.col(k), around, lambda m, g: F.struct(g["gap"].alias("gap"), F.length(m).alias("len"), m.alias("m"), g["left"].alias("left"), g["right"].alias("right")))
        parts.append(F.transform(rows, _as_kind(i)))
    whole = freeze(found.select("row", "key", F.concat(*parts).alias("occ")), "occurrences")
    one = whole.where(F.size("occ") > 0).select("row", F.explode("occ").alias("o")).select("row", "o.*")
    order = Window.partitionBy("row", "kind").orderBy("i")
    placed = one.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("len"))
    # a candidate holds a word, so the ones before and behind it hold the words that its own gap lacks
    upto, onward = F.concat("left", "m"), F.concat("m", "right")
    steps = range(1, WORDS + 1)
    left = F.concat(F.when(F.lag("m", WORDS).over(order).isNull(), F.lit("\n")).otherwise(""), *(F.coalesce(F.lag(upto, k).over(order), F.lit("")) for k in reversed(steps)), "left")
    right = F.concat("right", *(F.coalesce(F.lead(onward, k).over(order), F.lit("")) for k in steps), F.when(F.lead("m", WORDS).over(order).isNull(), F.lit("\n")).otherwise(""))
    placed = placed.withColumn("around_left", left).withColumn("around_right", right)
    good = F.lit(False)
    for i, k, _ in patterns:
        good = good | ((F.col("kind") == i) & (_accepted(k, F.col("m")) if k != "token" else F.lit(True)))
    return whole.select("row", "key"), placed.where(good).select("row", "kind", "start", "end", "m", F.col("around_left").alias("left"), F.col("around_right").alias("right"))


def _named(*parts: Column | str) -> Column:
    """A name for a pattern or instance of at most 64 characters, null if a part is: itself or its digest."""
    whole = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.when(F.length(whole) > 64, F.concat(F.lit("#"), F.sha2(whole, 256))).otherwise(whole)


def contexts(occ: DataFrame, digits: int = 4) -> DataFrame:
    """``row``, ``kind``, ``start``, ``end``, ``inst`` and ``patterns`` of seeds and of candidates outside base spans."""
    here = Window.partitionBy("row").orderBy("start", F.desc("kind"))
    base = F.col("kind") < _TOKEN_KIND
    seen = occ.withColumn("before", F.max(F.when(base, F.col("end"))).over(here.rowsBetween(Window.unboundedPreceding, -1)))
    seen = seen.withColumn("after", F.min(F.when(base, F.col("start"))).over(here.rowsBetween(0, Window.unboundedFollowing)))
    free = base | (~F.coalesce(F.col("before") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("after") < F.col("end"), F.lit(False)))
    # a base match starts inside a candidate, whose words it has, and the candidate's own characters next to it
    seen = seen.withColumn("within", F.last(F.when(~base, F.struct("start", "end", "m", "left", "right")), ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    at, past = (F.col("start") - F.col("within.start")).cast("int"), (F.col("within.end") - F.col("end")).cast("int")
    trim = lambda side, s: F.regexp_replace(s, "^[\\p{Punct}&&[^@]]+$", "") if side else s
    seen = seen.withColumn("left", F.when(base, F.concat("within.left", F.col("within.m").substr(F.lit(1), at))).otherwise(F.col("left")))
    seen = seen.withColumn("right", F.when(base, F.when(past >= 0, F.concat(trim(True, F.col("within.m").substr(F.length("within.m") - past + 1, F.greatest(past, F.lit(0)))), F.lit(" "), F.col("within.right")))).otherwise(F.col("right"))).drop("within")
    lead = F.length(F.regexp_extract("m", "^[^A-Za-z0-9@+(]*", 0))
    core = F.regexp_replace("m", "^[^A-Za-z0-9@+(]+|[^A-Za-z0-9]+$", "")
    rows = seen.where(free).select("row", "kind", (F.col("start") + F.when(base, 0).otherwise(lead)).alias("start"), _words(F.col("left")).alias("l"), _words(F.col("right")).alias("r"), F.when(base, F.col("m")).otherwise(core).alias("own"))
    rows = rows.where((F.col("kind") < _TOKEN_KIND) | F.col("own").contains("@") | (F.length(_digits(F.col("own"))) >= digits))
    shape = F.regexp_replace(F.regexp_replace("own", "[^\\p{Punct}\\s0-9]+", "a"), "[0-9]+", "0")
    l, r = F.col("l"), F.col("r")
    word = lambda side, k: F.try_element_at(side, F.lit(-k if side is l else k))
    chain = lambda side, k: [x for j in range(1, k + 1) for x in ("\t", word(side, j))]
    made = [_named(f"L{k}", *chain(l, k)) for k in range(1, WORDS + 1)] + [_named(f"R{k}", *chain(r, k), "\t", shape) for k in range(1, WORDS + 1)]
    made += [_named("LR", *chain(l, 1), *chain(r, 1)), _named("LS", *chain(l, 1), "\t", shape)]
    return rows.select("row", "kind", "start", (F.col("start") + F.length("own")).alias("end"), _named(F.col("own")).alias("inst"), F.filter(F.array(*made), lambda p: p.isNotNull()).alias("patterns"))


def discover(occ: DataFrame, support: int = 5, trust: float = 0.9, digits: int = 4) -> DataFrame:
    """``row``, ``kind``, ``start``, ``end`` of candidates outside base spans that trusted patterns point at.

    ``support``: distinct instances already known that a trusted pattern needs. ``trust``: least pattern worth.
    ``digits``: least digits of a discovered candidate without an at sign."""
    rows = freeze(contexts(occ, digits), "contexts")
    # one edge for each pattern and instance, however often they meet
    edges = freeze(rows.select(F.explode("patterns").alias("pattern"), "inst", "kind").groupBy("pattern", "inst").agg(F.min("kind").alias("kind")), "edges")
    score = freeze(edges.groupBy("inst").agg(F.min("kind").alias("k")).select("inst", F.when(F.col("k") < _TOKEN_KIND, 1.0).otherwise(0.0).alias("score"), "k"), "scores")
    known, count = -1, score.where("score > 0").count()
    kinds = range(len(BASE))
    while count > known:  # every round but the last discovers an instance
        scored = edges.join(score.withColumnRenamed("inst", "of"), F.col("inst") == F.col("of"))
        per = scored.groupBy("pattern").agg(F.count_if(F.col("score") == 0).alias("unknown"), *(F.count_if((F.col("k") == i) & (F.col("score") > 0)).alias(f"n{i}") for i in kinds), *(F.sum(F.when(F.col("k") == i, F.col("score")).otherwise(0.0)).alias(f"v{i}") for i in kinds))
        best = F.greatest(*(f"v{i}" for i in kinds))
        pick, behind = F.lit(None).cast("int"), F.lit(0).cast("long")
        for i in reversed(kinds):
            pick, behind = F.when(F.col(f"v{i}") == best, F.lit(i)).otherwise(pick), F.when(F.col(f"v{i}") == best, F.col(f"n{i}")).otherwise(behind)
        per = per.withColumn("worth", best / (sum(F.col(f"v{i}") for i in kinds) + F.col("unknown") / 4 + 0.25))
        patterns = freeze(per.where((behind >= support) & (F.col("worth") >= trust)).select(F.col("pattern").alias("p"), "worth", pick.alias("as_kind")), "patterns")
        through = edges.join(patterns, F.col("pattern") == F.col("p")).groupBy("inst").agg(F.max(F.struct("worth", (-F.col("as_kind")).alias("less"))).alias("best"))
        through = freeze(through.select(F.col("inst").alias("of"), F.col("best.worth").alias("best"), (-F.col("best.less")).alias("as_kind")), "through")
        new = F.col("score") == 0
        score = score.join(through, F.col("inst") == F.col("of"), "left").select("inst", F.when(new, F.coalesce("best", F.lit(0.0))).otherwise(F.col("score")).alias("score"), F.when(new, F.coalesce("as_kind", "k")).otherwise(F.col("k")).alias("k"))
        score = freeze(score, "scores")
        known, count = count, score.where("score > 0").count()
    pointed = rows.where(F.col("kind") == _TOKEN_KIND).select("row", "start", "end", F.explode("patterns").alias("pattern")).join(patterns, F.col("pattern") == F.col("p"))
    pointed = pointed.groupBy("row", "start", "end").agg(F.max(F.struct("worth", (-F.col("as_kind")).alias("less"))).alias("best"))
    return pointed.select("row", (len(BASE) - F.col("best.less")).alias("kind"), "start", "end")


def withheld(docs: DataFrame, share: float = 0.2, key: str = "doc_id", text: str = "text", **how) -> dict[str, int]:
    """How discovery fares on seeds it does not know: a share of all base instances, chosen by a hash of their text, is
    treated as unknown. Counts of ``hidden`` spans, of those ``found`` again with their kind, and of ``wrong`` spans,
    that is all other discovered spans."""
    occ = freeze(occurrences(docs, key, text)[1], "placed")
    hide = (F.col("kind") < _TOKEN_KIND) & (F.pmod(F.xxhash64("m"), F.lit(1000)) < int(1000 * share))
    hidden = occ.where(hide).select(F.col("row").alias("of"), F.col("kind").alias("was"), F.col("start").alias("s"), F.col("end").alias("e"))
    found = freeze(discover(occ.where(~hide), **how), "found")
    hit = found.join(hidden, (F.col("row") == F.col("of")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")) & (F.col("kind") == F.col("was") + len(BASE)))
    right = hit.select("row", "start", "end").distinct().count()
    return {"hidden": hidden.count(), "found": hit.select("of", "was", "s", "e").distinct().count(), "wrong": found.count() - right}


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per input row: ``key`` and ``pii_spans``, an array of (start, kind number, end) in that order."""
    rows, occ = occurrences(docs, key, text)
    occ = freeze(occ, "placed")
    spans = occ.where(F.col("kind") < _TOKEN_KIND).select("row", "kind", "start", "end").unionByName(discover(occ, **how))
    lists = spans.groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))
    empty = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    return rows.join(lists, F.col("row") == F.col("of"), "left").select(F.col("key").alias(key), F.coalesce("s", empty).alias("pii_spans"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii_spans", lambda s: s["kind"] < len(BASE))
    n = [F.size(F.filter("pii_spans", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select(key, *n, F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("pii_spans")).alias("spans"))
