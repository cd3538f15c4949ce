"""Operator 6: exact deduplication by deterministic block naming, in DataFrame functions only.

A text, its white space runs made one space, is cut into blocks of ``block`` characters. The distinct blocks are
sorted and numbered; then adjacent names are paired, the distinct pairs sorted and numbered, and so on, until
each document has one name. Two documents have the same name at the same level exactly if their texts are equal.

Blocks travel once, in the distinct step, where copies meet before the shuffle. Back to the documents go names,
over a 128-bit digest of the block; a digest that two different blocks share shows as two rows of the name table
and makes that run write the blocks beside their rows and join on them, so no name rests on a digest. Names are written out at every
level, so a lost executor cannot renumber them. Every join is against a written table with one row per key,
which lets Spark split a hot key.

Null text counts as empty; all empty texts are one group. ``keep_id`` is the smallest key of a group; if that
key repeats within it, one of its rows stays. A null key is larger than any other. A very long text is many blocks and as
many rounds more as its length doubles. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import freeze

BLOCK = 4096
WHITE = "[\\x20\\x09-\\x0D]+"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), WHITE, " ")


def _blocks(text: Column, block: int) -> Column:
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))


def _digest(b: Column) -> Column:
    return F.struct(F.xxhash64(b).alias("d1"), F.xxhash64(F.lit(1), b).alias("d2"))


def _numbered(distinct: DataFrame, order: list[str], keep: list[str], name: str) -> DataFrame:
    """Sorted numbers for distinct rows: a shuffle partition holds the same rows in the same order whenever it is
    computed, and its number leads."""
    return freeze(distinct.sortWithinPartitions(*order).select(*keep, F.monotonically_increasing_id().alias("name")), name)


def name_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, digest: Callable[[Column], Column] = _digest) -> DataFrame:
    """One row per input row: ``row``, ``key``, ``text_sha256`` and the identity (``level``, ``name``). ``digest`` gives
    the fields ``d1`` and ``d2`` of a block."""
    norm = docs.select(F.col(key).alias("key"), normalised(text).alias("t"))
    cut = norm.select("key", F.sha2(F.col("t").cast("binary"), 256).alias("sha"), _blocks(F.col("t"), block).alias("b"))
    rows = freeze(cut.select(F.monotonically_increasing_id().alias("row"), "key", "sha", F.transform("b", digest).alias("digests")), "digests")
    single = norm.select(F.explode(_blocks(F.col("t"), block)).alias("b")).select("b", digest(F.col("b")).alias("d"))
    distinct = single.select("d.d1", "d.d2", "b").distinct()
    names = _numbered(distinct, ["b"], ["d1", "d2"], "names")
    at = rows.select("row", F.size("digests").alias("n"), F.posexplode("digests").alias("pos", "d")).select("row", "n", "pos", "d.d1", "d.d2")
    if names.groupBy("d1", "d2").count().where("count > 1").isEmpty():
        level = at.join(names.withColumnRenamed("d1", "e1").withColumnRenamed("d2", "e2"), (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    else:
        names = _numbered(distinct, ["b"], ["b"], "names").withColumnRenamed("b", "own")
        # numbered anew: another reading of the input need not give the rows their old numbers
        whole = freeze(cut.select(F.monotonically_increasing_id().alias("row"), "key", "sha", "b"), "blocks")
        rows = whole.drop("b")
        level = whole.select("row", F.size("b").alias("n"), F.posexplode("b").alias("pos", "b")).join(names, F.col("b") == F.col("own"))
    level = freeze(level.select("row", "n", "pos", "name"), "level")
    done = level.where("n = 1").select("row", F.lit(0).alias("level"), "name")
    depth = 0
    level = level.where("n > 1")
    while not level.isEmpty():
        depth += 1
        half = F.col("pos") % 2 == 0
        pairs = level.groupBy("row", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(F.max(F.when(half, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~half, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = freeze(pairs, "pairs")
        names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"], "names").withColumnRenamed("a", "c").withColumnRenamed("b", "d")
        level = pairs.join(names, (F.col("a") == F.col("c")) & (F.col("b") == F.col("d"))).select("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name")
        level = freeze(level, "level")
        done = done.union(level.where("n = 1").select("row", F.lit(depth).alias("level"), "name"))
        level = level.where("n > 1")
    named = done.withColumnRenamed("row", "of")
    return rows.join(named, F.col("row") == F.col("of")).select("row", F.col("key").alias(key), F.col("sha").alias("text_sha256"), "level", "name")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    named = freeze(name_documents(docs, key, text, block).withColumnRenamed(key, "key"), "named")
    groups = freeze(named.groupBy("level", "name").agg(F.min("key").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    groups = groups.withColumnRenamed("level", "l").withColumnRenamed("name", "m")
    out = named.join(groups, (F.col("level") == F.col("l")) & (F.col("name") == F.col("m")))
    first = freeze(out.where(F.col("key").eqNullSafe(F.col("keep_id"))).groupBy("level", "name").agg(F.min("row").alias("stays")).select("stays"), "first")
    return out.join(first, F.col("row") == F.col("stays"), "left").select(F.col("key").alias(key), "keep_id", "group_size", F.col("stays").isNotNull().alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with the same columns. Rows that repeat both key and normalised text are one row:
    the one with the least text stays."""
    same = exact_duplicates(docs, key, text, block).where(F.col(key).eqNullSafe(F.col("keep_id"))).groupBy(key, "text_sha256").agg(F.count("*").alias("_times"))
    verdict = freeze(same.select(F.col(key).alias("_stay_key"), F.col("text_sha256").alias("_stay_sha"), "_times"), "verdict")
    sha = F.sha2(normalised(text).cast("binary"), 256)
    stays = F.col(key).eqNullSafe(F.col("_stay_key")) & (sha == F.col("_stay_sha"))
    repeated = verdict.where("_times > 1")
    if repeated.isEmpty():
        return docs.join(verdict, stays, "left_semi")
    one = docs.join(repeated, stays).groupBy("_stay_key", "_stay_sha").agg(F.min_by(F.struct(*docs.columns), F.coalesce(text, F.lit(""))).alias("_row"))
    return docs.join(verdict.where("_times = 1"), stays, "left_semi").union(one.select("_row.*"))


ORACLE = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
