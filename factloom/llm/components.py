"""Connected components of a link table.

Links are first contracted where they lie: each task replaces its links by stars over what it has seen, which
drops redundant links before any shuffle. What is left goes on in one of two ways with the same result. At most
``bound`` links are finished by one task, whose size the bound limits. More are contracted by alternating large
and small stars: a minimum per node, pre-aggregated before its shuffle, and a join back, so that a node with very
many links costs no more than its rows. Nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import freeze


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of one task as (node, smallest node linked with it)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    for pdf in frames:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    labels = [root(x) for x in nodes]
    keep = [i for i, x in enumerate(nodes) if labels[i] != x]
    yield pd.DataFrame({"u": pd.Series([nodes[i] for i in keep], dtype="int64"), "v": pd.Series([labels[i] for i in keep], dtype="int64")})


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours of each node on the smallest: the larger ones (large star) or the smaller ones."""
    near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    least = freeze(least, "least")  # a written side lets Spark split the rows of a hot node
    joined = near.join(least, F.col("u") == F.col("w"))
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", bound: int = 1_000_000, limit: int = 60) -> DataFrame:
    """``node`` and ``label``, the smallest node it is linked with, for all nodes that have a link. Null ends and
    self links are ignored; an empty table gives no rows. Nodes are integers."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    edges = freeze(edges.mapInPandas(_stars, "u long, v long"), "stars")
    if edges.count() <= bound:
        edges = freeze(edges.repartition(1).mapInPandas(_stars, "u long, v long"), "joined")
    else:
        seen = None
        for _ in range(limit):
            edges = freeze(_star(freeze(_star(edges, True), "large"), False), "small")
            now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if now == seen or not now[0]:
                break
            seen = now
        else:
            raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
