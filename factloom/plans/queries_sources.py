"""Source and stream queries over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.adapters import read
from factloom.plans.registry import query
from factloom.session import shared_dir
from factloom.streaming import deltas, subscribers
from factloom.streaming.feed import SnapshotStore


@query("ed1_page_links", "SELECT page_id, count(*) AS n, count(DISTINCT h) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages) x GROUP BY 1")
def ed1(spark: SparkSession, d: str) -> DataFrame:
    """References found in text become rows, then edges."""
    h = read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h"))
    return h.groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct("h").alias("targets"))


@query("sm2_debounce", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, count(*) AS n FROM s GROUP BY user_id, g")
def sm2(spark: SparkSession, d: str) -> DataFrame:
    """Batches close after a quiet gap."""
    e = read(spark, d, "events")
    s = e.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    return s.select("user_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), "n")


def _stream_place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


_FILES = "SELECT o_custkey AS file, o_orderstatus AS kind, o_orderpriority AS via, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderdate FROM {orders}"


@query(
    "sm4_incremental_profile",
    f"WITH f AS ({_FILES}), b AS (SELECT * FROM f WHERE o_orderdate < TIMESTAMP '1997-01-01 00:00:00'), h AS (SELECT * FROM f WHERE o_orderdate >= TIMESTAMP '1994-01-01 00:00:00'), "
    "u AS (SELECT * FROM h UNION ALL SELECT * FROM b WHERE file NOT IN (SELECT file FROM h)), x AS (SELECT 1 AS version, * FROM b UNION ALL SELECT 2, * FROM u UNION ALL SELECT 3, * FROM u WHERE file NOT IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0)) "
    "SELECT CAST(version AS INTEGER) AS version, kind, via, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM x GROUP BY 1, 2, 3",
)
def sm4(spark: SparkSession, d: str) -> DataFrame:
    """A customer is a file, its orders the rows. Three rounds of edits arrive as a stream: all files as of 1997, new
    versions from 1994 on, and deletions. The view after each round, kept by signed changes alone."""
    f = spark.sql(_FILES, orders=read(spark, d, "orders"))
    rows = lambda x: x.groupBy("file").agg(F.to_json(F.collect_list(F.struct("kind", "via", "cents"))).alias("rows"))
    gone = read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("file"), F.lit(None).cast("string").alias("rows"))
    rounds = [rows(f.where("o_orderdate < TIMESTAMP '1997-01-01 00:00:00'")), rows(f.where("o_orderdate >= TIMESTAMP '1994-01-01 00:00:00'")), gone]
    place, out = _stream_place(spark), None
    views = deltas.DeltaViews(SnapshotStore(spark, f"{place}/views"), "kind string, via string, cents long", {"profile": (["kind", "via"], ["cents"])})
    for version, edits in enumerate(rounds, 1):
        edits.select("file", F.lit(version).cast("long").alias("version"), "rows").write.mode("append").parquet(f"{place}/feed")
        feed = spark.readStream.schema("file long, version long, rows string").parquet(f"{place}/feed")
        deltas.follow_views(feed, views, f"{place}/checkpoint").awaitTermination()
        now = views.store.read("profile").select(F.lit(version).alias("version"), "kind", "via", "n", "cents")
        out = now if out is None else out.union(now)
    return out


@query(
    "sm8_bounded_delivery",
    "WITH e AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS poll FROM {events}), g AS (SELECT *, sum(CASE WHEN poll THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS box FROM e), "
    "h AS (SELECT user_id, coalesce(box, 0) AS box, ts, event_id, poll, max(CASE WHEN poll THEN event_id END) OVER (PARTITION BY user_id, coalesce(box, 0)) AS poll_id, row_number() OVER (PARTITION BY user_id, coalesce(box, 0), poll ORDER BY ts DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY user_id, coalesce(box, 0), poll) AS n FROM g) "
    "SELECT user_id AS subscriber, poll_id, CAST(least(n, 16) - back + 1 AS INTEGER) AS place, event_id, CAST(0 AS BIGINT) AS missed FROM h WHERE NOT poll AND poll_id IS NOT NULL AND back <= 16 "
    "UNION ALL SELECT DISTINCT user_id, poll_id, CAST(0 AS INTEGER), CAST(NULL AS BIGINT), n - 16 FROM h WHERE NOT poll AND poll_id IS NOT NULL AND n > 16",
)
def sm8(spark: SparkSession, d: str) -> DataFrame:
    """Every user is a subscriber that polls when it purchases; all events arrive as a stream in three parts."""
    e = read(spark, d, "events").selectExpr("user_id AS subscriber", "ts AS at", "event_id", "event_type = 'purchase' AS poll")
    place = _stream_place(spark)
    cuts = ["at < TIMESTAMP '2024-01-11 00:00:00'", "at >= TIMESTAMP '2024-01-11 00:00:00' AND at < TIMESTAMP '2024-01-21 00:00:00'", "at >= TIMESTAMP '2024-01-21 00:00:00'"]
    for cut in cuts:
        e.where(cut).write.mode("append").parquet(f"{place}/feed")
        feed = spark.readStream.schema(e.schema).parquet(f"{place}/feed")
        sink = subscribers.bounded_delivery(feed).writeStream.outputMode("update").foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{place}/out/epoch={epoch}"))
        sink.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out").drop("epoch")
