"""Change feed: file versions in, debounced batches and snapshots out, with Structured Streaming."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions import paths as P

KEPT_SNAPSHOTS = 24
EVENT = "path string, kind string, ts timestamp"


def file_versions(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Stream of dropped file versions. The file source sees new files only, so an edit or a deletion arrives as a new
    file named ``<version>.<anything>`` whose JSON rows say (path, kind, ts)."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", max_files).json(folder)


def qualified(events: DataFrame) -> DataFrame:
    """Events that call for a new extraction: a source outside ignored folders, a rescan or an error."""
    return events.where(P.is_source_path("path") | F.col("kind").isin("rescan", "error"))


def debounced(events: DataFrame, gap: str = "300 milliseconds", late: str = "1 second") -> DataFrame:
    """Batches that a quiet gap closes: first and last time, number of events, distinct paths."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    b = e.groupBy(F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.collect_set("path").alias("paths"))
    return b.select(F.col("session_window.start").alias("first"), "last", "n", F.sort_array("paths").alias("paths"))


class SnapshotStore:
    """Versioned tables below a folder and one pointer that is replaced in one step."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.counts: dict[str, int] = {}  # rows of the tables published last
        hadoop = spark._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def current(self) -> str | None:
        """Name of the published version."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("current-"))
        return names[-1].split("-", 2)[2] if names else None

    def publish(self, tables: dict[str, DataFrame]) -> str:
        """Write all tables as a new version, then flip the pointer. A failure leaves the old version current."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("current-")]
        number = max((int(n.split("-")[1]) for n in names), default=0) + 1
        version = f"{number:010d}-{uuid.uuid4().hex[:8]}"
        self.counts = {}
        for name, df in tables.items():
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/v-{version}/{name}")
            self.counts[name] = seen.get["n"]
        self._fs.create(self._path(f"{self.root}/.pending-{version}"), True).close()
        self._fs.rename(self._path(f"{self.root}/.pending-{version}"), self._path(f"{self.root}/current-{number:010d}-{version}"))
        return version

    def read(self, name: str) -> DataFrame:
        version = self.current()
        if version is None:
            raise LookupError("nothing is published")
        return self.spark.read.parquet(f"{self.root}/v-{version}/{name}")

    def collect_garbage(self, keep: int = KEPT_SNAPSHOTS) -> int:
        """Remove all but the newest versions."""
        pointers = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("current-"))
        old = pointers[:-keep] if keep else pointers
        for p in old:
            self._fs.delete(self._path(f"{self.root}/{p}"), False)
            self._fs.delete(self._path(f"{self.root}/v-{p.split('-', 2)[2]}"), True)
        return len(old)


def follow(events: DataFrame, store: SnapshotStore, rebuild: Callable[[DataFrame, int], dict[str, DataFrame]], notify: Callable[[dict], None], checkpoint: str) -> StreamingQuery:
    """Per micro-batch with a qualifying event: rebuild, publish, then notify. An error keeps the last version and is
    told as an event; only the newest state counts, so a slow batch takes the following events with it."""

    def handle(batch: DataFrame, epoch: int) -> None:
        hits = qualified(batch)
        if hits.isEmpty():
            return
        try:
            tables = rebuild(hits, epoch)
            version = store.publish(tables)
            counts = {f"{k}_count": n for k, n in store.counts.items()}  # counted while they were written
            notify({"event": "facts_updated", "version": version, "epoch": epoch} | counts)
        except Exception as e:  # the feed goes on whatever a rebuild meets
            notify({"event": "error", "epoch": epoch, "message": str(e).split("\n")[0]})

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stale_files(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose (path, mtime, length, crate, module) the cache does not hold: the ones to parse again."""
    keys = ["path", "mtime", "length", "crate", "module"]
    return files.join(cache.select(*keys), keys, "left_anti")


def merged_cache(cache: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """Cache rows of files that still exist unchanged, and the fresh ones."""
    keys = ["path", "mtime", "length", "crate", "module"]
    return cache.join(files.select(*keys), keys, "left_semi").unionByName(fresh)


def workspace_signature(files: DataFrame) -> int:
    """One number for a set of files by path, time and length, and crate and module where they are known, whatever the
    order: a sum of row hashes, pre-aggregated."""
    cols = ["path", "mtime", "length", *(c for c in ("crate", "module") if c in files.columns)]
    row = files.agg(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
    return hash((int(row.s or 0), row.n))


def append_tour(spark: SparkSession, folder: str, tours: list[dict]) -> int:
    """Append accepted tours; ids go on from the number stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    at = spark.read.schema("id long, tour string").json(folder).count() if there else 0
    rows = [(at + k + 1, json.dumps(t)) for k, t in enumerate(tours)]
    spark.createDataFrame(rows, "id long, tour string").coalesce(1).write.mode("append").json(folder)
    return at + len(tours)


def running_order(events: DataFrame) -> DataFrame:
    """Sequence number of each event per user, for replay."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
