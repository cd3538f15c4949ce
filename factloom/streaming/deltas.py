"""Views kept up to date by signed changes instead of rebuilds.

A stream of file versions is keyed by file; the state of a key is its last version's rows. A new version yields only
what differs: rows that came with weight 1, rows that went with weight -1. A view is a grouped count and sums; a batch of
changes is aggregated and added to it, so a batch costs its changes and the view's groups, whatever lies in the files.
Counts and sums can be taken back; minima and distinct counts cannot and are no views here.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from factloom.session import freeze, ship
from factloom.streaming.feed import SnapshotStore

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """State that need not fit in memory, which keyed processors ask for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    ship(spark)


BUCKETS = 1024


def in_buckets(rows: DataFrame, key: str, buckets: int = BUCKETS) -> GroupedData:
    """``rows`` grouped for a keyed processor by ``bucket``, a hash of ``key``, with the key as a string, in which a null
    beside it costs no digits. A call of a processor costs milliseconds whatever it holds, so it serves all keys of a bucket; its
    state is a map with one entry per key, of which a batch reads and writes those it names. A bucket's rows of a batch
    are in memory at once. A checkpoint keeps its number of buckets."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).withColumn(key, F.col(key).cast("string")).groupBy("bucket")


class _Changes(StatefulProcessor):
    """Last version and rows of each file; a deletion leaves its version, so that an older one cannot come back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getMapState("last", "file string", "version long, rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest: dict = {}
        for pdf in rows:
            for f, v, r in zip(pdf["file"].tolist(), pdf["version"].tolist(), pdf["rows"].tolist(), strict=True):
                f = f if isinstance(f, str) else None
                if f not in newest or v > newest[f][0]:
                    newest[f] = (int(v), r)
        known, out = self._last.exists(), []
        for file, (version, now) in newest.items():
            before = self._last.getValue((file,)) if known else None
            if before is not None and before[0] >= version:
                continue
            now = now if isinstance(now, str) else "[]"
            change = Counter(json.dumps(x) for x in json.loads(now))
            change.subtract(json.dumps(x) for x in json.loads(before[1] if before else "[]"))
            self._last.updateValue((file,), (version, now))
            out += [(file, r, n) for r, n in change.items() if n]
        yield pd.DataFrame(out, columns=["file", "row", "weight"]).astype({"file": object, "row": object, "weight": "int64"})

    def close(self) -> None:
        pass


def signed_changes(versions: DataFrame) -> DataFrame:
    """``file``, ``row`` (JSON) and ``weight`` from a stream of ``file``, ``version`` and ``rows`` (a JSON list; null
    deletes). Of several versions in a batch the last counts; one that is not newer than the known one changes nothing."""
    keyed_state(versions.sparkSession)
    kind = versions.schema["file"].dataType
    out = in_buckets(versions.select("file", "version", "rows"), "file").transformWithStateInPandas(_Changes(), "file string, row string, weight long", "Update", "None")
    return out.withColumn("file", F.col("file").cast(kind))


class DeltaViews:
    """Grouped counts (``n``) and sums in a versioned store: ``views`` names for each its group and summed columns."""

    def __init__(self, store: SnapshotStore, row_schema: str, views: dict[str, tuple[list[str], list[str]]]):
        self.store, self.row_schema, self.views = store, row_schema, views

    def apply(self, changes: DataFrame, epoch: int) -> str | None:
        """Add a batch of changes; a batch that was added before is passed over. The new version, if there is one."""
        before = self.store.current()
        if before and self.store.read("applied").first().epoch >= epoch:
            return None
        rows = freeze(changes.select("weight", F.from_json("row", self.row_schema).alias("r")).select("weight", "r.*"), "changes")
        tables = {}
        for name, (by, summed) in self.views.items():
            part = rows.groupBy(*by).agg(F.sum("weight").alias("n"), *(F.sum(F.col("weight") * F.col(c)).alias(c) for c in summed))
            if before:
                part = self.store.read(name).unionByName(part).groupBy(*by).agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in summed))
            tables[name] = part.where("n <> 0")
        tables["applied"] = changes.sparkSession.createDataFrame([(epoch,)], "epoch long")
        return self.store.publish(tables)


def follow_views(versions: DataFrame, views: DeltaViews, checkpoint: str) -> StreamingQuery:
    """Run what has arrived through the views, batch by batch."""
    sink = signed_changes(versions).writeStream.foreachBatch(lambda batch, epoch: views.apply(batch, epoch) and None)
    return sink.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
