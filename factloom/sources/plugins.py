"""Front ends and event sinks as Python data sources, registered by name.

A front end is a name, the file endings it takes and a function from one source text to entity rows. Registered, it is a
batch source ``facts_<name>``: ``spark.read.format("facts_toml").option("root", uri).load()``. Planning lists the tree once
and cuts it into partitions of about ``bytes_per_partition``; filters on ``file`` are taken over before that, so what they
exclude makes no partition and is never opened. Trees and sinks are reached through Arrow's file systems: local paths,
HDFS and object stores by their address.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from factloom.session import ship

ENTITY = "language string, file string, what string, ord long, json string"


@dataclass(frozen=True)
class FrontEnd:
    name: str
    endings: tuple[str, ...]
    #: (file, text) to (what, value) pairs in order
    parse: Callable[[str, str], Iterator[tuple[str, dict]]]


@dataclass
class _Files(InputPartition):
    files: tuple[str, ...]


class FrontEndReader(DataSourceReader):
    def __init__(self, front: FrontEnd, options: dict[str, str]):
        self.front, self.root = front, options["root"]
        self.size = int(options.get("bytes_per_partition", 64 << 20))
        self.tests: list[Callable[[str], bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("file",):
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append(lambda x, v=f.value: x == v)
            elif isinstance(f, In):
                self.tests.append(lambda x, v=frozenset(f.value): x in v)
            elif isinstance(f, StringStartsWith):
                self.tests.append(lambda x, v=f.value: x.startswith(v))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.root)
        found = ((i.path[len(root.rstrip("/")) + 1 :], i.size) for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File)
        parts: list[list[str]] = [[]]
        room = self.size
        for name, size in sorted(x for x in found if x[0].endswith(self.front.endings) and all(t(x[0]) for t in self.tests)):
            if parts[-1] and size > room:
                parts.append([])
                room = self.size
            parts[-1].append(name)
            room -= size
        return [_Files(tuple(p)) for p in parts]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, root = fs.FileSystem.from_uri(self.root)
        for name in partition.files:
            with store.open_input_stream(posixpath.join(root, name)) as f:
                text = f.read().decode("utf-8", "replace")
            for k, (what, value) in enumerate(self.front.parse(name, text)):
                yield self.front.name, name, what, k, json.dumps(value)


def register(spark: SparkSession, front: FrontEnd) -> str:
    """Make a front end known to the session; the name of its format."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"facts_{front.name}"

        def schema(self) -> str:
            return ENTITY

        def reader(self, schema: StructType) -> DataSourceReader:
            return FrontEndReader(front, self.options)

    spark.dataSource.register(Source)
    return Source.name()


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int


class EventWriter(DataSourceStreamWriter):
    """Rows as JSON lines in files that count once a batch's manifest names them. A batch that runs again replaces its
    manifest, so its events are there once; files of attempts that did not commit are named by nobody."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = fs.FileSystem.from_uri(self.root)
        name, count = f"data/{uuid.uuid4().hex}.json", 0
        store.create_dir(posixpath.join(root, "data"), recursive=True)
        with store.open_output_stream(posixpath.join(root, name)) as f:
            for r in rows:
                f.write((json.dumps(r.asDict(recursive=True), default=str) + "\n").encode())
                count += 1
        return _Written(name, count)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        store, root = fs.FileSystem.from_uri(self.root)
        store.create_dir(posixpath.join(root, "batches"), recursive=True)
        pending, final = (posixpath.join(root, f"batches/{n}") for n in (f".{batchId:012d}-{uuid.uuid4().hex}", f"{batchId:012d}.json"))
        with store.open_output_stream(pending) as f:
            f.write(json.dumps([m.file for m in messages if m is not None and m.rows]).encode())
        store.move(pending, final)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        store, root = fs.FileSystem.from_uri(self.root)
        for m in messages:
            if m is not None:
                store.delete_file(posixpath.join(root, m.file))


class EventSink(DataSource):
    """``writeStream.format("fact_events").option("path", uri)``."""

    @classmethod
    def name(cls) -> str:
        return "fact_events"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return EventWriter(self.options)


def register_sink(spark: SparkSession) -> str:
    ship(spark)
    spark.dataSource.register(EventSink)
    return EventSink.name()


def read_events(spark: SparkSession, path: str, schema: str):
    """The events of committed batches with their ``batch``. Manifests are small files, one per batch, and are read by Spark."""
    from pyspark.sql import functions as F

    listed = spark.read.text(f"{path}/batches/*.json", wholetext=True).select(F.regexp_extract("_metadata.file_name", "^(\\d+)", 1).cast("long").alias("batch"), F.explode(F.from_json("value", "array<string>")).alias("file"))
    rows = spark.read.schema(schema).json(f"{path}/data").withColumn("_file", F.concat(F.lit("data/"), F.col("_metadata.file_name")))
    return rows.join(listed, F.col("_file") == F.col("file")).drop("_file", "file")
