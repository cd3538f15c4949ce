"""Session helpers shared by every query: shared storage, lineage cuts and code shipping."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see: ``spark.checkpoint.dir``.

    Where the setting is absent and all tasks run on this machine (tests, a laptop), a local folder is used and set as
    Spark's checkpoint directory. On a cluster its absence is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        conf = "file:///tmp/checkpoints/" + spark.sparkContext.applicationId
        spark.conf.set("spark.checkpoint.dir", conf)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def freeze(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and a lost executor
    costs a re-read instead of a recomputation. The shuffle files of the write go with it; nothing reads them later."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(frozen: DataFrame) -> None:
    """Remove the table that ``freeze`` wrote for this DataFrame. No later plan may read it."""
    spark = frozen.sparkSession
    files = frozen.inputFiles()
    if not files:
        return
    folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    if f"{shared_dir(spark).rpartition('//')[2]}/tables/" in folder.toString():
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers import the same code."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(), "factloom.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("factloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(to)
    _SHIPPED.add(app)


def partitions_for(spark: SparkSession) -> int:
    """The session's shuffle width, for explicit repartitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
