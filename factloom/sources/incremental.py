"""Extraction that parses only what changed since the last run and resolves names only if anything did.

The cache of a tree holds, per version, the listed files with the key each was parsed under (path, time, length, crate,
module), the parsed entities, and the fact tables. A run lists names, times and lengths without opening a source. If
the signature of the listing is that of the cache, the cached tables are the result. Else the files whose key the cache
lacks are read and parsed; entities of files that are gone or have changed leave; names are resolved over all entities,
since a new type may be what an old reference meant. The new version is written beside the old one and becomes current
in one step, so a failed run leaves the old one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import freeze
from factloom.sources import extract as X
from factloom.streaming.feed import SnapshotStore, merged_cache, stale_files, workspace_signature

#: Caches of other versions of the entities' form are not looked at.
VERSION = 1
TABLES = ("modules", "types", "functions", "exports", "edges", "calls")
#: Up to so many changed files are named to the listing, which then opens no other; more are told by a join.
NAMED = 10_000


@dataclass
class Run:
    facts: X.Facts
    version: str
    parsed: int
    resolved: bool


def cache_folder(base: str, root: str, language: str | None = None) -> str:
    """Where the cache of a tree lies: by a digest of its root, the front end and the version of the form."""
    return f"{base.rstrip('/')}/{hashlib.sha256(f'{VERSION}|{language or "all"}|{root.rstrip("/")}'.encode()).hexdigest()[:24]}"


def _listed(spark: SparkSession, root: str, language: str | None) -> tuple[DataFrame, DataFrame]:
    """Sources with the key each is parsed under, without their contents; and the packages."""
    names = X.list_files(spark, root, contents=False)
    manifests = X.list_files(spark, root, names="{Cargo.toml,package.json,tsconfig.json}").select("uri", "source")
    files = freeze(names.join(manifests, "uri", "left").select("rel", "uri", "modificationTime", "length", "source"), "listing")
    packages = X.found_packages(files, root, language)
    keyed = X.assigned(files, packages).drop("source").withColumnRenamed("rel", "path")
    return freeze(keyed.where(F.lit(True) if language is None else F.col("language") == language), "keyed"), packages


def _parsed(spark: SparkSession, root: str, stale: DataFrame, count: int, packages: DataFrame, language: str | None) -> DataFrame:
    if count <= NAMED:
        files = X.list_files(spark, root, only=[r.uri for r in stale.select("uri").collect()])
    else:
        files = X.list_files(spark, root).join(stale.select("uri"), "uri", "left_semi")
    return X.scan(files, packages, language)


def extract_incremental(spark: SparkSession, root: str, cache: str, language: str | None = None) -> Run:
    """The facts of a tree, as ``extract`` gives them, from the cache as far as it holds."""
    X.checked_language(language)
    store = SnapshotStore(spark, cache_folder(cache, root, language))
    keyed, packages = _listed(spark, root, language)
    signature = str(workspace_signature(keyed))
    before = store.current()
    if before and store.read("meta").first().signature == signature:
        return Run(X.Facts(**{t: store.read(t) for t in TABLES}), before, 0, False)
    stale = freeze(stale_files(keyed, store.read("files")) if before else keyed, "stale")
    count = stale.count()
    fresh = _parsed(spark, root, stale, count, packages, language)
    if before:
        same = keyed.join(stale.select("path"), "path", "left_anti").select(F.col("path").alias("file"), "crate")
        fresh = store.read("entities").join(same, ["file", "crate"], "left_semi").unionByName(fresh)
    rows = freeze(fresh, "entities")
    facts = X.facts_of(rows)
    meta = spark.createDataFrame([(signature, root)], "signature string, root string")
    version = store.publish({"files": keyed, "entities": rows, "meta": meta, **{t: getattr(facts, t) for t in TABLES}})
    store.collect_garbage()
    return Run(X.Facts(**{t: store.read(t) for t in TABLES}), version, count, True)
