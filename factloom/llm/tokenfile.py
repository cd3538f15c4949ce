"""Operator 2: token files with fixed-width bit packing.

A token file is a Parquet dataset of blocks. A block holds whole documents: their keys, their lengths, and all
their ids at ``bits`` bits each, the fewest that hold the vocabulary, least significant bit first. ``shard`` is
a range of keys, ``first`` the place of the block's first id in its shard; with the totals of the shards this
gives every document's place among all ids. ``least`` and ``most`` are the block's outermost keys, so that a
look-up skips files and blocks without reading them. Blocks are written by Spark's committer, so a lost executor
or a repeated task leaves each block once.

Texts are encoded where they are read; ids, not texts, travel to their shard. Shard bounds come from a sample of
about ``SAMPLE`` rows' keys, or ``PER_SHARD`` for each shard where that is more; they only balance shards. Rows that share a key are all kept, ordered by a hash of
their text and then by their place in the input, and may fall into several shards, so a hot key is no hot task.
Null keys come first. Null and empty texts hold only the end id. A very long text is one block, however long. An
empty table gives an empty file that reads back as no rows. Columns other than key and text are not read.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.tokenfiles import vocabulary
from factloom.llm.wordtokens import word_tokens
from factloom.session import partitions_for, shared_dir, ship

#: Rows whose keys set the shard bounds, at most; bytes of text in a shard, about.
SAMPLE, PER_SHARD, SHARD_BYTES = 20_000, 4, 64 << 20
BLOCK_IDS = 1 << 18


def width(vocabulary_size: int) -> int:
    """Bits that hold every id below ``vocabulary_size``."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for lo in range(0, len(ids), 1 << 16):  # a multiple of eight ids fills whole bytes
        part = ids[lo : lo + (1 << 16)].astype(np.uint32)
        out.append(np.packbits(((part[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block, touching only their bytes."""
    if bits in (8, 16, 32):
        step = bits // 8
        return np.frombuffer(payload, f"<u{step}", stop - start, start * step).astype(np.uint32)
    low = start * bits
    raw = np.frombuffer(payload, np.uint8)[low // 8 : (stop * bits + 7) // 8]
    flat = np.unpackbits(raw, bitorder="little")[low % 8 : low % 8 + (stop - start) * bits].reshape(-1, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _bounds(rows: DataFrame, floor: int) -> list[tuple]:
    """Upper bounds of all shards but the last, as (key is not null, key, hash, row)."""
    n = rows.count()  # from the files' footers

    def taken(wanted: int) -> list:
        # a share by the hash of the place, not the first rows by it: those would be sent from every partition
        return rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 40)) < min(1 << 40, (wanted << 40) // max(1, n))).collect()

    sample = taken(SAMPLE)
    if not sample:
        return []
    shards = max(floor, -(-sum(r.size for r in sample) * n // len(sample) // SHARD_BYTES))
    if shards * PER_SHARD > SAMPLE:  # the bounds grow with the file, a few keys for each shard
        sample = taken(shards * PER_SHARD)
    own = sorted((r.key is not None, r.key, r.h, r.row) if r.key is not None else (False, 0, r.h, r.row) for r in sample)
    return [own[i * len(own) // shards] for i in range(1, min(shards, len(own)))]


def write_token_file(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 1, folder: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text and write the ids in ascending ``key`` order."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("h"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    bounds = _bounds(rows.select("key", "h", "row", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")), partitions_for(spark))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokens(vocabulary(tokenizer, folder), end_id)
        bits = width(coder.size)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                places = zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)
                shard = [bisect_right(bounds, (k is not None, 0 if k is None else k, h, r)) for k, h, r in places]
                ids = coder.encode(part.column(3).to_pylist())
                packed = pa.array([pack(x, bits) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *part.columns[:3], pa.array([len(x) for x in ids], pa.int32()), packed], names=["shard", "key", "h", "row", "n", "packed"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = width(word_tokens(vocabulary(tokenizer, folder), end_id).size)
        keys: list = []
        lens: list[int] = []
        held: list[bytes] = []
        first = size = block = 0
        shard, key_type = None, None

        def full() -> pa.RecordBatch:
            nonlocal first, size, block
            payload = b"".join(held) if bits % 8 == 0 else pack(np.concatenate([unpack(x, bits, 0, n) for x, n in zip(held, lens, strict=True)]), bits)
            known = [k for k in keys if k is not None]
            ends = [pa.array([f(known) if known else None], key_type) for f in (min, max)]
            cols = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([bits], pa.int32()), *ends, pa.array([keys], pa.list_(key_type)), pa.array([lens], pa.list_(pa.int32())), pa.array([payload], pa.binary())]
            first, block, size = first + size, block + 1, 0
            keys.clear(), lens.clear(), held.clear()
            return pa.RecordBatch.from_arrays(cols, names=["shard", "block", "first", "n_ids", "bits", "least", "most", "keys", "lengths", "payload"])

        for b in batches:
            key_type = b.column(1).type
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                for s, k, n, x in zip(*(part.column(i).to_pylist() for i in (0, 1, 4, 5)), strict=True):
                    if s != shard:
                        if held:
                            yield full()
                        shard, first, block = s, 0, 0
                    keys.append(k), lens.append(n), held.append(x)
                    size += n
                    if size >= block_ids:
                        yield full()
        if held:
            yield full()

    packed = rows.mapInArrow(encode, f"shard int, key {kind}, h long, row long, n int, packed binary")
    ordered = packed.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "key", "h", "row")
    ordered.mapInArrow(blocks, f"shard int, block int, first long, n_ids long, bits int, least {kind}, most {kind}, keys array<{kind}>, lengths array<int>, payload binary").write.option("compression", "none").parquet(path)


def read_token_file(spark: SparkSession, path: str, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """One row per document: ``key``, ``start`` among all ids of the file, ``n_tokens``, ``ids_crc32`` and, unless
    turned off, the ``ids``."""
    ship(spark)
    blocks = spark.read.parquet(path)
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    # one row per shard: bounded by the shuffle width of the writer
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select(F.col("shard").alias("of"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    placed = blocks.join(F.broadcast(before), F.col("shard") == F.col("of")).select((F.col("before") + F.col("first")).alias("at"), "bits", "keys", "lengths", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at, bits, keys, lens, payload = (b.column(k)[i] for k in range(5))
                lens = np.array(lens.as_py(), np.int64)
                ends = np.cumsum(lens)
                flat = unpack(payload.as_py(), bits.as_py(), 0, int(ends[-1])).astype("<u4")
                parts = [flat[e - n : e] for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                cols = [keys.values, pa.array(at.as_py() + ends - lens), pa.array(lens), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if ids:
                    cols.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[key, "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return placed.mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))


def fetch(spark: SparkSession, path: str, wanted: list, key: str = "doc_id") -> DataFrame:
    """Random access: ``key`` and ``ids`` of some documents. Blocks whose outermost keys leave all of them out are
    skipped by the scan's statistics; of the others only the wanted ids are unpacked. Null keys can't be asked for."""
    ship(spark)
    blocks = spark.read.parquet(path)
    kind = blocks.schema["least"].dataType.simpleString()
    own = set(wanted)
    near = F.lit(False)
    for w in own:
        near = near | ((F.col("least") <= F.lit(w)) & (F.col("most") >= F.lit(w)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, lens, bits, payload = (b.column(c)[i].as_py() for c in range(4))
                ends = np.cumsum(lens)
                hits = [k for k, x in enumerate(keys) if x in own]
                if hits:
                    rows = [unpack(payload, bits, int(ends[k] - lens[k]), int(ends[k])).astype(np.int32) for k in hits]
                    yield pa.RecordBatch.from_arrays([b.column(0)[i].values.take(pa.array(hits)), pa.array(rows, pa.list_(pa.int32()))], names=[key, "ids"])

    return blocks.where(near).select("keys", "lengths", "bits", "payload").mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def scratch_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
