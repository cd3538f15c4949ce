"""Operator 3: vector best-fit packing of documents into sequences.

A document's ids are cut into pieces of at most ``tokens`` ids; every piece but the last is full. A piece asks
for three things at once: its tokens, one document slot, and an attention cost of its length squared. A
sequence offers a capacity of each. Pieces go longest first into the open sequence whose residual vector has
the smallest weighted norm (or the largest weighted dot product with the piece) among those that satisfy every
constraint. Sequences with equal residuals and pieces of equal length are handled as groups, so the search is
over distinct residuals and not over sequences.

Pieces are dealt evenly, whatever their keys, into groups of about ``group`` pieces, each packed by one task: the
task's size does not grow with the input or with a hot key, and at most the last few sequences of a group stay
open. With a document capacity and an attention capacity that no sequence of pieces can exceed, as in the query,
tokens alone bind and the rule is plain best-fit.

Null and empty texts hold one end id. A very long text is cut into pieces and none is dropped. Repeated rows and
rows without a key are packed like any other; ties among equal lengths go by key, piece and place. An empty table
gives no rows. Columns named ``sequence_id`` or ``offset`` of given pieces are replaced; of documents only key and
text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tokenfiles import vocabulary
from factloom.llm.wordtokens import word_tokens
from factloom.session import freeze, ship


def best_fit(lengths: np.ndarray, tokens: int = 4096, documents: int = 4096, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    cap = np.array([tokens, documents, attention or tokens * tokens], np.int64)
    weight = np.array(weights)
    seq, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    if len(lengths) and (lengths.max() > tokens or int(lengths.max()) ** 2 > cap[2] or documents < 1):
        raise ValueError("a piece exceeds the capacity of an empty sequence")
    order = np.argsort(-lengths, kind="stable")
    kinds, begin, count = np.unique(-lengths[order], return_index=True, return_counts=True)
    state = np.zeros((0, 3), np.int64)  # residual of each group of sequences
    bins: list[list[int]] = []  # its sequences
    where: dict[tuple[int, int, int], int] = {}
    opened = 0

    def group(res: np.ndarray) -> int:
        nonlocal state
        k = tuple(res.tolist())
        if k not in where:
            where[k] = len(bins)
            bins.append([])
            state = np.vstack((state, res)) if len(bins) > len(state) else state
        return where[k]

    for n, at, left in zip((-kinds).tolist(), begin.tolist(), count.tolist(), strict=True):
        item = np.array([n, 1, n * n], np.int64)
        per_item = lambda res: int(min(res[d] // item[d] for d in range(3) if item[d]))
        alive = np.array([bool(b) for b in bins], bool)
        while left:
            fits = np.flatnonzero(alive & (state >= item).all(axis=1)) if len(bins) else np.empty(0, int)
            if len(fits):
                r = (state[fits] - item) / cap * weight
                best = fits[np.argmin((r * r).sum(axis=1)) if score == "norm" else np.argmax((state[fits] / cap * weight * (item / cap)).sum(axis=1))]
                res, pool = state[best], bins[best]
            else:
                m = per_item(cap)
                new = max(1, left // m)
                pool = list(range(opened, opened + new))
                opened += new
                res, best = cap, -1
            # the best sequence stays the best until it is full: fill it with pieces of this length at once
            m = min(per_item(res), left)
            k = min(len(pool), left // m)
            used = pool[len(pool) - k :]
            del pool[len(pool) - k :]
            rows = order[at : at + k * m]
            seq[rows] = np.repeat(used, m)
            offset[rows] = (tokens - int(res[0])) + np.tile(np.arange(m) * n, k)
            at, left = at + k * m, left - k * m
            to = group(res - item * m)
            bins[to] += used
            if len(alive) < len(bins):
                alive = np.append(alive, [True] * (len(bins) - len(alive)))
            alive[to] = True
            if best >= 0 and not bins[best]:
                alive[best] = False
            elif best < 0 and pool:
                raise AssertionError("opened more sequences than were filled")
        if len(bins) > 256:  # forget groups without sequences and sequences that are full
            keep = [i for i, b in enumerate(bins) if b and state[i][0] > 0 and state[i][1] > 0]
            state, bins = state[keep], [bins[i] for i in keep]
            where = {tuple(s.tolist()): i for i, s in enumerate(state)}
    return seq, offset


def cut_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 1, tokens: int = 4096, folder: str | None = None, ids: bool = False) -> DataFrame:
    """One row per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokens(vocabulary(tokenizer, folder), end_id)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                of, start, part = [], [], []
                for i, row in enumerate(coder.encode(b.column(1).slice(lo, 256).to_pylist())):
                    for s in range(0, len(row), tokens):
                        of.append(lo + i)
                        start.append(s)
                        part.append(row[s : s + tokens].astype("<u4"))
                cols = [b.column(0).take(pa.array(of, pa.int64())), pa.array([s // tokens for s in start], pa.int32()), pa.array(start, pa.int64()), pa.array([len(p) for p in part], pa.int64()), pa.array([zlib.crc32(p) for p in part], pa.int64())]
                if ids:
                    cols.append(pa.array([p.astype(np.int32) for p in part], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[key, "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else ""))


def pack_pieces(pieces: DataFrame, key: str = "doc_id", tokens: int = 4096, documents: int = 4096, attention: int | None = None, score: str = "norm", group: int = 100_000) -> DataFrame:
    """``pieces`` (any columns, with ``key``, ``piece`` and ``length``) with ``sequence_id`` and ``offset``.
    Frozen pieces are expected: they are counted first, which sets the number of groups."""
    ship(pieces.sparkSession)
    pieces = pieces.select(*[f"`{c}`" for c in pieces.columns if c not in ("sequence_id", "offset")])
    groups = max(1, -(-pieces.count() // group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = list(batches)
        if not rows:
            return
        # one order whatever way the rows came in, so that a repeated task packs alike
        ties = [n for n in (key, "piece", "start", "ids_crc32") if n in rows[0].schema.names]
        t = pa.Table.from_batches(rows).sort_by([("length", "descending"), *((n, "ascending") for n in ties)])
        seq, offset = best_fit(t.column("length").to_numpy().astype(np.int64), tokens, documents, attention, score=score)
        t = t.append_column("sequence_id", pa.array(seq + (TaskContext.get().partitionId() << 40))).append_column("offset", pa.array(offset))
        yield from t.combine_chunks().to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return pieces.repartition(groups).mapInArrow(run, schema)  # dealt in turn: no key can fill a group


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokens: int = 4096, **more) -> DataFrame:
    """Cut and pack. The pieces are written once, without their ids, before they are dealt out."""
    return pack_pieces(freeze(cut_pieces(docs, key, text, tokens=tokens), "pieces"), key, tokens, **more)
