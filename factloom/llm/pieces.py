"""Operator 1: piece encoding and decoding by vectorised merge rounds.

All words of a batch lie in one flat array of symbols. Each round finds the lowest pair rank of every word
(segmented minimum), merges all leftmost non-overlapping places of that rank at once, closes the gaps, and
takes words without a pair out, until none is left. Merging the places of one rank together equals merging
them one by one up to the first place whose piece forms a pair of no higher rank with a neighbour it has at that
moment; a word's later places wait for the next round, so the result is exact.

The pieces that are runs of the space symbol share one rank, so that a long run would grow by one symbol a round.
Such a run is settled directly: while enough of it is left, its front becomes the longest run piece, which pairs
with nothing, and the rest is the same problem again.

A null or empty text has only the end id. Very long texts and words take time in proportion to their length.
Repeated rows and rows without a key are encoded like any other; an empty table gives no rows; only key and text
are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.chunkcache import ChunkCache
from factloom.llm.tokenfiles import vocabulary
from factloom.session import ship

SPACE = "▁"
_FREE = np.iinfo(np.int32).max
_CHUNK = re.compile(rb" *[^ \n]+| +|\n")


class PieceCodec:
    """Encoder and decoder for a byte-fallback BPE piece model without normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, pieces = model.normalizer_spec, model.pieces
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("only identity-normalised byte-fallback piece models are supported")
        kind = np.array([p.type for p in pieces])
        if np.isin(kind, (4, 5)).any():
            raise ValueError("user-defined and unused pieces are not supported")
        self.size = len(pieces)
        self.end = model.trainer_spec.eos_id
        text = [p.piece for p in pieces]
        score = np.array([p.score for p in pieces], np.float32)
        normal = kind == 1
        # equal scores share a rank: the leftmost place wins among them
        order = np.unique(-score[normal], return_inverse=True)[1]
        rank = np.full(self.size, _FREE, np.int32)
        rank[normal] = order
        self.rank = rank
        at = {text[i]: int(i) for i in np.flatnonzero(normal)}
        self.of_char = np.arange(0x110000, dtype=np.int32) + self.size  # symbols of characters that are no piece
        for s, i in at.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        symbol = lambda s: at.get(s, int(self.of_char[ord(s)]) if len(s) == 1 else None)
        left, right, into = [], [], []
        for s, i in at.items():
            for k in range(1, len(s)):
                a, b = symbol(s[:k]), symbol(s[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    into.append(i)
        key = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        o = np.argsort(key)
        self.keys, self.into = key[o], np.array(into, np.int32)[o]
        self.to_rank = rank[self.into]
        risky = np.zeros(self.size + 1, bool)
        for part in (np.array(left), np.array(right)):
            own = part < self.size
            worse = own & (rank[np.array(into)] <= rank[np.where(own, part, 0)])
            risky[part[worse]] = True
        self.risky = risky
        inner = [s for s in at if any(a != SPACE and b == SPACE for a, b in zip(s, s[1:], strict=False)) or ("\n" in s and len(s) > 1)]
        if inner:
            raise ValueError(f"pieces that span words: {inner[:3]}")
        joined = {p for s in at for p in zip(s, s[1:], strict=False)}
        letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
        self.apart = {(a + b).encode() for a in letters for b in ".," if (a, b) not in joined}
        self.run, self.run_floor = self._space_run(at, left, right)
        self.run_id = at.get(SPACE * self.run)
        byte = np.flatnonzero(kind == 6)
        self.byte_id = np.zeros(256, np.int32)
        self.byte_id[[int(text[i][3:5], 16) for i in byte]] = byte
        self.byte_of = {int(i): int(text[i][3:5], 16) for i in byte}
        surface = [s.replace(SPACE, " ").encode() for s in text]
        for i in np.flatnonzero(kind == 3):
            surface[i] = b""
        for i in np.flatnonzero(kind == 2):
            surface[i] = model.trainer_spec.unk_surface.encode()
        for i, b in self.byte_of.items():
            surface[i] = bytes([b])
        self.surface = surface
        self.starts_space = {int(i) for i in np.flatnonzero(normal) if text[i].startswith(SPACE)}
        self.silent = {int(i) for i in np.flatnonzero(kind == 3)}
        self.dtype = "<u2" if self.size <= 1 << 16 else "<u4"
        self.cache = ChunkCache(self._split, self._chunks, self.dtype)

    def _space_run(self, at: dict[str, int], left: list[int], right: list[int]) -> tuple[int, int]:
        """Length of the longest run of spaces that is a piece, and the length a run must keep in front of its
        last piece; 0 unless all run pieces share one rank that is the highest and the longest one pairs with nothing."""
        sizes = [len(s) for s in at if len(s) > 1 and not s.strip(SPACE)]
        if not sizes or {int(self.rank[at[SPACE * n]]) for n in sizes} != {int(self.rank[self.rank < _FREE].max())}:
            return 0, 0
        most = max(sizes)
        if at[SPACE * most] in {*left, *right}:
            return 0, 0
        lead = max(len(s) - len(s.lstrip(SPACE)) for s in at if s.strip(SPACE))  # what a word may take from a run's end
        return most, 2 * most + lead

    @staticmethod
    def _split(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        chunks = [_CHUNK.findall(b" " + t.replace(SPACE, " ").encode()) if t else [] for t in texts]
        return list(chain.from_iterable(chunks)), np.array([len(c) for c in chunks], np.int64)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a.astype(np.int64) << 32) | b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[i] == key
        return np.where(hit, self.to_rank[i], _FREE), np.where(hit, self.into[i], -1)

    def _first_lookup(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of all neighbours of a batch of characters, which hold few different pairs."""
        seen = np.bincount(sym, minlength=1)
        own = np.flatnonzero(seen)
        if len(own) > 1500:
            return self._lookup(sym[:-1], sym[1:])
        small = np.zeros(len(seen), np.int32)
        small[own] = np.arange(len(own))
        s = small[sym]
        pair = s[:-1] * len(own) + s[1:]
        rank, into = self._lookup(np.repeat(own, len(own)), np.tile(own, len(own)))
        return rank[pair], into[pair]

    def _safe(self, at: np.ndarray, w: np.ndarray, sym: np.ndarray, into: np.ndarray, first: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which places may be merged together: those up to a word's first place whose piece, with the neighbours
        it has when all places before it are merged, forms a pair that comes no later."""
        new = into[at]
        doubt = np.flatnonzero(self.risky[new])
        ok = np.ones(len(at), bool)
        if not len(doubt):
            return ok
        p, own = at[doubt], w[doubt]
        k = np.maximum(doubt - 1, 0)
        joined = (doubt > 0) & (at[k] + 2 == p) & (w[k] == own)
        stop = np.zeros(len(doubt), bool)
        has = p > first[own]
        i = np.flatnonzero(has)
        stop[i] = self._lookup(np.where(joined[i], new[k[i]], sym[p[i] - 1]), new[doubt[i]])[0] <= least[own[i]]
        i = np.flatnonzero(p + 2 < first[own] + sizes[own])
        stop[i] |= self._lookup(new[doubt[i]], sym[p[i] + 2])[0] <= least[own[i]]
        if stop.any():
            words, lead = np.unique(own[stop], return_index=True)
            until = np.full(len(first), len(at), np.int64)
            until[words] = doubt[stop][lead]
            ok = np.arange(len(at)) <= until[w]
        return ok

    def merge(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after all merges, one after another, and how many each word has. Symbols from
        ``size`` on are characters without a piece."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        which = np.flatnonzero(lens)
        sizes = lens[which]
        sym = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        first = np.cumsum(sizes) - sizes
        rank = np.full(len(sym), _FREE, np.int32)
        into = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            rank[:-1], into[:-1] = self._first_lookup(sym)
            rank[first + sizes - 1] = _FREE
        while len(which):
            least = np.minimum.reduceat(rank, first)
            live = least < _FREE
            if not live.all():
                gone = np.repeat(~live, sizes)
                done.append((which[~live], sizes[~live], sym[gone]))
                keep = ~gone
                sym, rank, into = sym[keep], rank[keep], into[keep]
                which, sizes, least = which[live], sizes[live], least[live]
                if not len(which):
                    break
                first = np.cumsum(sizes) - sizes
            word = np.repeat(np.arange(len(which)), sizes)
            at = np.flatnonzero(rank == least[word])
            w = word[at]
            # places in a chain overlap: take every other one from its left end
            chained = np.r_[False, (at[1:] == at[:-1] + 1) & (w[1:] == w[:-1])]
            start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            take = (np.arange(len(at)) - start) % 2 == 0
            at, w = at[take], w[take]
            at = at[self._safe(at, w, sym, into, first, sizes, least)]
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            sizes = sizes - np.bincount(word[at], minlength=len(which))
            sym, rank, into = sym[keep], rank[keep], into[keep]
            first = np.cumsum(sizes) - sizes
            redo = np.zeros(len(sym), bool)
            redo[moved] = True
            redo[moved[moved > 0] - 1] = True
            last = first + sizes - 1
            rank[last[redo[last]]] = _FREE
            redo[last] = False
            redo = np.flatnonzero(redo)
            rank[redo], into[redo] = self._lookup(sym[redo], sym[redo + 1])
        counts = np.zeros(len(words), np.int64)
        for ws, ns, _ in done:
            counts[ws] = ns
        begin = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for ws, ns, part in done:
            shift = np.repeat(begin[ws] - (np.cumsum(ns) - ns), ns)
            flat[shift + np.arange(len(part))] = part
        return flat, counts

    def _parts(self, chunk: bytes) -> tuple[bytes, ...]:
        """The chunk, cut before a last full stop or comma that no piece joins to what precedes it."""
        return (chunk[:-1], chunk[-1:]) if len(chunk) > 2 and chunk[-2:] in self.apart else (chunk,)

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        if self.run:
            q = [max(0, len(c) - len(c.lstrip(b" ")) - self.run_floor) // self.run for c in chunks]
            if any(q):
                run = np.array([self.run_id], self.dtype).tobytes()
                return [run * n + ids for n, ids in zip(q, self._chunks([c[n * self.run :] for c, n in zip(chunks, q, strict=True)]), strict=True)]
        parts = [self._parts(c) for c in chunks]
        words = list({p for c in parts for p in c})
        flat, counts = self.merge([w.decode().replace(" ", SPACE) for w in words])
        odd = np.flatnonzero(flat >= self.size)
        if len(odd):  # characters without a piece become one id for each byte
            n = np.ones(len(flat), np.int64)
            spelled = [self.byte_id[list(chr(x).encode("utf-8", "surrogatepass"))] for x in (flat[odd] - self.size).tolist()]
            n[odd] = [len(x) for x in spelled]
            word = np.repeat(np.arange(len(words)), counts)
            counts = np.bincount(word, weights=n, minlength=len(words)).astype(np.int64)
            to = np.cumsum(n) - n
            out = np.empty(int(n.sum()), np.int32)
            plain = flat < self.size
            out[to[plain]] = flat[plain]
            out[np.repeat(to[odd], n[odd]) + np.concatenate([np.arange(len(x)) for x in spelled])] = np.concatenate(spelled)
            flat = out
        width = np.dtype(self.dtype).itemsize
        raw = flat.astype(self.dtype).tobytes()
        ends = (np.cumsum(counts) * width).tolist()
        ids = {w: raw[a:b] for w, a, b in zip(words, [0, *ends], ends, strict=False)}
        return [ids[c[0]] if len(c) == 1 else ids[c[0]] + ids[c[1]] for c in parts]

    def encode(self, texts: Sequence[str | None], end: bool = True) -> list[np.ndarray]:
        tail = np.array([self.end] if end else [], self.dtype)
        return [np.concatenate((x, tail)) for x in self.cache.ids([t or "" for t in texts])]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ``ids``. The space before the first visible piece is dropped; each byte that is no part of a
        valid character becomes U+FFFD."""
        ids, silent = ids.tolist(), self.silent
        lead = next((i for i in ids if i not in silent), None)
        while ids and ids[-1] in silent:
            ids.pop()
        runs, at = [], 0
        if not silent.isdisjoint(ids):  # bytes on both sides of a control id never form a character
            for k, i in enumerate(ids):
                if i in silent:
                    runs.append(ids[at:k])
                    at = k + 1
        runs.append(ids[at:])
        out = "".join(self._text(b"".join(map(self.surface.__getitem__, r))) for r in runs)
        return out[1:] if lead in self.starts_space else out

    def _text(self, raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._mend(raw)

    @staticmethod
    def _mend(raw: bytes) -> str:
        out, i = [], 0
        while i < len(raw):
            n = 1 if raw[i] < 0x80 else 2 if raw[i] >> 5 == 6 else 3 if raw[i] >> 4 == 14 else 4 if raw[i] >> 3 == 30 else 0
            try:
                if not n:
                    raise ValueError
                out.append(raw[i : i + n].decode())
                i += n
            except ValueError:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = "piece_bpe_32k.model", folder: str | None = None, digest: bool = False) -> DataFrame:
    """One row per document: ``key``, ``ids`` with the end id and ``decoded``, or with ``digest`` their lengths
    and SHA-256. Other columns of ``docs`` are left out, so that none can clash."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        c = codec(vocabulary(model, folder))
        number = [b"%d" % i for i in range(c.size)]
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                rows = c.encode(texts[lo : lo + 256])
                back = [c.decode(r) for r in rows]
                own = b.column(0).slice(lo, len(rows))
                if digest:
                    cols = [own, pa.array([len(r) for r in rows], pa.int64()), pa.array([sha256(b" ".join(map(number.__getitem__, r.tolist()))).hexdigest() for r in rows], pa.string()), pa.array([sha256(t.encode()).hexdigest() for t in back], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    cols = [own, pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array(back, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=[key, "ids", "decoded"])

    out = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else f"`{key}` {kind}, ids array<int>, decoded string"
    return docs.select(key, text).mapInArrow(run, out)
