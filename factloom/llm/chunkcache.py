"""A memo from text chunks to packed token ids, bounded in bytes.

A tokenizer whose merges never cross certain positions of a text can encode the stretches between them on
their own. Natural text repeats such stretches, so each Python worker encodes a stretch once and copies its
ids afterwards. The memo is emptied when full; results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: What a memo entry costs beyond its characters and ids: two objects' heads and its share of the table.
ENTRY_BYTES = 170


class ChunkCache:
    """``split`` gives all chunks of some texts and how many each text has; ``encode`` the packed ids of chunks."""

    def __init__(self, split: Callable[[list[str]], tuple[list[bytes], np.ndarray]], encode: Callable[[list[bytes]], list[bytes]], dtype: str, most_bytes: int = 64 << 20, chunk_bytes: int = 256, group_chars: int = 1_000_000):
        self.split, self.encode, self.dtype, self.most_bytes, self.chunk_bytes, self.group_chars = split, encode, np.dtype(dtype), most_bytes, chunk_bytes, group_chars
        self.memo: dict[bytes, bytes] = {}
        self.bytes = 0

    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Token ids of each text; the work on unseen chunks is done at once for a bounded group of texts."""
        out, group, size = [], [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > self.group_chars:
                out += self._group(group)
                group, size = [], 0
        return out + (self._group(group) if group else [])

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        if self.bytes > self.most_bytes:
            self.memo.clear()
            self.bytes = 0
        chunks, counts = self.split(texts)
        found = list(map(self.memo.get, chunks))
        missed = [i for i, x in enumerate(found) if x is None]
        if missed:
            new = list({chunks[i] for i in missed})
            fresh = dict(zip(new, self.encode(new), strict=True))
            for i in missed:
                found[i] = fresh[chunks[i]]
            for c, ids in fresh.items():
                if len(c) <= self.chunk_bytes:
                    self.memo[c] = ids
                    self.bytes += ENTRY_BYTES + len(c) + len(ids)
        flat = np.frombuffer(b"".join(found), self.dtype)
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))) // self.dtype.itemsize
        stops = ends[np.cumsum(counts)].tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops, strict=False)]
