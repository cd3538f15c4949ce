"""Token ids of the lower-casing word tokenizer, by way of the tokenizers library and a memo of words.

The library cuts a text into letter runs, single digits, runs of other characters and contractions, and encodes
each on its own. A text is cut here where it surely cuts too: between letters and other characters, and at
white space. What follows an apostrophe stays whole, and so do stretches with characters whose normal form or
kind depends on their neighbours. Letter runs that are new are encoded together in one text: the last id of each
run, and no other, carries the word end. Null text counts as empty.

All texts of a group lie in one byte array; their units are places in it, looked up together by their bytes, so
that only new units longer than 16 bytes, or other than letters, become objects of their own.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

#: Kinds of bytes: white space 0, letters and all beyond ASCII 1, anything else 2.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*b" \t\n\r\x0b\x0c"]] = 0
_KIND[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
#: Beyond ASCII, letters that no normal form changes and that have one lower-case letter; all others are odd.
_ODD = re.compile("[^\x00-\x7fÀ-ÖØ-öø-įı-ɏ]")
_JOINED = 4_000
#: Bytes of a unit that the memo can hold, and masks that keep the first 0 to 8 bytes of a little-endian number.
_KEY = 16
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _cut(raws: list[bytes], odd: list[int]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, where their units begin and end, which are runs of plain letters, and how many
    each text has. Units are stretches of one kind, but for what an apostrophe leads; of odd texts, stretches
    without white space."""
    buf = b"\n".join([*raws, bytes(_KEY)])
    a = np.frombuffer(buf, np.uint8, len(buf) - _KEY)
    first = np.cumsum([0, *(len(r) + 1 for r in raws[:-1])])
    kind = _KIND[a]
    solid = kind != 0
    whole = np.zeros(len(a), bool)
    for i in odd:
        whole[first[i] : first[i] + len(raws[i])] = True
    at = np.flatnonzero((kind[1:] != kind[:-1]) & solid[1:] & solid[:-1] & ~whole[1:]) + 1
    quote = np.flatnonzero(a == 39)
    if len(quote) and len(at):
        space = np.flatnonzero(~solid)
        quote, space = np.concatenate(([-1], quote)), np.concatenate(([-1], space))
        at = at[quote[np.searchsorted(quote, at) - 1] <= space[np.searchsorted(space, at) - 1]]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[at] = True
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | begins[1:]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    letters = (kind[start] == 1) & ~whole[start]  # what an apostrophe leads begins with it
    return buf, start, stop, letters, np.add.reduceat(begins.astype(np.int64), first)


class WordMemo:
    """Ids of units of up to 16 bytes. Each unit has one place, found by its bytes and checked against all of
    them and its length; a unit that wants a taken place replaces its holder. Emptied when ``most_ids`` ids are held."""

    def __init__(self, dtype: str, places_log2: int = 20, most_ids: int = 4 << 20):
        self.shift, self.most_ids = np.uint64(64 - places_log2), most_ids
        n = 1 << places_log2
        self.low, self.high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.size, self.count, self.offset = np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.zeros(n, np.int32)
        self.pool, self.used = np.empty(1 << 16, dtype), 0

    def begin(self) -> None:
        if self.used > self.most_ids:
            self.size.fill(0)
            self.pool, self.used = np.empty(1 << 16, self.pool.dtype), 0

    def keys(self, buf: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second eight bytes of each unit, zero beyond its end, and its place."""
        at_any = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
        low = at_any[start] & _MASK[np.minimum(size, 8)]
        high = np.zeros(len(start), np.uint64)
        long = np.flatnonzero(size > 8)
        high[long] = at_any[start[long] + 8] & _MASK[np.minimum(size[long] - 8, 8)]
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return low, high, ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (self.low[place] == low) & (self.high[place] == high) & (self.size[place] == size)

    def add(self, ids: np.ndarray) -> int:
        """Append ids to the pool; where they begin."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            grown = np.empty(max(self.used, 2 * len(self.pool)), self.pool.dtype)
            grown[:at] = self.pool[:at]
            self.pool = grown
        self.pool[at : self.used] = ids
        return at

    def keep(self, place: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray, offset: np.ndarray, count: np.ndarray) -> None:
        place, one = np.unique(place, return_index=True)
        self.low[place], self.high[place], self.size[place] = low[one], high[one], size[one]
        self.offset[place], self.count[place] = offset[one], count[one]


class WordTokens:
    def __init__(self, path: str, end_id: int | None, group_bytes: int = 1_000_000, **memo):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        # the same model for plain letter runs: there is nothing to normalise but case, and nothing to cut but spaces
        self.plain = Tokenizer(self.lib.model)
        self.plain.normalizer = normalizers.Lowercase()
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.size = self.lib.get_vocab_size()
        self.dtype = "<u2" if self.size <= 1 << 16 else "<u4"
        self.tail = np.array([] if end_id is None else [end_id], self.dtype)
        self.ends = np.zeros(self.size, bool)
        suffix = self.lib.model.end_of_word_suffix
        if not suffix:
            raise ValueError("only tokenizers that mark the end of a word are supported")
        for token, i in self.lib.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith(suffix)
        self.group_bytes = group_bytes
        self.memo = WordMemo(self.dtype, **memo)

    def _together(self, runs: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``n`` letter runs with spaces between, and where those of each run stop."""
        ids = np.array(self.plain.encode_batch_fast([runs.decode()], add_special_tokens=False)[0].ids, self.dtype)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != n:
            raise AssertionError("a letter run has more than one word end")
        return ids, stops

    def _runs(self, buf: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of letter runs that lie in ``buf``, and how many each has."""
        a, ids, counts = np.frombuffer(buf, np.uint8), [], []
        for lo in range(0, len(start), _JOINED):
            wide = size[lo : lo + _JOINED] + 1
            ends = np.cumsum(wide)
            runs = a[np.repeat(start[lo : lo + _JOINED] - (ends - wide), wide) + np.arange(ends[-1])]
            runs[ends - 1] = 32
            some, stops = self._together(runs[:-1].tobytes(), len(wide))
            ids.append(some)
            counts.append(np.diff(stops, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def _units(self, units: list[bytes]) -> list[np.ndarray]:
        """Ids of any units, one by one but for plain letter runs."""
        out: dict[bytes, np.ndarray] = {}
        letters = [u for u in units if _LETTERS.fullmatch(u) and (u.isascii() or _ODD.search(u.decode()) is None)]
        for lo in range(0, len(letters), _JOINED):
            some = letters[lo : lo + _JOINED]
            ids, stops = self._together(b" ".join(some), len(some))
            out.update(zip(some, np.split(ids, stops[:-1]), strict=True))
        rest = [u for u in units if u not in out]
        for lo in range(0, len(rest), _JOINED):
            some = rest[lo : lo + _JOINED]
            for u, e in zip(some, self.lib.encode_batch_fast([u.decode() for u in some], add_special_tokens=False), strict=True):
                out[u] = np.array(e.ids, self.dtype)
        return [out[u] for u in units]

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        memo = self.memo
        memo.begin()
        # an odd text may hold a special string, or odd characters
        odd = [i for i, t in enumerate(texts) if "<|" in t or not (t.isascii() or _ODD.search(t) is None)]
        raws = [t.encode() for t in texts]
        skip = set(odd)
        buf, start, stop, letters, counts = _cut([r if i in skip else r.lower() for i, r in enumerate(raws)], odd)
        size = stop - start
        low, high, place = memo.keys(buf, start, size)
        hit = memo.find(low, high, size, place)
        offset, n = memo.offset[place].astype(np.int64), memo.count[place].astype(np.int64)
        missed = np.flatnonzero(~hit)
        short = letters[missed] & (size[missed] <= _KEY)
        runs = missed[short]
        if len(runs):  # letters are never zero, so their key alone tells them apart
            runs = runs[np.lexsort((low[runs], high[runs]))]
            new = np.ones(len(runs), bool)
            new[1:] = (low[runs[1:]] != low[runs[:-1]]) | (high[runs[1:]] != high[runs[:-1]])
            one = runs[new]
            ids, own = self._runs(buf, start[one], size[one])
            begin = memo.add(ids) + np.cumsum(own) - own
            memo.keep(place[one], low[one], high[one], size[one], begin, own)
            which = np.cumsum(new) - 1
            offset[runs], n[runs] = begin[which], own[which]
        rest = missed[~short]
        if len(rest):
            units = [buf[a:b] for a, b in zip(start[rest].tolist(), stop[rest].tolist(), strict=True)]
            number = {u: i for i, u in enumerate(dict.fromkeys(units))}
            ids = self._units(list(number))
            own = np.fromiter(map(len, ids), np.int64, len(ids))
            begin = memo.add(np.concatenate(ids)) + np.cumsum(own) - own
            which = np.fromiter(map(number.__getitem__, units), np.int64, len(units))
            offset[rest], n[rest] = begin[which], own[which]
            fits = rest[(size[rest] <= _KEY) & (n[rest] < 256)]
            memo.keep(place[fits], low[fits], high[fits], size[fits], offset[fits], n[fits])
        ends = np.cumsum(n)
        flat = memo.pool[np.repeat(offset - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.concatenate(([0], ends))[np.cumsum(counts)].tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text with the end id; the work is done at once for a bounded group of texts."""
        out, group, size = [], [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size > self.group_bytes:
                out += self._group(group)
                group, size = [], 0
        if group:
            out += self._group(group)
        return [np.concatenate((x, self.tail)) for x in out]


@lru_cache(maxsize=2)
def word_tokens(path: str, end_id: int | None) -> WordTokens:
    return WordTokens(path, end_id)
