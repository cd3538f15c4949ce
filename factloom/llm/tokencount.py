"""Operator 10: exact token counts at every prefix.

For a pre-token the encoding of each of its prefixes follows from shorter prefixes: it ends in the one
vocabulary token that forms a stable pair with the last token of the prefix before it. One pass therefore
yields the count at every byte, in time linear in the text, and counts of whole texts are sums over pre-tokens.
Truncation and budget questions read the table instead of encoding again.

A prefix may end inside a pre-token in a way that changes how the text is cut: inside a run of white space,
inside a contraction, or behind a space whose word is cut away. ``prefix_counts`` answers these too.

Null and empty texts count nothing. Special strings inside a text count as one token each, as the library has it. Very long
texts are counted whole, repeated rows one by one; an empty table gives no rows. Columns other than key and text are not
read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.tokenfiles import vocabulary
from factloom.session import ship

#: Fixed value: the pre-tokenization pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that keeps a text from being cut at single spaces and line ends.
_AWKWARD = re.compile("[ \\n][ \\n]|[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000]")
_CHUNK = re.compile(r" ?[^ \n]+|[ \n]")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in the vocabulary file: printable Latin-1 characters stand for
    themselves, all other bytes for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, path: str, entries: int = 1_000_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = _byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.vocab = {raw(s): i for s, i in vocab.items() if all(c in letter for c in s)}
        self.bytes_of = {i: b for b, i in self.vocab.items()}
        self.merge_rank = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge_rank[raw(a), raw(b)] = k
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pretoken = regex.compile(PATTERN)
        # what ends a token: its number where it is one itself, else -1
        self.tails = {b[k:]: -1 for b in self.vocab for k in range(len(b))} | self.vocab
        self.stable: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.words: dict[bytes, tuple[int, ...]] = {}
        self.chunks: dict[str, int] = {}
        self.entries = entries

    def merge(self, word: bytes) -> list[int]:
        """Plain merging by rank, for pairs of tokens only."""
        parts = [word[i : i + 1] for i in range(len(word))]
        rank = self.merge_rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 40))
            if (parts[best], parts[best + 1]) not in rank:
                break
            pair = (parts[best], parts[best + 1])
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.vocab[p] for p in parts]

    def _stable(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.stable.get(key)
        if got is None:
            if len(self.stable) > 2 * self.entries:
                self.stable.clear()
            got = self.stable[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def _alone(self, a: int) -> bool:
        got = self.alone.get(a)
        if got is None:
            got = self.alone[a] = self.merge(self.bytes_of[a]) == [a]
        return got

    def word(self, w: bytes) -> tuple[int, ...]:
        """Tokens of every prefix of a pre-token, from one byte to all."""
        got = self.words.get(w)
        if got is None:
            if len(self.words) > self.entries:
                self.words.clear()
            got = self.learn([w])[w]
        return got

    def learn(self, new: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """``word`` of each pre-token. They are taken in order, so a prefix that one shares with the one before is not
        gone over again.

        Of the tokens that end a prefix the longest that is stable behind what is before it counts. They are looked up
        from the end on, as long as what has been read ends some token."""
        tails, known, stable, out = self.tails, self.stable, self._stable, {}
        before, last, count = b"", [0], [0]
        for w in sorted(new):
            n, k = len(w), 0
            for x, y in zip(w, before):  # noqa: B905
                if x != y:
                    break
                k += 1
            del last[k + 1 :], count[k + 1 :]
            for i in range(k + 1, n + 1):
                hits = []
                for j in range(i - 1, -1, -1):
                    t = tails.get(w[j:i])
                    if t is None:
                        break
                    if t >= 0:
                        hits.append((j, t))
                while hits:
                    j, t = hits.pop()
                    if j:
                        fit = known.get(last[j] << 20 | t)
                        if fit is None:
                            fit = stable(last[j], t)
                    else:
                        fit = self._alone(t)
                    if fit:
                        last.append(t)
                        count.append(count[j] + 1)
                        break
                else:
                    raise ValueError("a byte without a token")
            before, out[w] = w, tuple(count[1:])
            if n <= 256:
                self.words[w] = out[w]
        return out

    def cut(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pre-tokens in order; true marks special strings."""
        at = 0
        for m in self.special_at.finditer(text) if self.special_at else ():
            yield from ((w, False) for w in self.pretoken.findall(text[at : m.start()]))
            yield m.group(), True
            at = m.end()
        yield from ((w, False) for w in self.pretoken.findall(text[at:]))

    def _parts(self, text: str) -> list[str]:
        """Stretches that are cut the same alone as in the text."""
        if _AWKWARD.search(text) or any(s in text for s in self.special):
            return [text] if any(s in text for s in self.special) else self.pretoken.findall(text)
        return _CHUNK.findall(text)

    def count(self, text: str | None) -> int:
        return sum(self._totals([text])[0][1]) if text else 0

    def _totals(self, texts: Sequence[str]) -> list[tuple[list[str], list[int]]]:
        """Parts of each text and their tokens. What is new to all of them is learned at once."""
        for memo in (self.chunks, self.words):
            if len(memo) > self.entries:
                memo.clear()
        chunks, parts = self.chunks, [self._parts(t) for t in texts]
        cuts = {p: list(self.cut(p)) for p in {p for ps in parts for p in ps if p not in chunks}}
        words = {w: w.encode() for cut in cuts.values() for w, special in cut if not special}
        fresh = self.learn({b for b in words.values() if b not in self.words})
        size = {w: (fresh.get(b) or self.words[b])[-1] for w, b in words.items()}
        long = {}
        for p, cut in cuts.items():
            (chunks if len(p) <= 256 else long)[p] = sum(1 if special else size[w] for w, special in cut)
        return [(ps, [chunks[p] if p in chunks else long[p] for p in ps] if long else list(map(chunks.__getitem__, ps))) for ps in parts]

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Entry k: tokens of the first k characters, encoded on their own; entry 0 is 0."""
        text = text or ""
        out = np.zeros(len(text) + 1, np.int64)
        at, before, held = 0, 0, ""
        for w, special in self.cut(text):
            b = w.encode()
            if special:  # a part of a special string is ordinary text
                for k in range(1, len(w)):
                    out[at + k] = self._open(text, at + k)
                out[at + len(w)] = before + 1
            else:
                by = np.array(self.word(b))
                ends = np.cumsum([len(c.encode()) for c in w]) - 1
                out[at + 1 : at + len(w) + 1] = before + by[ends]
                plain = len(w) < 2 or not (w[0] == "'" or w.isspace())
                if not plain:
                    for k in range(1, len(w)):
                        out[at + k] = self._open(text, at + k)
                if w[0] == " " and held.isspace() and held:  # the space joins the white space before it
                    out[at + 1] = self._open(text, at + 1)
            at, before, held = at + len(w), before + (1 if special else self.word(b)[-1]), w
            if w.isspace() and at < len(text):
                out[at] = self._open(text, at)
        return out

    def _open(self, text: str, k: int) -> int:
        """Count of a prefix whose last pre-tokens differ from the text's own: only the stretch behind the last
        sure boundary, a word end before white space, is cut again."""
        lo = k
        while lo > 0 and text[lo - 1].isspace():
            lo -= 1
        while lo > 0 and not text[lo - 1].isspace():
            lo -= 1
        if lo > 0:
            while lo > 0 and text[lo - 1].isspace():
                lo -= 1
        return self.count(text[:lo]) + self.count(text[lo:k])

    def fits(self, text: str | None, budget: int) -> int:
        """Most leading characters, up to the end of a pre-token or inside the one where the budget ends, that
        have at most ``budget`` tokens. Pre-tokens are summed; only the last is looked into."""
        return next(self.counts_and_fits([text], budget))[1]

    def counts_and_fits(self, texts: Sequence[str | None], budget: int, group_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
        """``count`` and ``fits`` of each text in one pass, for bounded groups of texts."""
        group, size = [], 0
        for k, text in enumerate(texts, 1):
            group.append(text or "")
            size += len(group[-1])
            if size > group_chars or k == len(texts):
                for t, (parts, totals) in zip(group, self._totals(group), strict=True):
                    whole = sum(totals)
                    yield whole, len(t) if whole <= budget else self._cut_at(parts, totals, budget)
                group, size = [], 0

    def _cut_at(self, parts: list[str], totals: list[int], budget: int) -> int:
        at = used = 0
        for part, n in zip(parts, totals, strict=True):
            if used + n > budget:
                for w, special in self.cut(part):
                    c = 1 if special else self.word(w.encode())[-1]
                    if used + c > budget:
                        if not special and not w.isspace() and w[0] != "'":
                            by = np.array(self.word(w.encode()))[np.cumsum([len(x.encode()) for x in w]) - 1]
                            at += int(np.flatnonzero(used + by <= budget).max(initial=-1)) + 1
                        return at
                    used, at = used + c, at + len(w)
            used, at = used + n, at + len(part)
        return at


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 512, folder: str | None = None, prefixes: bool = False) -> DataFrame:
    """One row per document: ``key``, ``n_bytes``, ``n_tokens``, ``over_limit``, ``fit_chars`` (leading characters
    within the limit) and, if asked for, ``prefix_counts``."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary(tokenizer, folder))
        for b in batches:
            texts: Sequence[str | None] = b.column(1).to_pylist()
            both = list(c.counts_and_fits(texts, limit))
            n = [x for x, _ in both]
            cols = [b.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array([x for _, x in both], pa.int64())]
            if prefixes:
                cols.append(pa.array([c.prefix_counts(t).astype(np.int32) for t in texts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[key, "n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_counts"][: len(cols)])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + (", prefix_counts array<int>" if prefixes else ""))
