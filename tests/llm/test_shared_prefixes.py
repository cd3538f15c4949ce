"""Operator 10 learns new words in order, so that what they share is gone over once."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from factloom.llm import tokencount


class _Counted(dict):
    asked = 0

    def get(self, *a):
        self.asked += 1
        return super().get(*a)


def test_shared_prefixes_are_gone_over_once():
    c = tokencount.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    c.tails = _Counted(c.tails)
    words = [b" onerhastanerheit" + bytes([k]) for k in range(97, 117)]
    c.learn(words[:1])
    once, c.tails.asked = c.tails.asked, 0
    c.learn(words)
    assert c.tails.asked < 6 * once


def test_counts_do_not_depend_on_what_is_remembered():
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(5)
    lib = Tokenizer.from_file(path)
    texts = [None, ""] + [" ".join("".join(rng.choice(["on", "er", "ha", "é", "zu", "'s", "7", "日"]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(30))) for _ in range(60)] + ["x" * 700, "a<|endoftext|>b "]
    want = [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for entries, group in ((3, 50), (1_000_000, 4_000_000)):
        c = tokencount.PrefixCounter(path, entries)
        got = list(c.counts_and_fits(texts, 12, group))
        assert [n for n, _ in got] == want and [k for _, k in got] == [c.fits(t, 12) for t in texts]
