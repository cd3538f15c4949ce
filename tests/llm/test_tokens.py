"""Piece encoding, word tokens, token files, prefix counts and packing against the libraries."""

import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from common import awkward, frame
from factloom.llm import packing, pieces, tokencount, tokenfile
from factloom.llm.wordtokens import WordTokens

TEXTS = [t for _, t in awkward(1, 300)]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_pieces_equal_the_library(sp):
    c = pieces.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    dense = ["".join(rng.choice("ab ▁\n=-") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    for t in [*TEXTS, *dense, "        a", "▁▁ ▁", "=" * 99, "</s><unk><0x41>"]:
        ids = c.encode([t])[0]
        assert ids.tolist() == sp.encode(t or "", add_eos=True), t
        assert c.decode(ids) == sp.decode(ids.tolist())


@pytest.mark.parametrize("text", [" " * 1_000_000, "#" * 1_000_000, " " * 300_001 + "word", "x" + " " * 70_007 + "#" * 999 + "\n" + " " * 65_536, "ter" * 100_000, "\t" * 50_000, "# " * 50_000, "a" * 300_000])
def test_long_runs_of_pieces(sp, text):
    c = pieces.codec(public_tokenizers.path("piece_bpe_32k.model"))
    assert c.encode([text])[0].tolist() == sp.encode(text, add_eos=True)


def test_runs_of_pieces_next_to_others(sp):
    c = pieces.codec(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(7)
    texts = [" " * n + tail for n in range(130) for tail in ("", "a", "#", "the", "\n", "/")]
    for alphabet in (" ▁#", "  a#", "tehrionsand ", "ab \n=-", "#▁ .", "1 2/"):
        texts += ["".join(rng.choice(alphabet) * rng.choice((1, 1, 2, 3, 9, 40)) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    for t, ids in zip(texts, c.encode(texts), strict=True):
        assert ids.tolist() == sp.encode(t, add_eos=True), t


def test_decoding_any_ids(sp):
    c = pieces.codec(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 29871]) for _ in range(rng.randint(0, 12))]
        assert c.decode(np.array(ids, int)) == sp.decode(ids)


def test_piece_query(spark, sp):
    rows = awkward(2, 40)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode_documents(frame(spark, rows), digest=True).collect())
    want = []
    for i, t in rows:
        ids = sp.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert pieces.encode_documents(frame(spark, [])).count() == 0


def test_word_tokens_equal_the_library(words):
    w = WordTokens(public_tokenizers.path("word_bpe_49k.json"), 1)
    more = ["don't stop's 'S I'LL it's.'t", "foo<|endoftext|>bar <|EndOfText|>", "x'.s word's. ...'s", "İ K ſ Å é ̈x"]
    for t in [*TEXTS, *more]:
        assert w.encode([t])[0].tolist() == [*words.encode(t or "", add_special_tokens=False).ids, 1], t


def test_word_tokens_of_any_mixture(words):
    w = WordTokens(public_tokenizers.path("word_bpe_49k.json"), 1)
    rng = random.Random(8)
    texts = []
    for alphabet in ("ab '.,\"1", "it's \n'tVe'", "aé—’\t.'1", "aİéͅA\u0300.¡ '", "ab\x1c\x85\xa0.,1", "ß×÷ÿĀɏɐ a.", "<|>ab' endoftext", "AZaz\x80\x7f'\x00 "):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for _ in range(2):  # with an empty and with a filled memo
        for t, ids in zip(texts, w.encode(texts), strict=True):
            assert ids.tolist() == [*words.encode(t, add_special_tokens=False).ids, 1], t


@pytest.mark.parametrize("places_log2", [1, 6, 20])
def test_the_memo_is_bounded(words, places_log2):
    """Units that share a place, that differ only past their eighth byte or by zero bytes, and long ones."""
    w = WordTokens(public_tokenizers.path("word_bpe_49k.json"), 1, group_bytes=500, places_log2=places_log2, most_ids=2_000)
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 18))) for _ in range(40)) for _ in range(200)]
    texts += ["x" * 50_000, "abcdefghi abcdefghj abcdefgh abcdefghijklmnop abcdefghijklmnopq", "a a\x00 \x00 \x00\x00 !!!!!!!!! !!!!!!!!!\x00"] * 2
    for t in texts:
        assert w.encode([t])[0].tolist() == [*words.encode(t, add_special_tokens=False).ids, 1]
        assert w.memo.used < 2_000 + 40_000
    w.encode(["a", "b"])
    assert w.memo.used <= 2_000 and len(w.memo.pool) == 1 << 16


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 32])
def test_bit_packing(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 70_001).astype(np.uint32)
    p = tokenfile.pack(x, bits)
    assert len(p) == (len(x) * bits + 7) // 8
    assert (tokenfile.unpack(p, bits, 0, len(x)) == x).all()
    assert (tokenfile.unpack(p, bits, 777, 66_001) == x[777:66_001]).all()


def test_token_file(spark, words, tmp_path):
    rows = [r for r in awkward(3, 60) if r[0] != 5_000] + [(None, "no key")]
    path = str(tmp_path / "f")
    tokenfile.write_token_file(frame(spark, rows), path, block_ids=500)
    got = {r.doc_id: r for r in tokenfile.read_token_file(spark, path).collect()}
    at = 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*words.encode(t or "", add_special_tokens=False).ids, 1]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(ids), zlib.crc32(np.array(ids, "<u4")), ids)
        at += len(ids)
    assert {r.doc_id: r.ids for r in tokenfile.fetch(spark, path, [3, 7]).collect()} == {k: got[k].ids for k in (3, 7)}


def test_token_file_without_or_with_one_key(spark, words, tmp_path, monkeypatch):
    """All rows under one key: they fall into several shards, all are kept, and places have no gap."""
    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 400)
    for own in (None, 7):
        rows = [(own, f"text {i} of many") for i in range(60)] + [(own, "same")] * 40 + [(own, None), (own, "w " * 30_000)]
        path = str(tmp_path / f"k{own}")
        tokenfile.write_token_file(frame(spark, rows).repartition(3), path, block_ids=64)
        got = sorted(tokenfile.read_token_file(spark, path).collect(), key=lambda r: r.start)
        assert len({r.shard for r in spark.read.parquet(path).collect()}) > 3
        at = 0
        for r in got:
            assert r.doc_id == own and r.start == at and r.n_tokens == len(r.ids)
            at += r.n_tokens
        want = sorted([*words.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows)
        assert sorted(r.ids for r in got) == want


def test_token_file_by_string_keys(spark, words, tmp_path):
    path = str(tmp_path / "s")
    docs = spark.createDataFrame([(f"k{i:03}", f"a text {i}") for i in range(300)] + [(None, "x")], "name string, text string")
    tokenfile.write_token_file(docs, path, key="name", block_ids=20)
    got = {r.name: r.start for r in tokenfile.read_token_file(spark, path, key="name", ids=False).collect()}
    assert sorted(got, key=lambda k: (k is not None, k or "")) == sorted(got, key=got.get)
    found = {r.name: r.ids for r in tokenfile.fetch(spark, path, ["k007", "k250", "nobody"], key="name").collect()}
    assert found == {k: [*words.encode(f"a text {int(k[1:])}", add_special_tokens=False).ids, 1] for k in ("k007", "k250")}


@pytest.mark.parametrize("size, bits", [(49_408, 16), (70_000, 17), (300, 9)])
def test_width(size, bits):
    assert tokenfile.width(size) == bits


def test_empty_token_file(spark, tmp_path):
    path = str(tmp_path / "e")
    tokenfile.write_token_file(frame(spark, []), path)
    assert tokenfile.read_token_file(spark, path).count() == 0


def test_prefix_counts_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    c, lib = tokencount.PrefixCounter(path), Tokenizer.from_file(path)
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for t in TEXTS:
        assert c.count(t) == n(t or ""), t
    for t in [*[x[:80] for x in TEXTS if x], "it's we're  x'll \n\n a<|endoftext|>b", "  lead", "end  "]:
        counts = c.prefix_counts(t)
        assert counts.tolist() == [n(t[:k]) for k in range(len(t) + 1)], t
        for budget in (0, 1, 5, 12):
            k = c.fits(t, budget)
            assert counts[k] <= budget


def test_count_query(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = awkward(4, 40)
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(frame(spark, rows)).collect())
    n = {t: len(lib.encode(t or "", add_special_tokens=False).ids) for _, t in rows}
    assert got == sorted((i, len((t or "").encode()), n[t], n[t] > 512) for i, t in rows)
    assert tokencount.token_counts(frame(spark, [])).count() == 0


def _valid(seq, offset, lengths, cap):
    fill = {}
    for i in np.lexsort((offset, seq)):
        assert offset[i] == fill.get(seq[i], 0)
        fill[seq[i]] = offset[i] + lengths[i]
        assert fill[seq[i]] <= cap
    return len(fill)


@pytest.mark.parametrize("kind", ["mixed", "uniform", "full", "ties"])
def test_best_fit(kind):
    rng = np.random.default_rng(1)
    n = {"mixed": np.minimum(4096, rng.lognormal(6, 1.2, 3000).astype(int) + 1), "uniform": rng.integers(1, 4097, 2500), "full": np.full(50, 4096), "ties": np.full(999, 1000)}[kind]
    bins = _valid(*packing.best_fit(n), n, 4096)
    least = -(-int(n.sum()) // 4096)
    assert least <= bins <= _plain(n, 4096)


def _plain(lengths, cap):
    """Best-fit decreasing, one piece at a time."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(cap - n)
    return len(left)


def test_best_fit_constraints():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 200, 800)
    for score in ("norm", "dot"):
        seq, offset = packing.best_fit(n, 1000, documents=6, attention=40_000, score=score)
        _valid(seq, offset, n, 1000)
        for s in set(seq):
            assert (seq == s).sum() <= 6 and (n[seq == s] ** 2).sum() <= 40_000
    with pytest.raises(ValueError):
        packing.best_fit(np.array([5]), 4)
    assert len(packing.best_fit(np.array([], int))[0]) == 0


def test_packing_query(spark, words):
    rows = [*awkward(5, 60), (None, "no key")]
    r = packing.pack_documents(frame(spark, rows)).toPandas()
    want = []
    for i, t in rows:
        ids = np.array([*words.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(-1 if i is None else i, s // 4096, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096])) for s in range(0, len(ids), 4096)]
    got = [(-1 if x[0] != x[0] else int(x[0]), *x[1:]) for x in r[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)]
    assert sorted(got) == sorted(want)
    assert _valid(r.sequence_id.to_numpy(), r.offset.to_numpy(), r.length.to_numpy(), 4096) <= -(-r.length.sum() // 4096) + 1
    assert packing.pack_documents(frame(spark, [])).count() == 0
