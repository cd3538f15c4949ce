"""Small inputs shared by the operator tests."""

import random

#: Columns that clash with names used inside or returned by operators.
CLASH = "n_tokens long, kept boolean, doc string, row string, level string, name string, comp long, rep long, ids string, piece string, length string, spans string, secret_spans string, start string, n long, t string, key string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
N_CLASH = len(CLASH.split(", "))


def frame(spark, rows):
    """(doc_id, text) pairs with all other columns null."""
    return spark.createDataFrame([(i, t, None, None, None, *[None] * N_CLASH) for i, t in rows], SCHEMA)


def awkward(seed=0, count=120):
    """Nulls, empty and long texts, repeated rows, ties, odd characters."""
    rng = random.Random(seed)
    alphabet = "abcdefgh   \n\t.,!?#|éß日😀'\x0b\x1c\x850123456789@+-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(count)]
    texts += [None, "", " ", "\n", "a", "x" * 20_000, "word " * 6_000, "don't <|endoftext|> stop", "a  b", "a b", "a\tb"]
    rows = list(enumerate(texts))
    return [*rows, (5_000, texts[3]), (5_001, texts[3]), (5_000, texts[3])]
