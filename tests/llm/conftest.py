import random

import pytest

#: Names that operators use for columns of their own.
CLASHING = ["id", "fp", "key", "keys", "h", "c", "first", "block", "train", "n_words", "n_lines", "n_dropped", "slot", "component_id", "length", "offset", "hits", "words", "lines", "uid", "digest", "refers_to", "payload", "record_id", "matched", "host", "path", "p", "v", "u", "m", "size", "same", "n", "sketch", "item", "score", "lang_pred", "shard", "ids"]
TEXTS = [
    None, "", " ", "\n", "\n\n \n", "word", "two words", "ÄÖ é", "123 456 !!!", "a", "A", "same text again and again", "same text again and again",
    "The quick brown fox jumps over the lazy dog and runs away from the very big bear",
    "the QUICK brown fox jumps over the lazy dog and runs away from the very big bear!",
    "tab\tand\x0bvertical\x0cfeed\rreturn\x1cseparator\xa0nbsp wide",
    "\U0001f600 emoji ퟿ edge " * 3, "x" * 3000, "rep " * 500, "<|endoftext|> special", "line one is a rather long line that will repeat everywhere\nshort\n" * 3,
]


def rng_text(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{int(r.paretovariate(0.7)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls everywhere, empty and long texts, repeated rows and ids, clashing extra columns."""
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s1", None, "s2")[i % 3]) for i, t in enumerate(TEXTS)]
    rows += [(len(rows), rng_text(1, 30_000), "en", "s1"), (None, None, None, None), (None, "a null id with words", "en", None), rows[13], rows[13], (5, "another version of five", "fr", "s1"), (-7, "negative id", "en", "s1")]
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHING)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHING))


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.where("false")
