import re

import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def split_words(text, lower=False):
    """Words of a text as bytes, as the contracts define them."""
    raw = (text or "").encode()
    if lower:
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    return WORD.findall(raw)


ODD = [
    (1, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 4, "one"),
    (2, None, "null text"),
    (3, "", "empty"),
    (4, " \t\n ", "only space"),
    (5, "word", "short"),
    (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 4, "copy of 1"),
    (7, "Ünïcödé é  x　y <|endoftext|> it's 12³ Σ ς \x1c!!", "odd characters"),
    (8, "long " * 30000 + "tail", "very long"),
    (9, "Same line here\nSame line here\n\nSame line here\n", "lines"),
    (9, "Same line here\nSame line here\n\nSame line here\n", "repeated row"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeats, and extra columns with names that operators use."""
    schema = "doc_id long, text string, source string, key string, shard string, row int, code int, n int, score string, kept string, label int"
    return spark.createDataFrame([(i, t, s, "k", "s", 1, 2, 3, "x", "y", 4) for i, t, s in ODD], schema)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
