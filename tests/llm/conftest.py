import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, label string, row string, word string, shard string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, near copies, a very long text; columns whose names clash with internal ones."""
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Of", "the", "tion", "über", "naïve", "x1", "und."]
    long = " ".join(r.choice(words) + str(i % 97) for i in range(30_000))
    base = [f"{r.choice(words)}{i}" for i in range(120)]
    rows = [None, "", " \t\n ", "one", "one two three four", "one two three four", long, long + " tail", "a a a a a a a a a a"]
    for k in range(12):
        copy = list(base)
        for i in r.sample(range(120), k // 3):
            copy[i] = f"new{k}_{i}"
        rows.append(" ".join(copy))
    rows += [" ".join(base), " ".join(base).upper(), "日本語 テスト 文 です ね", "\x00 odd \x1c control\r\n", "line\nline\nline\n|||| ####"]
    out = [(i, t, "en" if i % 3 else "de", "s", len(t or ""), "n", "l", "r", "w", "s") for i, t in enumerate(rows)]
    return out + [out[9], out[9], (None, "one two three four", "en", "s", 18, "n", "l", "r", "w", "s"), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
