"""Awkward documents for every operator, and small brute-force helpers."""
from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, key string, kept int"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ne", "ru", "sa", "to", "vi", "el", "or", "an", "est"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("\n" if i % 12 == 11 else "") for i, w in enumerate(words))


def awkward(spark):
    """NULLs in every column, empty, blank and long texts, copies, repeated rows, clashing columns."""
    base, other = prose(1, 300), prose(2, 300)
    long = prose(3, 30_000)
    texts = [base, base, base.upper(), other, other + " tail", None, "", "  \n\t ", "one", "one", "x" * 5000, "a " * 400,
             "same line\n" * 30, long, "日本語 テキスト é ß 😀", "\n", prose(4, 25), "|" * 300]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s3"][i % 4], i, "x", "k", 1) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[5], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return tuple((v is None, str(v)) for v in x)


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
