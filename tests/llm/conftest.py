import random

import pytest


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt"]
    known = ["".join(rng.choices(syllables, k=1 + i % 4)) for i in range(vocabulary)]
    out = []
    for i in range(words):
        word = rng.choice(known)
        out.append(word.capitalize() if i % 11 == 0 else word + (".\n" if i % 17 == 16 else "." if i % 11 == 10 else ""))
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def prose_of():
    return prose


#: Texts that every text operator must take: null, empty, blank, short, repeated, odd characters, long.
ODD = [None, "", " \t\n", "a", "a", "Ünïcödé ß 中文 😀", "x" * 5000, " ".join(["same"] * 300), "1 2 3 @ + . <|endoftext|>", "\x00\x1c ", "word " * 40_000]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with null and repeated ids, and columns whose names clash with what operators make."""
    rows = [(None if i == 3 else i % 9, t, None if i % 2 else "en", "src", i, 1.0, True) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, score double, kept boolean").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
