import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, h long, kept boolean, score double, shard string, slot string, size string, member string, pos int, id long, n_rows int"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples, with extra columns whose names operators use inside."""

    def make(rows):
        rows = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", 1, True, 0.5, "s", "t", "u", "v", 3, 4, 5) for r in rows], COLUMNS)

    return make


@pytest.fixture(scope="session")
def prose():
    """Random sentences of a seed."""
    syllables = "an be co de er fi go hu in jo ka lo mi no or pa re si to un".split()

    def make(n, seed):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return make


EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "A single line"), (5, "a SINGLE line"), (5, "a SINGLE line"), (6, "É a\n\nb   c"), (None, "a single line"),
    (7, "word " * 6000, "en", "s1"), (8, "one two three", "en", "s1"), (9, "ONE two\nthree", None, None), (10, "x" * 70_000, "de", "s2"), (11, "日本語 テキスト", "ja", ""),
]


@pytest.fixture(scope="session")
def edges():
    return EDGES
