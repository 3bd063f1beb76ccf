import random

import pytest
from pyspark.sql import types as T

# columns that operators also use as names of their own
EXTRA = ("lang", "source", "n_chars", "chunk", "key", "score", "n_words", "fingerprint", "rank", "node", "spans", "ids")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       *(T.StructField(c, T.StringType()) for c in EXTRA)])


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(1, 9))) for _ in range(n))


def edge_texts() -> list[tuple[int | None, str | None]]:
    """Null and empty texts, blanks, ties, repeated rows and ids, null ids, a very long text."""
    shared = words(1, 70)
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, words(2, 120)),
        (5, shared + " " + words(3, 40)), (6, words(4, 30) + "\n" + shared), (6, words(4, 30) + "\n" + shared),
        (7, shared), (8, shared), (None, shared), (None, None), (9, words(5, 60_000)),
        (10, "x " * 400), (11, "Ünïcödé ça　dé " * 30 + "\U0001f600"), (12, words(2, 120)),
        (13, words(2, 60) + "  " + words(2, 120)), (14, "y" * 5000), (15, "y" * 4000 + "z"),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge texts with extra columns, some null."""
    rows = [(i, t, *(None if k % 3 else c for k, c in enumerate(EXTRA))) for i, t in edge_texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(nodes, links) -> dict:
    """The smallest node that links reach, by union and find."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
