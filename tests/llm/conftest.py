import random

import pytest

WORDS = "amber basil cedar delta ember fjord grove heron ivory jolly kayak lemon maple nylon ocean pearl quartz river stone tulip umber velvet willow xenon yarrow zephyr".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that every operator has to stand: null, empty, blank, very long, repeated, beyond ASCII."""
    long = "\n".join(prose(i, 40) for i in range(120))
    return [None, "", "  \n\t ", "one", prose(1, 60), prose(1, 60), prose(2, 90) + "\n" + prose(3, 55), prose(4, 30) + "\n" + prose(3, 55), "Ünï cödé 𝔘 " + prose(5, 70), long, long + " end", "\x00 nul \x0b tab\tline\r\n"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, word string, b int, k int, shard int, score double, start long, path string, h string"


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """With nulls in every column, ids out of order, and columns whose names clash with those the operators make."""
    rows = [(100 - i, t, [None, "en", "de"][i % 3], [None, "s", "t"][i % 3], None if t is None else len(t), 1, "w", 2, 3, 4, 0.5, 7, "p", "h") for i, t in enumerate(odd_texts)]
    rows += [rows[5], rows[1], (None, None, None, None, None, None, None, None, None, None, None, None, None, None), (None, prose(9, 80), None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
