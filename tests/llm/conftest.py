import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n long, raw string, score double, chunk long, print string, node long, stats string, held_out string, start long"


def rows_of(texts, first=0):
    return [(i, t, "en", "src0", len(t or ""), 1, 2, "r", 0.5, 3, "p", 4, "s", "x", 5) for i, t in enumerate(texts, first)]


@pytest.fixture(scope="session")
def frame(spark):
    """Documents of given texts, with further columns whose names clash with those that the operators use inside."""
    return lambda texts, first=0: spark.createDataFrame(rows_of(texts, first), SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words: plain ones, near and exact copies, one very long, null, empty and blank ones."""
    draw = random.Random(3)
    parts = ["th", "er", "on", "an", "re", "in", "ed", "nd", "ha", "ing", "é", "ß"]
    word = lambda: "".join(draw.choice(parts) for _ in range(draw.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    plain = [text(draw.randint(1, 200)) for _ in range(60)]
    passage = text(90)
    near = []
    for t in plain[:12]:
        w = t.split(" ")
        if len(w) > 30:
            w[draw.randrange(len(w))] = "edited"
            near.append(" ".join(w))
    shared = [f"{text(20)} {passage} {text(20)}" for _ in range(6)]
    return [*plain, *near, *plain[:5], plain[3].upper(), *shared, text(9000), None, "", " \n\t ", "one", "One two", "one two", "x" * 5000, "-" * 700 + "é" * 300]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
