import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, words string, n int, `class` string, gone string, pos string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with copies, near copies, shared passages and lines, nulls, empty and long texts."""
    rng = random.Random(7)
    shared = prose(rng, 60)
    line = "This line stands in many documents of the corpus."
    base = prose(rng, 300)
    rows = []
    for i in range(60):
        text = prose(rng, rng.choice([1, 3, 4, 5, 30, 34, 35, 36, 120]), rng.choice([3, 400, 5000]))
        if i % 4 == 0:
            text = f"{prose(rng, 20)} {shared} {prose(rng, 20)}"
        if i % 5 == 0:
            text += f"\n \t{line.upper() if i % 2 else line} \n{prose(rng, 12)}"
        rows.append(text)
    for i in range(40):
        w = base.split(" ")
        for _ in range(rng.choice([0, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(50)}"
        rows.append(" ".join(w) if i % 3 else " ".join(w).upper())
    rows += [None, "", "\n\n", " \t ", "a" * 5000, "x " * 3000, "a b " * 100, base + " tail", rows[0], rows[8]]
    rows.append("\n".join([line] * 4 + [prose(rng, 40)] * 2))
    rows.append(prose(rng, 30000, 30000))
    out = [(i * 3 % 997, t) for i, t in enumerate(rows)]
    return [*out, out[4], out[63], (None, rows[12]), (None, None), (None, "all alone here")]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus as a table with columns whose names operators could trip over."""
    rows = [(i, t, None, None if k % 7 == 0 else f"s{k % 5}", len(t or ""), "i", "r", "w", 1, "c", "g", "p") for k, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
