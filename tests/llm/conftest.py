import random

import pytest

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, copy int"


def _text(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def corpus(seed=5):
    """Small documents with copies, near copies, nulls, empties, ties, repeated rows and clashing column names."""
    rnd, rows = random.Random(seed), []
    for i in range(40):
        rows.append([i, _text(rnd, rnd.choice([1, 3, 5, 30, 80, 200])), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None])])
    base = _text(rnd, 150).split()
    for i in range(40, 90):
        w = list(base)
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        rows.append([i, (" " if i % 2 else "  ").join(w).upper() if i % 3 == 0 else " ".join(w), "en", "hot"])
    rows += [[90 + i, rows[i][1], "de", "hot"] for i in range(20)]
    rows += [[110, None, "en", "a"], [111, "", None, None], [112, " \t\n", "en", "b"], [113, "12 34 !?", "en", "b"], [114, _text(rnd, 20000), "en", "b"], [115, rows[5][1], None, None], [115, rows[5][1], None, None]]
    return [(*r, len(r[1] or ""), "x", 7) for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
