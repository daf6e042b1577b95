import random

import pytest

from accessloom.llm.common import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, target string"


def prose(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(("ba", "ke", "lo", "mi", "su", "ta", "ron", "vel")) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, nulls, empty and long texts, repeated rows, and columns whose names clash."""
    r = random.Random(7)
    bodies = ["\n".join(prose(r, r.randint(3, 30)) for _ in range(r.randint(1, 6))) for _ in range(60)]
    for i in range(15):
        words = bodies[i].split(" ")
        words[len(words) // 2] = "changed"
        bodies.append(" ".join(words))
    bodies += [bodies[0]] * 4 + [None, None, "", "   \n ", "a", "é ß 日本 \U0001f600", prose(r, 5000), "x" * 3000]
    rows = [(i, t, None, f"s{i % 3}" if i % 5 else None, len(t or ""), "b", "t") for i, t in enumerate(bodies)]
    return [*rows, rows[3], (None, bodies[5], "en", None, 1, "b", "t"), (None, None, "en", "s1", 1, "b", "t"), (7, bodies[9], "de", "s2", 1, "b", "t")]


@pytest.fixture
def docs(spark, texts):
    ship(spark)
    return spark.createDataFrame(texts, DOCS)


@pytest.fixture
def none(spark):
    ship(spark)
    return spark.createDataFrame([], DOCS)
