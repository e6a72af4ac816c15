import random

import pytest

#: Columns whose names the operators use inside, to clash on purpose.
EXTRA = "key string, fp string, component_id long, vslot int, host string, _hits int, label int, tile int"


def frame(spark, rows):
    """documents-like rows (doc_id, text) with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, "k", "f", -1, 7, "h", 3, 1, 0) for i, t in rows], f"doc_id long, text string, {EXTRA}")


def prose(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice(["ba", "ke", "li", "mo", "nu", "sha", "tri"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, blank, very long and repeated texts, ties and repeated rows."""
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "a"), (4, prose(1, 60)), (5, prose(1, 60)), (5, prose(1, 60)), (None, "no id"), (6, "é ß 中文 " * 30), (7, "x" * 50_000), (8, prose(2, 9000)), (9, None), (10, "word " * 5000)]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
