import random

import pytest

from citeloom.llm.tasks import ship

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source), with columns whose names clash with inner ones."""
    ship(spark)

    def make(rows, clash=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if clash:
            for name in ("n", "sid", "row_key", "score", "size", "token", "root", "_key", "range", "held", "host", "label"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df
    return make


@pytest.fixture
def words():
    """Seeded texts of invented words."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(400)]
    return lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
