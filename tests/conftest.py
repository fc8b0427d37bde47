import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from citeloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("citeloom-tests", 4, **{"spark.sql.shuffle.partitions": "3"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def docs(spark):
    """(path, text) pairs as a corpus."""
    def make(*texts):
        rows = [(i, f"mem/{i}.txt", t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "source_key int, source_path string, text string")
    return make


@pytest.fixture(scope="session")
def index_of(docs):
    from citeloom.plans.index import build_index

    def make(*texts, **options):
        return build_index(docs(*texts), **options)
    return make


TURNS = (
    ("user", "1/2/2024 3:04:05 PM", "The harbor crane broke again and the schedule slipped."),
    ("assistant", "2024-01-03T10:00:00Z", "We must test the crane motor before the next shift."),
    ("user", "2024-01-04", "Great work, the harbor crane lifts cargo without trouble."),
)


@pytest.fixture(scope="session")
def chat_text():
    """Three turns with header lines; the first body holds a blank line, so it has two blocks."""
    parts = []
    for i, (who, when, said) in enumerate(TURNS, 1):
        extra = "\n\nA second paragraph on the harbor." if i == 1 else ""
        parts.append(f"## CHAT_TURN_{i}\nCHAT_CONVERSATION_ID: c1\nCHAT_MESSAGE_ID: m{i}\nCHAT_TITLE: Cranes\n"
                     f"CHAT_CREATED_AT: {when}\nCHAT_SPEAKER: {who.title()}\nCHAT_TRUTH_SCOPE: notes\n"
                     f"CHAT_LIFETIME_ALLOWED: false\nCHAT_TEXT:\n{said}{extra}")
    return "\n\n".join(parts)
