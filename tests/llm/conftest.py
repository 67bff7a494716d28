import os
import sys
from types import SimpleNamespace

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: Columns beside those an operator reads, under names that its own plan uses.
EXTRA = ["size", "taken", "target", "body", "fp", "length", "start", "kind", "score", "part"]


@pytest.fixture(scope="session")
def tables(spark):
    """Small document tables: ``odd`` with every awkward row, ``empty`` with none."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs far away from here", "en", "b"),
        (2, "the quick brown fox jumps over the lazy dog and runs far away from here", "en", "b"),
        (2, "the quick brown fox jumps over the lazy dog and runs far away from here", "en", "b"),
        (3, None, "en", None),
        (4, "", None, "a"),
        (5, long, "en", "a"),
        (6, " \t\n\r\x0b\x0c ", None, None),
        (7, "é ü ñ 漢字 🙂 a.b@c.example.org, 10.0.0.1 +1 (555) 010-9999 4111 1111 1111 1111\n#$%\n#$%\n", "de", "c"),
        (7, "another text of the same id, which is not a copy of anything else in the table at all", None, "c"),
        (None, "the quick brown fox jumps over the lazy dog and runs far away from here", None, None),
        (None, None, None, None),
        (8, "one two", "fr", "a"),
        (9, "x" * 5000, "fr", "a"),
        (10, "x" * 70 + " end", "fr", "d"),
    ]
    full = [(i, t, g, s, 0, *["junk"] * len(EXTRA)) for i, t, g, s in rows]
    return SimpleNamespace(odd=spark.createDataFrame(full, schema).repartition(3), empty=spark.createDataFrame([], schema), rows=rows)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
