import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# names that operators use inside; as further columns of an input they must neither crash nor leak
CLASHING = ["row", "uid", "score", "spans", "n", "name", "bucket", "id", "kept", "ids", "leaks", "base", "part", "block"]
DATA = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    def make(rows, parts=3, clashing=True):
        extra = "".join(f", {c} string" for c in CLASHING) if clashing else ""
        more = [f"x{i}" for i in range(len(CLASHING))] if clashing else []
        return spark.createDataFrame([(*r, *more) for r in rows], "doc_id long, text string" + extra).repartition(parts)
    return make


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
PASSAGE = " ".join(f"Pass{i}" for i in range(50))
EDGE_ROWS = [
    (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one two"), (5, "one two"), (6, "One TWO"), (7, LONG), (8, LONG + " tail"),
    (9, f"before {PASSAGE} after here"), (10, f"other {PASSAGE} words"), (10, f"other {PASSAGE} words"), (None, "an id is missing here now"),
    (11, "same " * 80), (12, "naïve café   x y \u0085 z " * 6), (13, "İstanbul K \x1c\x1d joined " * 3),
]


@pytest.fixture
def edge_rows():
    return EDGE_ROWS
