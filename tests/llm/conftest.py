from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 89}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
BASE = " ".join(f"tok{i}" for i in range(100))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, exact and near copies, repeated rows, clashing names."""
    rows = [
        (1, BASE, "en", "a", 1),
        (2, BASE, "en", "a", None),
        (3, BASE.replace("tok50", "other"), None, "b", 3),
        (4, BASE.replace("tok50", "other").replace("tok10 ", "tenth "), "en", None, 4),
        (5, None, "en", "a", 5),
        (6, "", None, None, None),
        (7, " \n\t ", "en", "b", 7),
        (8, "one two", "en", "b", 8),
        (9, "ONE two", "en", "c", 9),
        (10, LONG, "en", "a", 10),
        (11, f"{PASSAGE} tail of one", "en", "a", 11),
        (12, f"other head {PASSAGE}", "en", "c", 12),
        (13, "naïve café ﬁ A b", "fr", "c", 13),
        (13, "naïve café ﬁ A b", "fr", "c", 13),
        (14, "mail a.b@c.example.org and +1 (988) 555-2485 4041894974608795 end", "en", "b", 14),
        (None, "a row without an id", "en", "b", 15),
        (-5, "x\x00y ▁z퟿ 🙂", "en", "", 16),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("score", "shard", "slot", "row_num", "bucket", "node", "component", "prefix", "takes", "toxic_score", "gone_id", "repeated", "redacted", "mix_source", "id", "crc", "range", "size", "hash"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
