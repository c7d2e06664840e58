import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of the input that have the names of columns that operators make.
CLASH = ["row_number", "position", "shard", "slot", "toxic_score", "tokens", "finish_time", "events", "bits", "Start", "key", "family"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, equal rows, equal keys, clashing columns."""
    rows = [
        (1, prose(1, 60), "en", "a", 1),
        (1, prose(1, 60), "en", "a", 1),
        (2, prose(2, 60), "de", "b", 2),
        (2, prose(3, 60), "de", "b", 2),
        (None, prose(4, 60), None, None, None),
        (None, None, None, None, None),
        (3, None, "fr", "a", None),
        (4, "", "fr", None, 0),
        (5, " .,!\n", "es", "b", 5),
        (6, prose(6, 60_000), "en", "a", 9),
        (7, "x" * 3_000_000, "en", "a", 9),
        (8, "é ẞ İ 漢字 \U0001f600 " + prose(8, 30), "en", "c", 9),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, *range(len(CLASH))) for r in rows], SCHEMA + "".join(f", `{c}` long" for c in CLASH))
    return df.cache()


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)
