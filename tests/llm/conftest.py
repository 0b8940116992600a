import pytest
from pyspark.sql import types as T

LONG = "Lorem ipsum dolor sit amet " * 4000
CARD = "pay 4111 1111 1111 1111 now, token = abcdef0123456789abcdef"
ROWS = [
    (1, "The same text here, and a few words more than five.", "en", "a", 1),
    (2, "The  same text here,\nand a few words more than five.", "en", "a", 2),
    (3, None, None, None, 3),
    (None, "The same text here, and a few words more than five.", "en", None, 4),
    (4, "", "en", "a", 5),
    (5, LONG, "de", "b", 6),
    (6, LONG, "de", "b", 7),
    (7, CARD, "en", "a", 8),
    (7, CARD, "en", "a", 8),
    (8, " \n\t ", "en", "a", 9),
]
#: Names that operators use inside.
CLASHING = ["_id", "n", "band", "h1", "name", "comp", "rid", "length", "piece"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeats, and extra columns with names that operators use inside."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("text", "lang", "source")), *(T.StructField(c, T.LongType()) for c in CLASHING)])
    return spark.createDataFrame([(*r[:4], *[r[4]] * len(CLASHING)) for r in ROWS], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
