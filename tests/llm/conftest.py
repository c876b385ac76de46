import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
DATA = "/root/testdata/sf0.001"
LONG = "word " * 40_000 + "\n" + "x" * 300_000 + " end.\n" + "1" * 50_000

#: Nulls in every column, empty and blank texts, repeated rows and ids, equal texts, and a very long text.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and away it goes", "en", "b", 5), (1, "the quick brown fox jumps over the lazy dog and away it goes", "en", "b", 5),
    (2, None, None, None, None), (3, "", "en", "a", 0), (None, "no id but a text of some words, all of them short", "en", "a", 3), (None, None, None, "c", None),
    (4, " \t\n\x0b \n ", "fr", None, 7), (5, "The Quick Brown fox jumps over the lazy dog and away it goes", "en", "b", 5),
    (6, "a shared line of more than twenty\nfirst", "en", "a", 9), (7, "A shared line of more than twenty  \nsecond", "en", "a", 9), (8, "  a SHARED line of more than twenty\nthird\n", "en", "c", 9),
    (9, LONG, "en", "b", len(LONG)), (10, "one", "en", "é", 3), (11, "mail a.b@c.de, call +49 30 1234567, pay 4111 1111 1111 1111 from 10.0.0.1", "en", "é", 3),
]
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows above with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ROWS, DDL)
    names = ("size", "target", "rank", "fp", "class_fp", "component_id", "shard", "salt", "a", "b", "h", "key", "spans", "hashes", "weights", "score", "kept", "block", "turn", "digest", "copies", "segment", "s", "start", "word", "n", "piece", "length", "row")
    return rows.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
