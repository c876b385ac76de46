import numpy as np
from brute import line_dedup
from compare import duck, spark_rows
from conftest import DATA, ROWS

from evidentia.llm.linededup import ORACLE, build_hash, op4_line_dedup, places, without_shared_lines
from pyspark.sql import functions as F


def test_perfect_hash_is_one_to_one():
    a, b = (np.random.default_rng(i).integers(0, 2**63, 50_000).astype(np.uint64) for i in (1, 2))
    for n in (0, 1, 2, 1000, 50_000):
        assert sorted(places(build_hash(a[:n], b[:n]), a[:n], b[:n]).tolist()) == list(range(n))


def test_whole_table(spark):
    assert spark_rows(op4_line_dedup(spark, DATA)) == duck(ORACLE, DATA)


def digests(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()), key=repr)


def test_awkward_rows(spark, awkward, empty):
    out = without_shared_lines(awkward)
    assert digests(out) == sorted(line_dedup([(i, t) for i, t, *_ in ROWS]), key=repr)
    assert out.drop("n_lines", "n_dropped").columns == awkward.columns
    assert without_shared_lines(empty).count() == 0


def test_a_line_that_all_hold(spark):
    rows = [(i, f"own line number {i} of this document\nThe line that every document holds\n{i % 9} a line that a ninth of them hold\n") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert digests(without_shared_lines(docs)) == sorted(line_dedup(rows), key=repr)
