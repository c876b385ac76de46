import hashlib

import pytest
from compare import duck, spark_rows
from conftest import DATA, ROWS

from evidentia.llm import exactdedup


def brute(rows, keep=max):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault((text or "").translate(low), []).append(i)
    best = {t: keep((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return {t: (best[t], len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items()}, low


@pytest.mark.parametrize("shares", [exactdedup.SHARES, 500])
def test_same_as_sql(spark, monkeypatch, shares):
    monkeypatch.setattr(exactdedup, "SHARES", shares)  # 500: all copies are dealt out in pieces
    assert spark_rows(exactdedup.op12_content_sort(spark, DATA)) == duck(exactdedup.ORACLE)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_awkward_rows(awkward, keep):
    wanted, low = brute(ROWS, min if keep == "smallest" else max)
    got = exactdedup.marked(awkward.withColumn("keep_id", awkward.doc_id), keep).collect()
    assert len(got) == len(ROWS)
    kept = {}
    for r in got:
        text = (r["text"] or "").translate(low)
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == wanted[text]
        kept.setdefault(text, []).append(r["doc_id"]) if r["kept"] else None
    assert kept == {t: [best] for t, (best, *_) in wanted.items()}
    assert exactdedup.one_of_equal(awkward, keep).columns == awkward.columns
    left = [(r["text"] or "").translate(low) for r in exactdedup.one_of_equal(awkward, keep).collect()]
    assert sorted(left) == sorted(wanted)


def test_empty(empty):
    assert exactdedup.marked(empty).count() == 0
    assert exactdedup.one_of_equal(empty).columns == empty.columns


def test_hot_text_is_dealt_in_pieces(spark, monkeypatch):
    """A third of all rows share a text, some of them without an id and some with the same one: no task sorts them all."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exactdedup, "SHARES", 8)
    ids = F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 51 == 0, 7).otherwise(F.col("id"))
    rows = spark.range(3000).select(ids.alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot text " * 20).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    assert max(r["pieces"] for r in exactdedup.heavy_texts(rows).collect()) > 8
    wanted, low = brute([tuple(r) for r in rows.collect()])
    got = exactdedup.marked(rows, "largest").collect()
    assert all((r["keep_id"], r["group_size"], r["text_sha256"]) == wanted[r["text"].translate(low)] for r in got)
    assert len(got) == 3000 and sum(r["kept"] for r in got) == len(wanted)
