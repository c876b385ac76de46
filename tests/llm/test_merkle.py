import hashlib

import pytest
from compare import duck, spark_rows
from conftest import DATA, ROWS
from pyspark.sql import functions as F

from evidentia.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text=None):
    values = [row[f] for f in FIELDS[:-1]] + [row["text"] if text is None else text]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grown(digests):
    """The levels of a tree, lowest first."""
    out = [digests]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(levels, i):
    """The siblings of leaf i, level by level: (those before, those after)."""
    out = []
    for own in levels[:-1]:
        first = i // 16 * 16
        out.append((own[first:i], own[i + 1 : first + 16]))
        i //= 16
    return out


def brute(rows):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = own, grown([leaf(r) for r in own])
    top = grown([trees[s][1][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        own, levels = trees[s]
        for i, r in enumerate(own):
            steps = path(levels, i) + path(top, k)
            back = leaf(r, (r["text"] or "").lower() if r["text"] is not None else None)
            for before, after in steps:
                back = digest(*before, back, *after)
            out.append((r["doc_id"], leaf(r), levels[-1][0], top[-1][0], digest(*(x for before, after in steps for x in before + after)), back))
    return sorted(out, key=repr)


def found(rows):
    done = merkle.proofs(rows, F.lower("text"))
    x = done.select("doc_id", *[merkle.as_hex(F.col(c)) for c in ("leaf", "subroot", "root")], F.sha2(merkle.proof_of(F.col("chain")), 256), merkle.folded(F.col("found"), F.col("chain")))
    return sorted(map(tuple, x.collect()), key=repr)


def test_same_as_sql(spark):
    assert spark_rows(merkle.op11_lookup_proofs(spark, DATA)) == duck(merkle.oracle())


@pytest.mark.parametrize("span,n,sources", [(2, 1, 1), (2, 17, 17), (2, 600, 3), (1, 5000, 40), (2, 5000, 40), (3, 5000, 40)])
def test_trees_of_all_heights(spark, monkeypatch, span, n, sources):
    """A hot source, lone leaves, last runs that are not full, and a tree over the sources that has several levels."""
    monkeypatch.setattr(merkle, "SPAN", span)
    kind = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % sources)
    rows = spark.range(n).select((F.col("id") * 7).alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), kind).alias("source"), F.col("id").alias("n_chars"))
    assert found(rows) == brute([r.asDict() for r in rows.collect()])


def test_awkward_rows(awkward):
    names = ("doc_id", "text", "lang", "source", "n_chars")
    assert found(awkward) == brute([dict(zip(names, r)) for r in ROWS])


def test_empty(empty):
    assert merkle.proofs(empty).count() == 0


def test_changed_rows_are_found(spark, awkward):
    kept = merkle.proofs(awkward)
    assert {r["verified"] for r in merkle.verified(awkward, kept).collect()} == {True}
    changed = awkward.withColumn("lang", F.when(F.col("doc_id") == 6, "xx").otherwise(F.col("lang"))).withColumn("doc_id", F.when(F.col("doc_id") == 7, 99).otherwise(F.col("doc_id")))
    assert {r["doc_id"] for r in merkle.verified(changed, kept).collect() if not r["verified"]} == {6, 99}
