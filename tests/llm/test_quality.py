from brute import text_rules
from conftest import DATA, ROWS

from evidentia.llm.quality import accepted, judged, op7_quality_rules

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_text_rules(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = judged(documents, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        wanted = text_rules(texts[r["doc_id"]])
        assert {k: r[k] for k in NAMES} == wanted
        assert r["base_failed"] == (wanted["n_words"] < 50 or 100 * wanted["n_repeat_words"] > 50 * wanted["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_one_threshold_keeps_the_good(spark):
    rows = judged(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))).where("not base_failed").collect()
    kept, gone = [r["score"] for r in rows if r["kept"]], [r["score"] for r in rows if not r["kept"]]
    assert kept and (not gone or max(gone) < min(kept))
    good = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    mine = [r["kept"] for r in rows if r["doc_id"] in good]
    assert sum(mine) >= 0.97 * len(mine)


def test_score_by_hand(spark):
    """A text like the trusted ones scores above one unlike them."""
    docs = spark.createDataFrame([(i, ("alpha beta gamma " if i < 20 else "omega psi chi ") * 20) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    score = {r["doc_id"]: r["score"] for r in judged(docs, labels).collect()}
    assert min(score[i] for i in range(20)) > max(score[i] for i in range(20, 40))


def test_all_held_out_set_the_threshold(spark, documents, monkeypatch):
    """The bound on what fits the target's model leaves the threshold alone: it is that of all that are held out."""
    from evidentia.llm import quality

    labels = spark.range(200).selectExpr("id as doc_id", "1 as quality", "0 as toxic").union(spark.read.parquet(f"{DATA}/labels.parquet").selectExpr("doc_id", "1", "0"))
    monkeypatch.setattr(quality, "MOST_TRUSTED", 5)
    rows = judged(documents, labels, spread=0.5)
    held = documents.where(f"pmod(xxhash64(doc_id), {quality.HELD}) = 0").select("doc_id").join(labels.select("doc_id").distinct(), "doc_id")
    scores = [r["score"] for r in rows.where("n_words >= 50").join(held, "doc_id").collect()]
    mean = sum(scores) / len(scores)
    least = mean - 0.5 * (sum((x - mean) ** 2 for x in scores) / len(scores)) ** 0.5
    fine = rows.where("not base_failed").collect()
    assert len(scores) > 5 and all(r["kept"] == (r["score"] >= least) for r in fine if abs(r["score"] - least) > 1e-8)


def test_no_labels(spark, documents):
    none = spark.createDataFrame([(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    assert judged(documents, none).where("kept = base_failed").count() == 0


def test_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (9, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = judged(awkward, labels).collect()
    found = sorted(tuple(str(x) for x in (r["doc_id"], *(r[k] for k in NAMES))) for r in rows)
    assert found == sorted(tuple(str(x) for x in (i, *text_rules(t).values())) for i, t, *_ in ROWS)
    assert accepted(awkward, labels).columns == awkward.columns
    assert judged(empty, labels).count() == 0 and accepted(empty, labels.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = op7_quality_rules(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
