from brute import targets, words
from conftest import DATA, ROWS

from evidentia.llm.mixing import copies, mixed, op3_entropy_mix


def held(rows, docs):
    sizes = {}
    for source, text in docs:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    wanted, taken = targets(sizes), {}
    for r in rows:
        assert abs(r["target"] - wanted[r["source"]]) <= 1e-6 * max(1, wanted[r["source"]])
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
    return wanted, taken


def test_targets_and_taken(spark, documents):
    rows = copies(documents).collect()
    assert len(rows) == documents.count()
    wanted, taken = held(rows, [tuple(r) for r in documents.select("source", "text").collect()])
    for s in wanted:
        longest = max(r["size"] for r in rows if r["source"] == s)
        assert abs(taken[s] - wanted[s]) <= max(0.02 * wanted[s], 0.5 * longest)


def test_reruns_agree(spark, documents):
    pick = lambda df: sorted((r["doc_id"], r["copies"]) for r in df.collect())
    assert pick(copies(documents)) == pick(copies(documents.repartition(7)))


def test_query(spark):
    df = op3_entropy_mix(spark, DATA)
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(df.columns)
    assert dict(df.dtypes)["taken"] == dict(df.dtypes)["size"] == dict(df.dtypes)["source_size"] == "bigint"
    assert df.where("taken > 2 * size").count() == 0


def test_awkward_rows(spark, awkward, empty):
    rows = copies(awkward).collect()
    assert len(rows) == len(ROWS)
    held(rows, [(r[3], r[1]) for r in ROWS])
    whole = mixed(awkward)
    assert whole.columns == awkward.columns
    assert whole.count() == sum(r["copies"] for r in rows)
    assert copies(empty).count() == 0 and mixed(empty).count() == 0


def test_repeats_under_two_sources(spark):
    """One doc_id and text under two sources: each source takes its own words."""
    docs = spark.createDataFrame([(i % 3, "w " * (40 + i % 3 * 9), "a" if i % 4 else "b") for i in range(60)], "doc_id bigint, text string, source string")
    taken = lambda rows: {r[0]: r[1] for r in rows.collect()}
    wanted = taken(copies(docs).selectExpr("source", "size * copies as n").groupBy("source").sum("n"))
    assert taken(mixed(docs).selectExpr("source", "size(split(trim(text), ' ')) as n").groupBy("source").sum("n")) == wanted


def test_hot_source(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 97 as int)) as text", "if(id % 3 = 0, 'a', if(id % 3 = 1, 'hot', null)) as source")
    wanted, taken = held(copies(docs).collect(), [tuple(r) for r in docs.select("source", "text").collect()])
    assert all(abs(taken[s] - wanted[s]) <= 0.01 * wanted[s] for s in wanted)


def test_repeated_rows(spark):
    """A third of all rows are one row: they are counted, not gathered, and share their copies evenly."""
    docs = spark.range(15_000).selectExpr("if(id % 3 = 0, 0, id) as doc_id", "if(id % 3 = 0, 'one two three', repeat('w ', cast(1 + id % 97 as int))) as text", "if(id % 3 < 2, 'a', null) as source")
    rows = copies(docs).collect()
    wanted, taken = held(rows, [tuple(r) for r in docs.select("source", "text").collect()])
    assert len(rows) == 15_000 and all(abs(taken[s] - wanted[s]) <= 0.01 * wanted[s] for s in wanted)
    own = {r["copies"] for r in rows if r["doc_id"] == 0}
    assert max(own) - min(own) <= 1
