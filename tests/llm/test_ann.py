import math

import numpy as np

from brute import cosine
from conftest import DATA
from pyspark.sql import functions as F

from evidentia.llm.ann import build_graph, nearest, op6_small_world, search_graph, units


def brute(rows: dict, queries, k=5):
    out = {}
    for q in queries:
        near = sorted(((-round(cosine(rows[q], v), 12), i) for i, v in rows.items() if i != q and len(v) == len(rows[q])))
        out[q] = [i for _, i in near[:k]]
    return out


def recall(found, wanted):
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append(r)
    hits = sum(len({r["vec_id"] for r in got.get(q, [])} & set(w)) for q, w in wanted.items())
    return hits / max(1, sum(map(len, wanted.values())))


def test_whole_table(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    found = op6_small_world(spark, DATA).collect()
    wanted = brute(rows, [i for i in rows if i % 50 == 0])
    assert recall(found, wanted) >= 0.9
    for r in found:
        assert math.isclose(r["score"], cosine(rows[r["query_id"]], rows[r["vec_id"]]), rel_tol=1e-9)
    for q in wanted:
        own = sorted((r["rank"], -r["score"], r["vec_id"]) for r in found if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 6)) and [r[1:] for r in own] == sorted(r[1:] for r in own)


def test_shards_copies_and_ties(spark):
    base = spark.range(1200).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.sin(F.col("id") * (j + 1.7)))).cast("array<float>").alias("embedding"))
    rows = {r["vec_id"]: r["embedding"] for r in base.collect()}
    queries = base.where("vec_id % 50 = 0")
    found = nearest(base, queries, shard=200).collect()
    wanted = brute(rows, [i for i in rows if i % 50 == 0])
    assert recall(found, wanted) >= 0.9
    copies = [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 150]
    assert copies == [0, 3, 6, 9, 12]


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [None, 1.0]), (None, [1.0, 1.0]), (50, [1e38, 1e38]), (7, [1e-38, 2e-38]), (100, [1.0, 2.0, 3.0]), (8, [3.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit(0) for c in ("shard", "dim", "block", "rep", "score", "vector", "members")})
    found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest(df, df.where("vec_id % 50 = 0")).collect())
    assert found == [(0, 1, 50), (0, 2, 7), (50, 1, 7), (50, 2, 0), (100, 1, 8)]
    assert nearest(df.limit(0), df).count() == 0 and nearest(df, df.limit(0)).count() == 0


def test_parallel_vectors_tie(spark):
    """199 vectors of one direction and many lengths: the least ids come first."""
    rows = [(i, [0.3 * (i + 1), 0.7 * (i + 1), -0.1 * (i + 1)]) for i in range(200)] + [(1000 + i, [1.0, -1.0 * i, 2.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = nearest(df, df.where("vec_id = 0 or vec_id = 150"), shard=64).collect()
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 0] == [1, 2, 3, 4, 5]
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 150] == [0, 1, 2, 3, 4]


def test_huge_and_tiny_doubles_and_few_candidates(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [-1e300, 1e300]), (3, [1.0, 0.0]), (4, [1e-310, 2e-310])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest(df, df.where("vec_id in (0, 1)")).collect())
    assert found == [(0, 1, 1), (0, 2, 4), (0, 3, 3), (0, 4, 2), (1, 1, 0), (1, 2, 4), (1, 3, 3), (1, 4, 2)]


def test_graph_reaches_far_apart_clouds():
    """Tight clouds far from one another: what a walk cannot reach is found all the same."""
    rng = np.random.default_rng(4)
    x = units(np.concatenate([rng.normal(0, 1, (1, 16)) + rng.normal(0, 1e-3, (300, 16)) for _ in range(7)]))
    layers = build_graph(x)
    assert all(links.max() < len(nodes) for nodes, links in layers)
    place, near = search_graph(x, layers, x[::20], 6)
    assert (near[:, :6] > 0.999).all() and (place[:, :6] >= 0).all()
    one = units(np.eye(3))
    assert (search_graph(one, build_graph(one), one, 3)[0][:, :3] >= 0).all()
