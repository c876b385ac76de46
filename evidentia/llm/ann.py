"""Approximate nearest neighbours: a navigable small-world graph for each shard, whose results are merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .quality import once

#: Vectors that a shard holds at most, links of a node above the lowest layer (twice as many there), and nodes that a search
#: keeps open, for a query and for a node that is put in.
SHARD, LINKS, OPEN, OPEN_IN = 1 << 15, 16, 96, 64
#: Queries that go to a shard together, and those (or new nodes) that walk through it together.
QUERY_BLOCK, WALKERS = 1 << 15, 512
#: Open nodes of a walker whose neighbours are read at once.
WIDTH = 4
#: How far two products of 32-bit unit vectors may lie apart that 64 bits show as one.
SLACK = 1e-5


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1; each is scaled by its largest component first, so that no square overflows or vanishes."""
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def walk(x: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, open_: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query, the places of up to open_ near vectors of a layer x (-1: none), nearest first, and their products.

    links are the layer's flat neighbour arrays (-1: none). From its starts on, each query reads the neighbours of its
    nearest open nodes and keeps the open_ nearest of all that it has seen, until none of those is unread.
    """
    m, n = len(queries), len(x)
    seen = np.zeros((m, n), bool)
    found, score, done = np.full((m, open_), -1, np.int64), np.full((m, open_), -np.inf, np.float32), np.zeros((m, open_), bool)
    active, near = np.arange(m), starts
    while len(active):
        row, column = np.nonzero(near >= 0)
        code = np.unique(active[row] * n + near[row, column])
        code = code[~seen.ravel()[code]]
        seen.ravel()[code] = True
        q, v = code // n, code % n
        row = np.searchsorted(active, q)
        counts = np.bincount(row, minlength=len(active))
        place = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
        ids, value = (np.full((len(active), open_ + counts.max(initial=0)), none, t) for none, t in ((-1, np.int64), (-np.inf, np.float32)))
        ids[:, :open_], value[:, :open_] = found[active], score[active]
        ids[row, open_ + place], value[row, open_ + place] = v, np.einsum("ij,ij->i", queries[q], x[v])
        read = np.zeros(ids.shape, bool)
        read[:, :open_] = done[active]
        top = np.argpartition(-value, open_ - 1, axis=1)[:, :open_]
        found[active], score[active], read = (np.take_along_axis(y, top, 1) for y in (ids, value, read))
        waiting = np.where(read | (found[active] < 0), -np.inf, score[active])
        pick = np.argpartition(-waiting, min(WIDTH, open_) - 1, axis=1)[:, : min(WIDTH, open_)]
        live = np.take_along_axis(waiting, pick, 1) > -np.inf
        np.put_along_axis(read, pick, live | np.take_along_axis(read, pick, 1), 1)
        done[active] = read
        going = live.any(1)
        active, pick, live = active[going], pick[going], live[going]
        near = np.where(live[:, :, None], links[found[active[:, None], pick]], -1).reshape(len(active), live.shape[1] * links.shape[1])
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)


def diverse(x: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's ids, nearest first (-1: none), up to `most`: first those nearer to the row's node than to every one
    already taken, then the nearest of the others. As two arrays of width `most`, ids and products."""
    vectors = x[np.maximum(ids, 0)]
    among = vectors @ vectors.transpose(0, 2, 1)
    taken = np.zeros(ids.shape, bool)
    for k in range(ids.shape[1]):
        closer = (among[:, k, :k] > score[:, k, None]) & taken[:, :k]
        taken[:, k] = (ids[:, k] >= 0) & ~closer.any(1)
    rank = np.argsort(np.where(ids < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :most]
    out, near = np.full((len(ids), most), -1, np.int32), np.full((len(ids), most), -np.inf, np.float32)
    out[:, : rank.shape[1]], near[:, : rank.shape[1]] = np.take_along_axis(ids, rank, 1), np.take_along_axis(score, rank, 1)
    return out, near


class Layer:
    """A layer's nodes (numbers of all vectors, rising) and, for those already put in, flat neighbour arrays over places."""

    def __init__(self, x: np.ndarray, nodes: np.ndarray, most: int):
        self.nodes, self.x, self.most = nodes, x[nodes], most
        self.links, self.near = np.full((len(nodes), most), -1, np.int32), np.full((len(nodes), most), -np.inf, np.float32)

    def put_in(self, new: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Links the nodes at places new to the best of ids, what a walk found, and of one another; and these back."""
        own = self.x[new] @ self.x[new].T
        np.fill_diagonal(own, -np.inf)
        few = np.argsort(-own, axis=1, kind="stable")[:, :OPEN_IN]
        ids = np.concatenate([ids, np.where(np.take_along_axis(own, few, 1) > -np.inf, new[few], -1)], 1)
        score = np.concatenate([score, np.take_along_axis(own, few, 1)], 1)
        order = np.argsort(-score, axis=1, kind="stable")[:, :OPEN_IN]
        self.links[new], self.near[new] = diverse(self.x, np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1), self.most)
        source, target, value = np.repeat(new, self.most), self.links[new].ravel(), self.near[new].ravel()
        fresh = target >= 0
        source, target, value = source[fresh], target[fresh], value[fresh]
        fresh = ~(self.links[target] == source[:, None]).any(1)
        source, target, value = source[fresh], target[fresh], value[fresh]
        order = np.lexsort((-value, target))
        source, target, value = source[order], target[order], value[order]
        at, first, counts = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, counts)
        kept = place < self.most
        row = np.repeat(np.arange(len(at)), counts)[kept]
        ids, score = np.full((len(at), self.most), -1, np.int64), np.full((len(at), self.most), -np.inf, np.float32)
        ids[row, place[kept]], score[row, place[kept]] = source[kept], value[kept]
        ids, score = np.concatenate([self.links[at], ids], 1), np.concatenate([self.near[at], score], 1)
        order = np.argsort(-score, axis=1, kind="stable")
        ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
        full = (ids >= 0).sum(1) > self.most
        self.links[at[~full]], self.near[at[~full]] = ids[~full, : self.most], score[~full, : self.most]
        for part in np.array_split(np.flatnonzero(full), -(-int(full.sum()) // WALKERS) or 1):
            self.links[at[part]], self.near[at[part]] = diverse(self.x, ids[part], score[part], self.most)


def build_graph(x: np.ndarray, most: int = LINKS) -> list[tuple[np.ndarray, np.ndarray]]:
    """The layers from the lowest up, each as its nodes' numbers and flat neighbour arrays over places in the layer.

    A node's highest layer follows from a hash of its number, each layer holding one in `most` of the one below. Nodes
    are put in one after another, WALKERS at a time: they walk down from the top layer through the nodes that are in
    already and are linked, in each layer that holds them, to what they find there.
    """
    n = len(x)
    noise = ((np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / float(1 << 53)
    level = np.floor(-np.log(np.maximum(noise, 1e-12)) / np.log(most)).astype(int)
    level[:1] = level.max(initial=0)
    layers = [Layer(x, np.flatnonzero(level >= k), 2 * most if k == 0 else most) for k in range(level.max(initial=0) + 1)]
    for at in range(0, n, WALKERS):
        end = min(n, at + WALKERS)
        starts = np.zeros((end - at, 1), np.int64)
        for k in range(len(layers) - 1, -1, -1):
            layer = layers[k]
            held, upto = np.searchsorted(layer.nodes, (at, end))
            width = OPEN_IN if k == 0 else most
            if held:
                ids, score = walk(layer.x[:held], layer.links[:held], x[at:end], starts, width)
            else:
                ids, score = np.full((end - at, width), -1, np.int64), np.full((end - at, width), -np.inf, np.float32)
            if upto > held:
                inside = layer.nodes[held:upto] - at
                layer.put_in(np.arange(held, upto), ids[inside], score[inside])
            if k:
                starts = below(layers[k - 1].nodes, layer.nodes, ids[:, :WIDTH]) if held else starts
    return [(layer.nodes.astype(np.int32), layer.links) for layer in layers]


def below(lower: np.ndarray, nodes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The places in the layer below of the nodes at places (-1: none) of a layer."""
    return np.where(places < 0, -1, np.searchsorted(lower, nodes[np.maximum(places, 0)]))


def search_graph(x: np.ndarray, layers, queries: np.ndarray, k: int, open_: int = OPEN) -> tuple[np.ndarray, np.ndarray]:
    """For each query, places of near vectors of x (-1: none), nearest first, and their products: open_ of them at most.

    A walk that ends with fewer than k, though x holds more, has met a part of the graph without ways out: for such a
    query all products are taken.
    """
    starts = np.zeros((len(queries), 1), np.int64)  # the first node is in every layer
    for level in range(len(layers) - 1, -1, -1):
        nodes, links = layers[level]
        ids, score = walk(x[nodes] if level else x, links, queries, starts, open_ if level == 0 else WIDTH)
        starts = below(layers[level - 1][0], nodes, ids) if level else starts
    short = np.flatnonzero((ids >= 0).sum(1) < min(k, len(x)))
    for i in short:
        value = x @ queries[i]
        order = np.argsort(-value, kind="stable")[:open_]
        ids[i], score[i] = -1, -np.inf
        ids[i, : len(order)], score[i, : len(order)] = order, value[order]
    return ids, score


INDEX = "shard int, ids binary, vectors binary, dim int, nodes array<binary>, links array<binary>"


def build_shard(key: tuple, rows: pa.Table) -> pa.Table:
    """One row with a shard's graph: ids, unit vectors and each layer's nodes and flat neighbour arrays, as bytes."""
    ids, vectors = rows["vec_id"].to_numpy(), np.array(rows["vector"].to_pylist(), np.float64)
    order = np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    x = units(vectors)
    layers = build_graph(x)
    row = {"shard": key[1].as_py(), "ids": ids.tobytes(), "vectors": x.tobytes(), "dim": x.shape[1], "nodes": [a.tobytes() for a, _ in layers], "links": [b.tobytes() for _, b in layers]}
    return pa.Table.from_pylist([row], pa.schema([("shard", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("dim", pa.int32()), ("nodes", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))]))


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part: with an id, and finite, without nulls and not zero.

    Of rows that repeat an id, the one with the least vector counts.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False)))
    rows = embeddings.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vector"))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def scaled(v):
    """An array of doubles over its largest component, so that no square overflows."""
    return once(F.array_max(F.transform(v, lambda y: F.abs(y))), lambda m: F.transform(v, lambda x: x / m))


def dot(p, q):
    return F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    """The cosine of two arrays of doubles."""
    return once(scaled(a), lambda x: once(scaled(b), lambda y: dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))))


def directions(vectors: DataFrame, most: int) -> DataFrame:
    """(rep, members) for each different direction: its least vec_id and its `most` least vec_ids, in order.

    Vectors are of one direction if their unit vectors agree to twelve digits. Each task first keeps the `most` least of
    its own for each direction, so that no direction's rows are gathered whole.
    """

    def least(batches):
        tables = [b for b in batches if b.num_rows]
        if tables:
            whole = pa.Table.from_batches(tables)
            a, b, ids = (whole[c].to_numpy() for c in ("a", "b", "vec_id"))
            order = np.lexsort((ids, b, a))
            a, b, ids = a[order], b[order], ids[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            starts = np.flatnonzero(new)
            kept = np.arange(len(ids)) - starts[np.cumsum(new) - 1] < most
            yield pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept]), pa.array(ids[kept])], ["a", "b", "vec_id"])

    v = scaled(F.col("vector"))
    unit = once(v, lambda x: once(F.sqrt(dot(x, x)), lambda n: F.transform(x, lambda y: F.round(y / n, 12) + 0.0)))
    keys = vectors.select("vec_id", unit.alias("unit")).select(F.xxhash64("unit").alias("a"), F.xxhash64(F.reverse("unit"), F.lit(1)).alias("b"), "vec_id")
    few = keys.mapInArrow(least, "a bigint, b bigint, vec_id bigint").groupBy("a", "b").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, most).alias("members"))
    return few.select(F.col("members")[0].alias("rep"), "members")


def index_of(vectors: DataFrame) -> DataFrame:
    """The stored graphs of vectors(vec_id, vector, dim, shards), dealt over each length's shards by a hash of vec_id."""
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")).drop("shards")
    return stored(dealt.groupBy("dim", "shard").applyInArrow(build_shard, INDEX), "graphs")


def searched(key: tuple, queries: pa.Table, index: pa.Table, k: int, open_: int) -> pa.Table:
    """Each query's k nearest found in a shard, and all found that lie as near as the last of them."""
    schema = pa.schema([("query_id", pa.int64()), ("rep", pa.int64()), ("near", pa.float32())])
    if not queries.num_rows or not index.num_rows:
        return schema.empty_table()
    x = index.to_pylist()[0]
    ids, dim = np.frombuffer(x["ids"], np.int64), x["dim"]
    vectors = np.frombuffer(x["vectors"], np.float32).reshape(-1, dim)
    layers = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32).reshape(len(a) // 4, -1)) for a, b in zip(x["nodes"], x["links"])]
    out = []
    for at in range(0, queries.num_rows, WALKERS):
        some = queries.slice(at, WALKERS)
        asked = some["query_id"].to_numpy()
        place, near = search_graph(vectors, layers, units(np.array(some["vector"].to_pylist(), np.float64)), k, open_)
        hit = (place >= 0) & (near >= near[:, min(k, near.shape[1]) - 1, None] - SLACK)
        out.append(pa.Table.from_arrays([pa.array(np.repeat(asked, hit.sum(1))), pa.array(ids[place[hit]]), pa.array(near[hit])], schema=schema))
    return pa.concat_tables(out)


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, open_: int = OPEN) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row of embeddings(vec_id, embedding), its k nearest other rows.

    queries(vec_id) are rows of embeddings. Vectors of one direction are indexed once, with their least ids, so that
    copies neither clog a graph nor hide one another. Each shard's graph answers the queries in blocks of bounded size; of
    all shards' answers the nearest, and all that lie as near as the last of them, are scored again with the original
    vectors, in double precision, and ranked by cosine, then vec_id; cosines that agree to twelve digits are equal. Vectors
    of differing lengths meet only their like. Rows that take no part have no answers; fewer candidates give fewer
    rows; an empty table gives none.
    """
    vectors = stored(usable(embeddings), "vectors")
    same = stored(directions(vectors, k + 1), "directions")
    reps = vectors.join(same, vectors["vec_id"] == same["rep"]).select("vec_id", "vector")
    shards = reps.groupBy(F.size("vector").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    shards = stored(shards, "shards")  # a row for each length of vectors
    graphs = index_of(reps.withColumn("dim", F.size("vector")).join(shards, "dim"))
    asked = stored(vectors.join(queries.select("vec_id").distinct(), "vec_id").withColumnRenamed("vec_id", "query_id"), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    sent = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("dim", F.size("vector"))
    sent = sent.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    copied = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = sent.groupBy("dim", "shard", "block").cogroup(copied.groupBy("dim", "shard", "block"))
    found = both.applyInArrow(lambda key, q, g: searched(key, q, g, k + 1, open_), "query_id bigint, rep bigint, near float")
    own = Window.partitionBy("query_id")  # what the shards found for a query
    found = found.withColumn("n", F.row_number().over(own.orderBy(F.desc("near"), "rep")))
    last = F.coalesce(F.max(F.when(F.col("n") == k + 1, F.col("near"))).over(own), F.lit(-2.0))
    found = stored(found.withColumn("last", last).where(F.col("near") >= F.col("last") - SLACK).select("query_id", "rep"), "found")
    scored = (
        found.join(same, "rep")
        .select("query_id", F.explode("members").alias("vec_id"))
        .where("vec_id != query_id")
        .join(asked.select("query_id", F.col("vector").alias("q")), "query_id")
        .join(vectors, "vec_id")
        .select("query_id", "vec_id", cosine(F.col("q"), F.col("vector")).alias("score"))
    )
    rank = F.row_number().over(own.orderBy(F.desc(F.round("score", 12)), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_small_world(spark, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(embeddings, embeddings.where("vec_id % 50 = 0"))
