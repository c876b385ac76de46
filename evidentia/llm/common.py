"""What the operators share, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_path, remove, shared_folder, stored  # noqa: F401  the operators take them from here

#: `[\x20\x09-\x0D]` as characters; words are the runs of anything else.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def kept_by_worker(kind: str, name: str, make):
    """make(), made once in each Python worker, one of each kind: functions that travel by value share no variables between tasks."""
    import sys

    store = sys.__dict__.setdefault("_evidentia_kept", {})
    if store.get(kind, ("",))[0] != name:
        store[kind] = (name, make())
    return store[kind][1]


def few_rows(batches, most: int = 512):
    """Arrow batches cut into ones of few rows, so that a task holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


#: SQL for CRC-32, which DuckDB lacks: one row with the list t of the 256 remainders, and the checksum of a text by it.
CRC_TABLE = "SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))"


def crc_of(text: str, table: str) -> str:
    signs = f"list_transform(range(strlen({text})), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {signs}), lambda c, x: xor({table}[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)"


def lower_ascii(c):
    return F.translate(c, UPPER, LOWER)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the undirected links: root is the component's smallest node.

    Alternating large-star and small-star rounds; each round's links go to the shared folder. A node's smallest
    neighbour comes from a partially aggregated minimum, so no node's neighbours are ever gathered in one place.
    """
    edges = links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u != v").distinct()
    edges = stored(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        edges = stored(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).cast("string")).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
