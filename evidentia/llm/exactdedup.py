"""Exact dedup by content sort: sampled splitters deal normalised texts out by content, sorting makes equals neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, lower_ascii, stored

#: Code points of a text that splitters are sampled from; a text is told apart by its hash and by itself beyond them.
PREFIX = 64
#: A text whose copies are over 1 / (SHARES * partitions) of all bytes is split over several stretches of the sort.
SHARES = 4


def normalised(text: str = "text") -> Column:
    return lower_ascii(F.coalesce(F.col(text), F.lit("")))


def heavy_texts(documents: DataFrame) -> DataFrame:
    """(hash, pieces) of the texts whose copies are too many for one task, at most SHARES * partitions of them: counts by
    hash, partially aggregated before they are shuffled."""
    spark = documents.sparkSession
    shares = SHARES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    norm = normalised()
    each = documents.select(F.xxhash64(norm).alias("hash"), (F.octet_length(norm) + 64).cast("bigint").alias("bytes"))
    counts = stored(each.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")), "texts")
    share = max(1, (counts.agg(F.sum("bytes")).first()[0] or 0) // shares)
    pieces = F.least("n", F.ceil(F.col("bytes") / F.lit(share)))
    return counts.where((F.col("n") > 1) & (F.col("bytes") > share)).select("hash", pieces.alias("pieces"))


def marked(documents: DataFrame, keep: str = "smallest", carry: bool = True) -> DataFrame:
    """Each row of documents (its doc_id alone without `carry`) with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after A-Z are lower-cased; null counts as empty. Of equal texts the row with the
    smallest (or `largest`) doc_id is kept, keep_id is its id; rows without an id give way to any other, and of rows that
    repeat an id exactly one is kept. group_size counts the rows of equal text, text_sha256 is the digest (lowercase hex)
    of the normalised text in UTF-8. An empty table gives no rows; columns of these names in documents are replaced.

    Splitters are sampled from (first code points, hash, piece) and deal the rows out; within a partition the sort (on
    disk, where memory does not do) goes on by the whole normalised text and the id, so equal texts stand together, and
    neighbours are compared whole. A text that many rows share is dealt out in pieces, by row number; its pieces' totals,
    at most a few for each partition, then meet under the text's digest.
    """
    made = ["keep_id", "group_size", "kept", "text_sha256"]
    plain = [c for c in documents.columns if c not in made]
    heavy = heavy_texts(documents)
    rows = documents.select(F.struct(*(plain if carry else ["doc_id"])).alias("row"), F.col("doc_id").alias("id"), normalised().alias("norm"))
    rows = rows.withColumn("hash", F.xxhash64("norm"))
    # At most SHARES rows for each partition.
    rows = rows.join(F.broadcast(heavy), "hash", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1).cast("bigint")))
    piece = F.when(F.col("pieces") > 1, F.pmod(F.monotonically_increasing_id(), F.col("pieces"))).otherwise(0)
    rows = rows.withColumn("piece", piece).withColumn("prefix", F.left("norm", F.lit(PREFIX)))
    dealt = rows.repartitionByRange("prefix", "hash", "piece")

    equal = Window.partitionBy("prefix", "hash", "piece", "norm")
    order = F.asc_nulls_last("id") if keep == "smallest" else F.desc_nulls_last("id")
    best = F.min("id") if keep == "smallest" else F.max("id")
    place = F.row_number().over(equal.orderBy(order))
    runs = dealt.withColumn("place", place).withColumn("best", best.over(equal.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    runs = runs.withColumn("n", F.count(F.lit(1)).over(equal.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    runs = stored(runs.select("row", "id", "place", "best", "n", "piece", "pieces", F.unhex(F.sha2("norm", 256)).alias("digest")), "runs")

    # One row for each piece of a heavy text: a few for each partition.
    heads = runs.where("pieces > 1 and place = 1")
    chosen = F.min_by("piece", F.struct(F.col("best").isNull(), "best", "piece")) if keep == "smallest" else F.max_by("piece", F.struct("best", -F.col("piece")))
    totals = heads.groupBy(F.col("digest").alias("own")).agg((F.min("best") if keep == "smallest" else F.max("best")).alias("top"), chosen.alias("chosen"), F.sum("n").alias("all"))
    out = runs.join(F.broadcast(totals), (F.col("pieces") > 1) & (F.col("digest") == F.col("own")), "left")
    first = (F.col("place") == 1) & (F.col("own").isNull() | (F.col("chosen") == F.col("piece")))
    return out.select("row.*", F.coalesce("top", "best").alias("keep_id"), F.coalesce("all", "n").alias("group_size"), first.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def one_of_equal(documents: DataFrame, keep: str = "smallest") -> DataFrame:
    """documents without exact copies: whole rows, one for each different text; see marked."""
    rows = documents.select(F.struct(*documents.columns).alias("whole"), "doc_id", "text")
    return marked(rows, keep).where("kept").select("whole.*")


def op12_content_sort(spark, sf_dir: str) -> DataFrame:
    return marked(spark.read.parquet(f"{sf_dir}/documents.parquet"), "largest", carry=False).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = (
    f"WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents) "
    "SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, "
    "row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d"
)
