"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored

#: Documents that are rounded together; a source's segments grow in number with it, not in size.
SEGMENT = 512
#: Equal rows that are made at once.
BLOCK = 1 << 12
#: Steps in which the sums of a Newton step are added, so that the order of adding does not matter.
GRAIN = 1024.0
ROUNDS = 60


def ranked(sources: DataFrame) -> DataFrame:
    """sources with `rank`, from 0, by source in code-point order, null last. No task sees more than its range of sources."""
    order = F.col("source").asc_nulls_last()
    dealt = stored(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before, total = [], 0
    for part, n in sorted(dealt.groupBy("part").count().collect()):  # a row for each partition
        before += [F.lit(part), F.lit(total)]
        total += n
    first = F.create_map(*before)[F.col("part")] if before else F.lit(0)
    return dealt.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + first).drop("part")


def source_targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """A row for each source of sizes(source, size): source_size, docs and its target.

    The targets share `share` times all sizes by the weights, dealt over the sources in code-point order (null last) in
    turn. A target stops at cap times its source's size; the excess is shared again by weight until none is above.
    """
    table = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    table = stored(table.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")), "targets")
    level = 0.0  # what a unit of weight gets; a source stands at its most or at level * weight
    while True:
        full = F.col("most") <= level * F.col("weight")
        every, held, free = table.agg(F.sum("source_size"), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not free or (now := (share * (every or 0) - (held or 0.0)) / free) <= level:
            break
        level = now
    target = F.least("most", level * F.col("weight")) if free else F.col("most")
    return table.select("source", "source_size", "docs", target.alias("target"))


def tilts(sizes: DataFrame, targets: DataFrame, cap: float = 2.0, tolerance: float = 1e-6) -> DataFrame:
    """targets with `tilt`, the solution of the balancing problem's dual for each source, by distributed Newton steps.

    Of all document rates between 0 and cap that meet a source's word constraint, entropy balancing takes those nearest
    to 1 in relative entropy: rate = min(cap, exp(tilt * size / mean size)). The dual's gradient is the words that the
    rates give less the target. Each step aggregates the gradient and its slope for all sources at once over the counts
    of equal sizes; a step that leaves the bracket is halved into it. A tilt is null where the target is the cap itself.
    """
    counts = stored(sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    full = F.col("target") >= cap * F.col("source_size")
    now = stored(
        targets.withColumn("mean", F.col("source_size") / F.col("docs"))
        .withColumn("tilt", F.when(~full, F.lit(0.0)))
        .withColumn("lo", F.when(F.col("target") < F.col("source_size"), -1e4).otherwise(0.0))
        .withColumn("hi", F.when(F.col("target") < F.col("source_size"), 0.0).otherwise(1e4))
        .withColumn("off", F.when(~full, F.lit(1.0))),
        "tilts",
    )
    power = F.col("tilt") * F.col("size") / F.col("mean")
    rate = F.exp(F.least(power, F.lit(math.log(cap))))
    mass = F.col("n") * F.col("size")
    for _ in range(ROUNDS):
        sums = (
            counts.join(now.where("off > 0").select(F.col("source").alias("s"), "tilt", "mean"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(
                F.sum(F.round(mass * rate * GRAIN).cast("bigint")).alias("got"),
                F.sum(F.when(power < math.log(cap), F.round(mass * rate * F.col("size") / F.col("mean") * GRAIN).cast("bigint"))).alias("slope"),
            )
        )
        less = F.col("got") / GRAIN - F.col("target")
        step = F.col("tilt") - less / F.nullif(F.col("slope") / GRAIN, F.lit(0.0))
        now = (
            now.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("lo", F.when(less < 0, F.greatest("lo", "tilt")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(less >= 0, F.least("hi", "tilt")).otherwise(F.col("hi")))
            .withColumn("off", F.when(F.abs(less) > tolerance * F.col("target") + 0.5, F.abs(less)))
            .withColumn("tilt", F.when(F.col("off") > 0, F.when((step > F.col("lo")) & (step < F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2)).otherwise(F.col("tilt")))
            .select("source", "source_size", "docs", "target", "mean", "tilt", "lo", "hi", "off")
        )
        now = stored(now, "tilts")
        if not now.agg(F.max("off")).first()[0]:
            break
    return now.select("source", "source_size", "docs", "target", "mean", "tilt")


def copies(documents: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: int = 2) -> DataFrame:
    """A row for each document row: doc_id, digest (of the text), source, size, source_size, target and copies (0 to cap).

    Sizes are words of whole texts (null: 0). Rates come from `tilts` and are rounded to copies in segments of about
    SEGMENT documents of a source, dealt by a hash of doc_id and text: from the longest to the shortest document, each gets the
    copies nearest to its rate times its size plus the words still owed, so that a segment misses its rates' words by
    less than its shortest documents. Documents without words have one copy. Null sources are a source; null doc_ids
    are dealt by their texts; repeated rows are documents each; an empty table gives no rows. Reruns agree: every sum is of
    whole numbers and every order is total up to equal documents.
    """
    sizes = documents.select("doc_id", F.xxhash64("text").alias("digest"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    sizes = stored(sizes, "sizes")
    found = tilts(sizes, source_targets(sizes, weights, share, cap), cap).withColumnRenamed("source", "s")
    segment = F.pmod(F.xxhash64("doc_id", "digest"), F.ceil(F.col("docs") / SEGMENT))
    rate = F.coalesce(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(math.log(cap)))), F.lit(float(cap)))
    # Equal rows travel as one with a count, so that no number of repeats is gathered.
    dealt = (
        sizes.join(found, F.col("source").eqNullSafe(F.col("s")))
        .groupBy("s", segment.alias("segment"), "source_size", "target", "doc_id", "digest", "size", rate.alias("rate"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("s", "segment", "source_size", "target")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("minus"), "doc_id", "digest", "size", "rate", "rows"))).alias("docs"))
    )

    def rounded(state, x):
        owed = state["owed"] + x["rate"] * x["size"] * x["rows"]
        n = F.when(x["size"] == 0, x["rows"]).otherwise(F.greatest(F.lit(0.0), F.least(cap * x["rows"].cast("double"), F.round(owed / F.greatest(x["size"], F.lit(1))))))
        return F.struct((owed - n * x["size"]).alias("owed"), F.concat(state["n"], F.array(n.cast("bigint"))).alias("n"))

    none = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<bigint>").alias("n"))
    chosen = F.explode(F.arrays_zip("docs", F.aggregate("docs", none, rounded)["n"].alias("n"))).alias("x")
    out = dealt.select(F.col("s").alias("source"), "source_size", "target", chosen)
    out = out.select("x.docs.doc_id", "x.docs.digest", "source", "x.docs.size", "source_size", "target", "x.docs.rows", "x.n")
    # One of equal rows after another gets an even share of their copies; rows are made in blocks, never as one array.
    block = F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / BLOCK))).alias("block")
    out = out.select("*", block).withColumn("first", F.col("block") * BLOCK)
    out = out.select("*", F.explode(F.sequence("first", F.least("rows", F.col("first") + BLOCK) - 1)).alias("at"))
    n = F.floor(F.col("n") / F.col("rows")) + (F.col("at") < F.col("n") % F.col("rows")).cast("int")
    return out.select("doc_id", "digest", "source", "size", "source_size", "target", n.cast("int").alias("copies"))


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: each document row as often as its copies, with the columns of documents.

    Rows that repeat a doc_id, a text and a source share their copies; which of them carry the copies' other columns is
    not set. Rows are made in blocks, never as one array of all copies of a row.
    """
    cols = documents.columns
    n = copies(documents, **options).groupBy(F.struct("doc_id", "digest", "source").alias("__own")).agg(F.sum("copies").alias("__copies"))
    rows = documents.withColumn("__row", F.struct("doc_id", F.xxhash64("text").alias("digest"), "source")).dropDuplicates(["__row"])
    kept = rows.join(n.where("__copies > 0"), F.col("__row") == F.col("__own"))  # nulls in structs are equal
    kept = kept.withColumn("__block", F.explode(F.sequence(F.lit(0), F.floor((F.col("__copies") - 1) / BLOCK))))
    first = F.col("__block") * BLOCK
    return kept.withColumn("__copy", F.explode(F.sequence(first, F.least("__copies", first + BLOCK) - 1))).select(*cols)


def op3_entropy_mix(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return copies(documents).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
