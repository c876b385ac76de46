"""Places in a total order, selection by rank and running folds, over tables and groups of any size.

A window that sorts a whole table, or one that holds a third of it under a single key, runs in one task. Here the rows are
range-partitioned by the whole order, so that a large group is spread over many tasks; what has to be known of the rows
before a task's own is one small row for each partition or block.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored

#: Values that one round of a selection tells apart, and the rows of a group that one task folds.
FAN, BLOCK = 4096, 1 << 16


def numbered(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """rows with their place (bigint, from 0) in the given order, which should be total: equal rows are told apart at will.

    Sampled splitters range-partition the rows, each partition is sorted, and the partitions' counts (one row for each,
    all that the driver sees) say where each of them begins. An empty table stays empty.
    """
    # Equal keys are split too: a row's own number comes last in the order.
    keyed = rows.withColumn("__row", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(*order, F.col("__row")).sortWithinPartitions(*order, F.col("__row"))
    kept = stored(dealt.drop("__row").withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    counts = sorted(kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    begins = accumulate((r["n"] for r in counts), initial=0)
    offsets = rows.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(counts, begins)], "__part bigint, __begins bigint")
    place = F.col("__begins") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(offsets), part == F.col("__part")).select(*rows.columns, place.alias(name))


def kth(rows: DataFrame, value: str, k: int) -> tuple[int, int] | None:
    """The k-th smallest (from 1) of a bigint column without nulls, and how many values are smaller; None beyond the table.

    No sort and no shuffle of rows: each round counts the values in FAN equal ranges and goes on in the one that holds
    the k-th, so 64-bit values take six rounds at most. The driver sees FAN counts a round.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()
    total = rows.count()
    if not 1 <= k <= total:
        return None
    below = 0
    while low < high:
        width = -(-(high - low + 1) // FAN)
        inside = rows.where(F.col(value).between(low, high))
        # Decimals: the distance of two 64-bit values need not fit 64 bits.
        far = F.floor((F.col(value).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")) if high - low >= 1 << 62 else F.expr(f"({value} - ({low}L)) div {width}L")
        for slot, n in sorted(inside.groupBy(far.cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()):
            if below + n >= k:
                break
            below += n
        low, high = low + slot * width, min(high, low + (slot + 1) * width - 1)
    return low, below


def first_by(rows: DataFrame, value: Column, ties: list[Column], k: int, name: str) -> DataFrame:
    """rows with a boolean: whether a row is one of the k smallest by (value, ties). The value is a bigint; ties are numbered
    only among the rows that share the value at the cut."""
    known = stored(rows.withColumn("__value", value), "valued")
    found = kth(known, "__value", k) if k > 0 else None
    if found is None:
        return known.drop("__value").withColumn(name, F.lit(k > 0))
    cut, below = found
    clear = known.where(F.col("__value") != cut).withColumn(name, F.col("__value") < cut)
    tied = numbered(known.where(F.col("__value") == cut), ties, "__place").withColumn(name, F.col("__place") < k - below)
    return clear.drop("__value").unionByName(tied.drop("__value", "__place"))


def largest(rows: DataFrame, group: list[str]) -> int:
    """How many rows the largest group has."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def placed(rows: DataFrame, group: list[str], order: list[Column], name: str = "place", block: int = BLOCK) -> DataFrame:
    """rows with their place (from 0) within their group. Groups of up to `block` rows are sorted by a window; where there is
    a larger one, places are those in the whole order less the group's first, and no group is in one task."""
    if largest(rows, group) <= block:
        return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("bigint"))
    known = stored(numbered(rows, [F.col(g) for g in group] + order, "__position"), "placed")
    first = known.groupBy(F.struct(*group).alias("__group")).agg(F.min("__position").alias("__first"))
    joined = known.withColumn("__own", F.struct(*group)).join(first, F.col("__own") == F.col("__group"))  # nulls in structs are equal
    return joined.select(*rows.columns, (F.col("__position") - F.col("__first")).alias(name))


def running_sum(rows: DataFrame, group: list[str], order: list[Column], value: Column, name: str = "upto", block: int = BLOCK) -> DataFrame:
    """rows with the sum of a whole-number value over the rows of their group up to their own.

    Groups of up to `block` rows (two or more) are folded by a window. Where there is a larger one, this is a segmented
    scan: each block of a group is folded by itself, and a second, smaller scan over one row for each block gives what
    came before, so no task sees more than a block of rows. Nulls count as nothing.
    """
    own = F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))
    if largest(rows, group) <= block:
        return rows.withColumn(name, F.sum(own).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    places = placed(rows.withColumn("__value", own), group, order, "__place", block)
    known = stored(places.withColumn("__block", F.expr(f"__place div {block}L")), "scan")
    sums = known.groupBy(F.struct(*group).alias("group"), F.col("__block").alias("block")).agg(F.sum("__value").alias("value"))
    before = earlier(sums, block).select(F.col("group").alias("__group"), F.col("block").alias("__of"), F.col("before").alias("__before"))
    joined = known.withColumn("__own", F.struct(*group)).join(before, (F.col("__own") == F.col("__group")) & (F.col("__block") == F.col("__of")))
    upto = Window.partitionBy("__own", "__block").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*rows.columns, (F.col("__before") + F.sum("__value").over(upto)).alias(name))


def earlier(sums: DataFrame, block: int) -> DataFrame:
    """sums(group, block, value) with before: the sum over the group's blocks before a row's own. Scanned in blocks again
    while a group has more than one of them."""
    sums = stored(sums, "sums")
    if largest(sums, ["group"]) > block:
        return running_sum(sums, ["group"], [F.col("block")], F.col("value"), "upto", block).select("group", "block", (F.col("upto") - F.col("value")).alias("before"))
    upto = Window.partitionBy("group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("group", "block", F.coalesce(F.sum("value").over(upto), F.lit(0).cast("bigint")).alias("before"))
