"""Scoring runs and examples: rubric points, means by tag, order statistics, rule checks and the most missed criteria.

Order statistics count equal values first, and no task sorts more than a block of a group's different values.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored
from .ranks import BLOCK, running_sum


def counted(rows: DataFrame, group: list[str], value: str, block: int = BLOCK) -> DataFrame:
    """(group, value, n, upto, total): each different value, how many rows have it, and how many have it or less. Where a
    group has many different values, they are summed up in blocks."""
    n = stored(rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n")), "values")
    total = n.groupBy(F.struct(*group).alias("__group")).agg(F.sum("n").alias("total"))
    upto = running_sum(n, group, [F.col(value)], F.col("n"), "upto", block)
    return upto.withColumn("__own", F.struct(*group)).join(total, F.col("__own") == F.col("__group")).drop("__own", "__group")


def at_place(value: str, place: Column) -> Column:
    """As an aggregate over `counted` rows: the value at a place (from 1) in order, between neighbours in proportion."""
    low = F.floor(place)
    pick = lambda k: F.min(F.when(F.col("upto") >= k, F.col(value).cast("double")))
    below, above = pick(low), pick(low + 1)
    share = F.max(place - low)
    return F.when(share > 0, below + share * (above - below)).otherwise(below)


def medians(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    return counted(rows, group, value).groupBy(*group).agg(at_place(value, (F.col("total") + 1) / 2).alias("median"))


def run_summary(rows: DataFrame, group: list[str], score: str, latency: str, failed: str) -> DataFrame:
    """n and errors count every row; mean and worst score leave failed rows out; median (whole) and longest latency."""
    fine = F.when(~F.col(failed), F.col(score))
    whole = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("errors"), F.round(F.avg(fine), 4).alias("mean"), F.min(fine).alias("worst"), F.max(latency).alias("longest")
    )
    middle = medians(rows, group, latency).withColumn("median", F.col("median").cast("bigint"))
    return whole.join(middle, group)


def bench_summary(rows: DataFrame, group: list[str], score: str) -> DataFrame:
    """mean, median and worst score, and the first exclusive decile where a group has more than ten scores."""
    tenth = at_place(score, F.when(F.col("total") > 10, (F.col("total") + 1) / 10))
    c = F.col(score)
    return (
        counted(rows, group, score).groupBy(*group)
        .agg((F.sum(c * F.col("n")) / F.sum("n")).alias("mean"), at_place(score, (F.col("total") + 1) / 2).alias("median"), F.min(c).alias("worst"), tenth.alias("p10"), F.sum("n").alias("n"))
        .select(*group, F.round("mean", 4).alias("mean"), "median", "worst", F.round("p10", 6).alias("p10"), "n")
    )


def rubric_scores(verdicts: DataFrame, key: str) -> DataFrame:
    """(key, score): the points of verdicts(key, points, met) that are met over the points to be had, held within 0 and 1;
    0 where none are to be had."""
    got, full = F.sum(F.when(F.col("met"), F.col("points")).otherwise(0)), F.sum(F.when(F.col("points") > 0, F.col("points")))
    return verdicts.groupBy(key).agg(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), got / full)), F.lit(0.0)).alias("score"))


def tag_means(verdicts: DataFrame, key: str, prefixes: list[str], most: int = 12) -> DataFrame:
    """(tag, mean, n): the mean over examples of a tag's share of met verdicts, for tags with one of the prefixes; if
    there are none, for the first `most` tags by name."""
    met = F.col("met").cast("double")
    per = verdicts.select(key, met.alias("met"), F.explode("tags").alias("tag")).groupBy(key, "tag").agg(F.round(F.avg("met"), 3).alias("share"))
    means = per.groupBy("tag").agg(F.round(F.avg("share"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))
    wanted = F.lit(False)
    for p in prefixes:
        wanted = wanted | F.col("tag").startswith(p)
    marked = means.withColumn("wanted", wanted)
    some = marked.agg(F.coalesce(F.bool_or("wanted"), F.lit(False)).alias("some"))
    first = marked.orderBy("tag").limit(most).select("tag", F.lit(True).alias("first"))
    kept = marked.join(F.broadcast(some)).join(F.broadcast(first), "tag", "left")  # one row; `most` rows
    return kept.where(F.when(F.col("some"), F.col("wanted")).otherwise(F.col("first"))).select("tag", "mean", "n")


def missed_criteria(verdicts: DataFrame, key: str, per: int = 5, width: int = 80, k: int = 10) -> DataFrame:
    """(kind, criterion, n): the criteria that most examples miss (points to be had, not met) and the ones they are
    penalised for (points taken, met); of an example's the first `per` of each kind count, cut to `width` characters."""
    kind = F.when((F.col("points") > 0) & ~F.col("met"), "missed").when((F.col("points") < 0) & F.col("met"), "penalised")
    rows = verdicts.withColumn("kind", kind).where("kind is not null")
    place = F.row_number().over(Window.partitionBy(key, "kind").orderBy("pos"))
    counts = rows.withColumn("place", place).where(F.col("place") <= per).groupBy("kind", F.left("criterion", F.lit(width)).alias("criterion")).agg(F.count(F.lit(1)).alias("n"))
    top = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "criterion"))
    return counts.withColumn("place", top).where(F.col("place") <= k).select("kind", "criterion", "n")


def rule_eval(texts: DataFrame, text: str, positive: str, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, recall, false_rate): each named pattern's share of hits among positive and among negative texts."""
    hits = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(text).rlike(p).alias("hit")) for n, p in rules]))
    rows = texts.select(F.col(positive).alias("positive"), hits.alias("h")).select("positive", "h.*")
    share = lambda c: F.round(F.count_if(c & F.col("hit")) / F.nullif(F.count_if(c), F.lit(0)), 6)
    return rows.groupBy("rule").agg(share(F.col("positive")).alias("recall"), share(~F.col("positive")).alias("false_rate"))


def top_phrases(texts: DataFrame, text: str, k: int, words: tuple[int, int] = (2, 4), size: tuple[int, int] = (6, 40), counters: int = 1 << 16) -> DataFrame:
    """(phrase, n): the k most frequent runs of Latin words in lower-cased texts, ties by the phrase."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z]+(?: [a-z]+){{{words[0] - 1},{words[1] - 1}}}"), F.lit(0))
    return most_frequent(texts.select(F.filter(runs, lambda p: F.length(p).between(*size)).alias("phrases")), "phrases", k, counters).withColumnRenamed("value", "phrase")


def most_frequent(rows: DataFrame, values: str, k: int, counters: int = 1 << 16) -> DataFrame:
    """(value, n): the k most frequent strings of an array column, ties by the value, counted exactly.

    Frequent values are proposed by summaries of `counters` values, one for each task (Misra and Gries): whenever one is
    full, a number is taken from all its counts, and what falls to zero is dropped. A value that a task has dropped, or
    counts too low, is short by at most what the task has taken in all, so over all tasks a value that nobody proposes
    stands at most E times, E being the sum of what they took. The second pass counts what may be among the first k: the
    values whose proposed count and E together reach the k-th highest proposed count. If the k-th of the exact counts is
    over E, no other value can be among them; else the pass is made again with four times the counters, until E is
    small enough (with no more different values in a task than counters it is 0). So what is shuffled are the
    proposals, and not every value of the corpus.
    """
    rows = rows.select(F.col(values).alias("values"))
    while True:
        summaries = stored(rows.mapInArrow(summary_of(counters), "value string, n bigint, taken bigint"), "summaries")
        error = summaries.agg(F.sum("taken")).first()[0] or 0
        proposed = stored(summaries.where("value is not null").groupBy("value").agg(F.sum("n").alias("low")), "proposed")
        kth = proposed.orderBy(F.desc("low")).limit(k).agg(F.min("low"), F.count(F.lit(1))).first()
        likely = proposed.where(F.col("low") + error >= (kth[0] if kth[1] == k else 0))
        if error:
            exact = rows.select(F.explode("values").alias("value")).join(likely.select("value"), "value").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        else:
            exact = likely.select("value", F.col("low").alias("n"))
        top = stored(exact.orderBy(F.desc("n"), "value").limit(k), "top")
        least = top.agg(F.min("n"), F.count(F.lit(1))).first()
        if not error or (least[1] == k and least[0] > error):
            return top
        counters *= 4


def summary_of(counters: int):
    def run(batches):
        counts, taken = {}, 0
        for batch in batches:
            for value, n in counted_values(batch.column(0)):
                counts[value] = counts.get(value, 0) + n
            if len(counts) > 2 * counters:
                # What the first value beyond the counters has is taken from all: at most `counters` are left.
                cut = sorted(counts.values(), reverse=True)[counters]
                taken += cut
                counts = {v: n - cut for v, n in counts.items() if n > cut}
        yield pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.string()), pa.array([*counts.values(), 0], pa.int64()), pa.array([0] * len(counts) + [taken], pa.int64())], ["value", "n", "taken"])

    return run


def counted_values(column: pa.Array):
    found = pc.value_counts(column.flatten())
    return zip(found.field(0).to_pylist(), found.field(1).to_pylist())


def changed(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after) of the keys whose value differs between two runs, or that only one of them has."""
    before, after = a.select(key, F.col(value).alias("before")), b.select(F.col(key).alias("__key"), F.col(value).alias("after"))
    both = before.join(after, F.col(key) == F.col("__key"), "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(F.coalesce(key, "__key").alias(key), "before", "after")
