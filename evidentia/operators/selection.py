"""Scoring passages and selecting them under budgets.

Budgets are folds over one item's passages (at most some hundreds), kept in an array beside the item: a fold needs no
shuffle of its own, and items are spread over all tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .ranks import first_by, running_sum


def passage_scores(items: DataFrame, key: str, text: str, query: str, separator: str = r"\n\s*\n", least: int = 30) -> DataFrame:
    """(key, pos, passage, score): each item's paragraphs, scored against its query by rare shared tokens and by facts.

    Document frequencies are counted over one item's paragraphs, so that all of it happens inside the item's row.
    """
    own = items.select(key, X.paragraphs(text, separator, least).alias("ps"), X.tokens(query).alias("q"))
    own = own.select(key, "ps", "q", F.transform("ps", X.tokens).alias("ts"))
    shared = own.withColumn("hits", F.transform("ts", lambda t: F.array_intersect(t, F.col("q"))))
    # For each token of the query: in how many paragraphs it stands.
    df = F.transform("q", lambda w: F.aggregate("hits", F.lit(0), lambda n, h: n + F.array_contains(h, w).cast("int")))
    rows = shared.withColumn("df", F.map_from_arrays("q", df)).select(key, F.size("ps").alias("n"), "df", F.posexplode(F.arrays_zip("ps", "ts", "hits")).alias("pos", "x"))
    lex = F.aggregate("x.hits", F.lit(0.0), lambda s, w: s + F.log(1 + F.col("n") / (1 + F.element_at("df", w)))) / F.greatest(F.lit(1.0), F.sqrt(F.size("x.ts")))
    score = 0.6 * F.least(F.lit(1.0), lex / 2) + 0.9 * X.fact_density(F.col("x.ps"))
    return rows.select(key, "pos", F.col("x.ps").alias("passage"), score.alias("score"))


def greedy_fit(costs: Column, budget, stop: bool = False) -> Column:
    """For an array of structs with `cost`, in order of choice: those that fit a budget; a misfit is skipped, or ends it."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(True).alias("open"), F.filter(costs, lambda x: F.lit(False)).alias("out"))

    def step(s, x):
        fits = s["open"] & (s["used"] + x["cost"] <= budget)
        return F.struct(F.when(fits, s["used"] + x["cost"]).otherwise(s["used"]).alias("used"), (fits | (F.lit(not stop) & s["open"])).alias("open"), F.when(fits, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    return F.aggregate(costs, start, step, lambda s: s["out"])


def pruned(items: DataFrame, key: str, text: str, query: str, budget: int, separator: str = r"\n", joint: str = "\n\n", least: int = 30) -> DataFrame:
    """(key, text, dropped): each item's text within a budget of characters.

    A text that fits stays. Else its paragraphs are taken by falling score (to nine digits), then place, each with one character more
    than its length, those that do not fit being skipped; if the best one does not fit, it is cut and stands alone. What
    is taken stands in its first order, with a mark of how many were left out.
    """
    whole = F.trim(F.coalesce(F.col(text), F.lit("")))
    scores = passage_scores(items.where(F.length(whole) > budget), key, text, query, separator, least)
    own = scores.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("rank"), "pos", (F.length("passage") + 1).cast("bigint").alias("cost"), "passage"))).alias("ps"))
    kept = greedy_fit(F.col("ps"), budget)
    own = own.select(key, "ps", kept.alias("kept"))
    alone = F.col("ps")[0]["cost"] > budget
    ordered = F.array_join(F.transform(F.array_sort(F.transform("kept", lambda x: F.struct(x["pos"].alias("pos"), x["passage"].alias("passage")))), lambda x: x["passage"]), joint)
    dropped = F.when(alone, F.size("ps") - 1).otherwise(F.size("ps") - F.size("kept"))
    taken = own.select(F.col(key).alias("__key"), F.when(alone, F.left(F.col("ps")[0]["passage"], F.lit(budget))).otherwise(ordered).alias("__taken"), dropped.alias("__dropped"))
    rows = items.select(key, whole.alias("__whole")).join(taken, F.col(key) == F.col("__key"), "left")
    mark = F.when((F.col("__dropped") > 0) & ~F.col("__taken").isNull(), F.concat(F.lit(f"{joint}[+"), F.col("__dropped"), F.lit("]"))).otherwise("")
    out = F.when(F.length("__whole") <= budget, F.col("__whole")).when(F.col("__taken").isNull(), F.left("__whole", F.lit(budget))).otherwise(F.concat("__taken", mark))
    return rows.select(key, out.alias("text"), F.coalesce("__dropped", F.lit(0)).alias("dropped"))


def packed_evidence(evidence: DataFrame, group: str, budget: int, least_room: int = 200, least_share: int = 300) -> DataFrame:
    """(group, pos, place, text): evidence(group, pos, relevance, text) within a budget for each group.

    Of equal fingerprints the first stays (empty ones all stay). Each gets an even share, or what room is left; with too
    little room the rest is left out. Of three or more, the most relevant stands first and the second last.
    """
    first = Window.partitionBy(group, "fp").orderBy("pos")
    unique = evidence.withColumn("fp", X.fingerprint("text")).withColumn("k", F.row_number().over(first)).where("k = 1 or fp = ''")
    own = unique.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "relevance", "text"))).alias("xs"))
    share = F.greatest(F.lit(least_share), F.floor(F.lit(budget) / F.size("xs"))).cast("int")
    own = own.withColumn("share", share)
    start = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"), F.filter("xs", lambda x: F.lit(False)).alias("out"))

    def step(s, x):
        room = F.least(F.col("share"), F.lit(budget) - s["used"])
        cut = F.left(x["text"], room)
        fits = s["open"] & (room >= least_room)
        taken = fits & (cut != "")
        item = F.struct(x["pos"].alias("pos"), x["relevance"].alias("relevance"), cut.alias("text"))
        return F.struct(F.when(taken, s["used"] + F.length(cut)).otherwise(s["used"]).alias("used"), fits.alias("open"), F.when(taken, F.concat(s["out"], F.array(item))).otherwise(s["out"]).alias("out"))

    rows = own.select(group, F.explode(F.aggregate("xs", start, step, lambda s: s["out"])).alias("x")).select(group, "x.*")
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("relevance"), "pos"))
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    rows = rows.withColumn("rank", best).withColumn("n", n)
    side = F.when((F.col("n") >= 3) & (F.col("rank") == 1), 0).when((F.col("n") >= 3) & (F.col("rank") == 2), 2).otherwise(1)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(side, "pos"))).select(group, "pos", "place", "text")


def quota_top(docs: DataFrame, group: str, source: str, k: int) -> DataFrame:
    """Each group's k best docs(group, source, score, pos), at most k // 2 of a source, but for the last place; then
    filled up with the best left out. A group's candidates stand in one array: they are bounded by the search."""
    cap = max(1, k // 2)
    own = docs.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "pos", F.col(source).alias("source")))).alias("xs"))
    none = F.filter("xs", lambda x: F.lit(False))

    def step(out, x):
        full = F.size(F.filter(out, lambda y: y["source"] == x["source"])) >= cap
        return F.when((F.size(out) >= k) | (full & (F.size(out) < k - 1)), out).otherwise(F.concat(out, F.array(x)))

    chosen = F.when(F.size("xs") <= k, F.col("xs")).otherwise(F.aggregate("xs", none, step))
    filled = own.select(group, "xs", chosen.alias("got")).select(group, F.slice(F.concat("got", F.array_except("xs", "got")), 1, k).alias("got"))
    return filled.select(group, F.posexplode("got").alias("place", "x")).select(group, (F.col("place") + 1).alias("place"), "x.pos", "x.source")


def within_budget(docs: DataFrame, group: str, order: list, cost: Column, budget: int, stop: bool = False) -> DataFrame:
    """(group, n_kept, n_dropped, used): a group's docs in order that fit a budget; see greedy_fit.

    However many docs a group has, few can be kept, and only those are gathered. Where a misfit ends it, they are the
    ones whose running cost is within the budget. Where misfits are skipped, what is left of the budget only falls: of
    the docs of one cost, those kept are the first ones, and budget // cost of them at most. Costs are whole and
    positive; docs that cost more than the budget are counted as dropped.
    """
    ranks = [c.alias(f"o{i}") for i, c in enumerate(order)]
    rows = docs.select(group, *ranks, cost.cast("bigint").alias("cost"))
    by = [f"o{i}" for i in range(len(order))]
    total = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    if stop:
        few = running_sum(rows, [group], [F.col(o) for o in by], F.col("cost"), "upto").where(F.col("upto") <= budget)
        kept = few.groupBy(group).agg(F.count(F.lit(1)).alias("n_kept"), F.sum("cost").alias("used"))
    else:
        place = F.row_number().over(Window.partitionBy(group, "cost").orderBy(*by))
        few = rows.where(F.col("cost") <= budget).withColumn("place", place).where((F.col("place") <= budget) & (F.col("place") * F.col("cost") <= budget))
        own = few.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*by, "cost"))).alias("xs")).select(group, greedy_fit(F.col("xs"), budget).alias("kept"))
        kept = own.select(group, F.size("kept").cast("bigint").alias("n_kept"), F.aggregate("kept", F.lit(0).cast("bigint"), lambda s, x: s + x["cost"]).alias("used"))
    both = total.join(kept, group, "left")
    n = F.coalesce("n_kept", F.lit(0).cast("bigint"))
    return both.select(group, n.alias("n_kept"), (F.col("n") - n).alias("n_dropped"), F.coalesce("used", F.lit(0).cast("bigint")).alias("used"))


def hash_split(docs: DataFrame, key: str, share: float) -> DataFrame:
    """docs with held: whether a document is among the floor(n * share) that are held out, those of the least hash of their
    key (ties to the smaller key). The size is exact and nothing is sorted: the hash at the cut is found by counting."""
    order = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("bigint")
    return first_by(docs, F.coalesce(order, F.lit(-1).cast("bigint")), [F.col(key)], math.floor(docs.count() * share), "held")


def evict_oldest(messages: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """messages with evicted: the oldest go until what is left of a group is within the budget."""
    return running_sum(messages, [group], [F.desc(order)], F.col(size), "__upto").withColumn("evicted", F.col("__upto") > budget).drop("__upto")


def best_items(items: DataFrame, group: str, score: str, pos: str, most: int = 6) -> DataFrame:
    """items with `place`: the `most` of each group with the highest score (null: 0), of equal ones the first. Each task
    cuts its own before the rows are shuffled."""
    order = Window.partitionBy(group).orderBy(F.desc(F.coalesce(score, F.lit(0.0))), pos)
    return items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
