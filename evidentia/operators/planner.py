"""Planning calls: normal arguments, repeats, closed tools, budgets of calls and time, and what a recorded log shows of them.

A log has a row for each requested call, in the order of `pos` within a `request`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import stored
from .overlay import keep_first
from .ranks import BLOCK, placed, running_sum


def normal_arguments(calls: DataFrame, spec: DataFrame, pools: DataFrame, language: Column, words_up: bool = True) -> DataFrame:
    """calls(request, tool, value, corpus) with `query` and `skip`.

    spec(tool, lang, form) says which language a tool takes (null: that of its corpus, else any) and in which form.
    `language` is a call value's language. An empty value, or one in another language, gives way to the first filled text
    of pools(request, form, lang, pos, text); where there is none, `skip` says why. A tool of form keywords gets a
    sentence as its keywords, one of form ingredient gets its words' first letters in upper case. Tools without a spec
    pass as they are.
    """
    rows = calls.join(spec.withColumn("__known", F.lit(True)), "tool", "left").withColumn("lang", F.coalesce("lang", "corpus"))
    filled = pools.where(F.trim("text") != "")
    best = filled.groupBy("request", "form", "lang").agg(F.min_by("text", "pos").alias("own"))
    any_lang = filled.groupBy("request", "form").agg(F.min_by("text", "pos").alias("any"))
    rows = rows.join(best, ["request", "form", "lang"], "left").join(any_lang, ["request", "form"], "left")
    value = F.trim(F.coalesce("value", F.lit("")))
    wrong = (value == "") | F.coalesce(language != F.col("lang"), F.lit(False))
    pooled = F.when(F.col("lang").isNull(), F.col("any")).otherwise(F.col("own"))
    picked = F.when(F.col("__known").isNull(), value).when(wrong, pooled).otherwise(value)
    formed = F.when((F.col("form") == "keywords") & X.is_sentence(picked), X.keywords(picked)).when((F.col("form") == "ingredient") & F.lit(words_up), first_letters_up(picked)).otherwise(picked)
    skip = F.when(picked.isNull(), F.concat(F.lit("no text in "), F.coalesce("lang", F.lit("any"))))
    return rows.withColumn("query", formed).withColumn("skip", skip).drop("__known", "own", "any")


def first_letters_up(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), " ")


def corpus_language(tool: Column, args: Column, matched: list[str], tags: dict[str, str], collections: dict[str, str], databases: dict[str, str]) -> Column:
    """The language of what a call searches, from its arguments' JSON: en for tools that are matched by summaries, else by
    corpus_tag, then collection_name, then db_name, the first that is listed; any where none is."""
    found = []
    for field, table in (("corpus_tag", tags), ("collection_name", collections), ("db_name", databases)):
        if table:
            listed = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
            found.append(F.try_element_at(listed, F.coalesce(F.get_json_object(args, f"$.{field}"), F.lit(""))))
    return F.when(tool.isin(*matched), "en").otherwise(F.coalesce(*found, F.lit("any")))


def offered(definitions: DataFrame, wanted: list[str], most: int = 900) -> DataFrame:
    """(place, name, description, schema) of the wanted tools that definitions(name, description, schema) has, in the
    order of the request; unknown names are left out, descriptions are cut, a missing schema is an empty object's."""
    named = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")
    rows = definitions.where(F.col("name").isin(*wanted)).withColumn("place", F.array_position(named, F.col("name")))
    empty = F.lit('{"type": "object", "properties": {}}')
    return rows.select("place", "name", F.left(F.coalesce("description", F.lit("")), F.lit(most)).alias("description"), F.coalesce("schema", empty).alias("schema"))


def call_key(tool: Column, args: Column) -> Column:
    """A call's key: the tool and its arguments (a map) sorted by name."""
    pairs = F.transform(F.array_sort(F.map_entries(args)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.concat_ws("|", tool, F.array_join(pairs, "&"))


def first_calls(calls: DataFrame, keys: list[str], pos: str) -> DataFrame:
    return keep_first(calls, keys, [pos])


def barren(calls: DataFrame, request: str, tool: str, pos: str, fruitful: str, most: int = 2, block: int = BLOCK) -> DataFrame:
    """calls with `run`, a tool's calls without result since its last fruitful one, and `closed`: whether the tool was
    closed before this call, since a run had reached `most`. A log may put any share of its calls under one tool: what
    is known of the calls before comes from places and sums that are scanned in blocks."""
    group = [request, tool]
    known = placed(calls.withColumn("__good", F.col(fruitful).cast("int")), group, [F.col(pos)], "__nth", block)
    known = stored(running_sum(known, group, [F.col("__nth")], F.col("__good"), "__island", block), "islands")
    # A fruitful call begins an island; before the first one there is an island without such a call.
    begins = known.groupBy(F.struct(*group, "__island").alias("__of")).agg(F.min("__nth").alias("__begin"))
    run = F.col("__nth") - F.col("__begin") + (F.col("__island") == 0).cast("bigint")
    rows = known.withColumn("__own", F.struct(*group, "__island")).join(begins, F.col("__own") == F.col("__of")).withColumn("run", run)
    rows = stored(rows.drop("__own", "__of", "__begin"), "runs")
    ends = rows.where(F.col("run") >= most).groupBy(F.struct(*group).alias("__group")).agg(F.min("__nth").alias("__end"))
    joined = rows.withColumn("__own", F.struct(*group)).join(ends, F.col("__own") == F.col("__group"), "left")
    return joined.select(*calls.columns, "run", F.coalesce(F.col("__nth") > F.col("__end"), F.lit(False)).alias("closed"))


def hop_budget(budget: Column, least: Column, urgent: Column) -> Column:
    return F.when(urgent, budget).otherwise(F.greatest(budget, least))


def call_cap(remaining: Column, cap: Column, floor: Column, reserve: Column) -> Column:
    """The time that a call may take: what is left after the reserve, within floor and cap; null without a deadline."""
    return F.when(remaining.isNotNull(), F.greatest(floor, F.least(cap, remaining - reserve)))


def answer_timeout(remaining: Column, cap: Column, floor: Column) -> Column:
    return call_cap(remaining, cap, floor, F.lit(0.0))


def digest_gate(mode: Column, size: Column, budget: Column, dropped: Column, remaining: Column, least_size: int, least_time: float) -> Column:
    """Why a text is not digested, the first reason in order; null where it is."""
    return (
        F.when(mode == "off", "mode").when(size < least_size, "small").when(size < 2 * budget, "fits").when(dropped == 0, "whole")
        .when(F.coalesce(remaining < least_time, F.lit(False)), "late")
    )


def tool_cap(tool: Column, quick: list[str], short: float = 8.0, long: float = 18.0) -> Column:
    """The most seconds that a tool may take: quick ones less."""
    return F.when(tool.isin(*quick), short).otherwise(long)


def repeats(calls: DataFrame, key: str, at: str, order: str, ok: str, within: float, block: int = BLOCK) -> DataFrame:
    """calls with `since`, the time since the last earlier call of the same key that went well, and `repeat`: whether that is
    less than `within`. It says what of a log a cache might have answered; no cache is played through.

    How many good calls came before is a running sum, scanned in blocks, so that no key is sorted in one task; the last of
    them is then looked up by its number.
    """
    good = F.coalesce(F.col(ok), F.lit(False)).cast("bigint")
    known = stored(running_sum(calls.withColumn("__good", good), [key], [F.col(at), F.col(order)], F.col("__good"), "__upto", block), "calls")
    last = known.where("__good = 1").select(F.struct(key, F.col("__upto").alias("n")).alias("__last"), F.col(at).alias("__at"))
    joined = known.withColumn("__own", F.struct(key, (F.col("__upto") - F.col("__good")).alias("n"))).join(last, F.col("__own") == F.col("__last"), "left")
    since = F.col(at) - F.col("__at")
    return joined.select(*calls.columns, since.alias("since"), F.coalesce(since < within, F.lit(False)).alias("repeat"))


def over_budget(log: DataFrame, request: str, pos: str, key: str, valid: str, seconds: str, most: int, most_seconds: int, block: int = BLOCK) -> DataFrame:
    """(request, pos, kind, n_before, spent_before) for each call of a log: whether it broke its contract (not valid), asked
    again what the request had asked before, came after `most` different valid calls, or after `most_seconds` (whole
    seconds) of them; else fine. Sums run over all different valid calls of a request, scanned in blocks: the log is
    counted, and no planner is played through."""
    good = log.where(F.coalesce(F.col(valid), F.lit(False)))
    first = good.groupBy(F.struct(request, key).alias("__first")).agg(F.min(pos).alias("__pos"))
    rows = log.withColumn("__own", F.struct(request, key)).join(first, F.col("__own") == F.col("__first"), "left")
    counts = F.coalesce(F.col(valid) & (F.col(pos) == F.col("__pos")), F.lit(False))
    rows = rows.withColumn("__counts", counts.cast("bigint")).withColumn("__cost", F.when(counts, F.col(seconds)).otherwise(0).cast("bigint")).drop("__own", "__first")
    rows = running_sum(rows, [request], [F.col(pos)], F.col("__counts"), "__n", block)
    rows = running_sum(rows, [request], [F.col(pos)], F.col("__cost"), "__spent", block)
    n, spent = F.col("__n") - F.col("__counts"), F.col("__spent") - F.col("__cost")
    kind = F.when(~F.coalesce(F.col(valid), F.lit(False)), "contract").when(F.col(pos) > F.col("__pos"), "repeat").when(n >= most, "over calls").when(spent >= most_seconds, "over time").otherwise("fine")
    return rows.select(request, pos, kind.alias("kind"), n.alias("n_before"), spent.alias("spent_before"))
