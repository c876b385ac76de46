"""Operators over dialogue turns (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_user(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, text) of each conversation's last user turn."""
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """Each conversation's last n turns."""
    latest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("__n", latest).where(F.col("__n") <= n).drop("__n")


def transcript(turns: DataFrame, joint: str) -> DataFrame:
    """(conv_id, text): a conversation's turns in order, joined."""
    said = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(said, lambda t: t["text"]), joint).alias("text"))


def recent_context(turns: DataFrame, short: int = 80) -> DataFrame:
    """(conv_id, text): the last user turn, after the one before it if it is short."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    said = last_turns(turns.where("role = 'user'"), 2).withColumn("before", F.lag("text").over(order)).groupBy("conv_id").agg(F.max_by(F.struct("text", "before"), "turn").alias("x"))
    both = F.concat_ws("\n", "x.before", "x.text")
    return said.select("conv_id", F.when((F.length(F.trim("x.text")) <= short) & F.col("x.before").isNotNull(), both).otherwise(F.col("x.text")).alias("text"))


def clean_history(turns: DataFrame, most: int = 20) -> DataFrame:
    """User and assistant turns with text, the last `most` of each conversation."""
    kept = turns.where("role in ('user', 'assistant') and length(trim(text)) > 0")
    return last_turns(kept, most)


def deictic(turns: DataFrame, name: str, back: int = 3) -> DataFrame:
    """(conv_id, entity): the one name that a conversation's earlier user turns (the last `back`, not repeating the last
    turn's text) speak of; null where there is none or more than one."""
    said = turns.where("role = 'user'")
    now = last_user(turns).select("conv_id", F.col("turn").alias("now"), F.col("text").alias("current"))
    earlier = last_turns(said.join(now, "conv_id").where("turn < now and text != current"), back)
    found = earlier.select("conv_id", F.nullif(F.regexp_extract("text", name, 0), F.lit("")).alias("entity")).dropna()
    one = found.groupBy("conv_id").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("entity"))
    return now.select("conv_id").join(one.where("n = 1"), "conv_id", "left").select("conv_id", "entity")


def session(turns: DataFrame, taking: str, medicine: str, age: str, duration: str, risks: dict[str, str], flag: str | None = None, cuts: tuple[int, int] = (1200, 1200), latest: int = 8) -> DataFrame:
    """A conversation's facts, folded over all its turns but the last user turn.

    The earliest age and the earliest duration win; a risk is kept from its first turn; a named medicine is taken if its turn matches `taking`,
    else asked about; once a turn has the risk `flag`, the conversation stays flagged. The folds are ordered aggregates, so
    that one pass over the turns makes them. history has the `latest` turns of user and assistant, cut to so many
    characters each, in order.
    """
    now = last_user(turns).select("conv_id", F.col("turn").alias("now"))
    old = turns.where("role = 'user'").join(now, "conv_id").where("turn != now")
    text = F.col("text")
    named = F.nullif(F.regexp_extract(text, medicine, 0), F.lit(""))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("turn")))
    seen = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    kinds = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in risks.items()]))
    facts = old.groupBy("conv_id").agg(
        first(F.nullif(F.regexp_extract(text, age, 0), F.lit(""))).alias("age"),
        first(F.nullif(F.regexp_extract(text, duration, 0), F.lit(""))).alias("duration"),
        seen(F.when(text.rlike(taking), named)).alias("taking"),
        seen(F.when(~text.rlike(taking), named)).alias("asked_about"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(kinds)))), ",").alias("risks"),
        (F.bool_or(text.rlike(risks[flag])) if flag else F.lit(False)).alias("flagged"),
        F.count(F.lit(1)).alias("n_turns"),
    )
    said = turns.where("role in ('user', 'assistant')").join(now, "conv_id").where("role != 'user' or turn != now")
    cut = F.left(F.coalesce("text", F.lit("")), F.when(F.col("role") == "user", cuts[0]).otherwise(cuts[1]))
    shown = last_turns(said, latest).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", cut.alias("text")))).alias("xs"))
    shown = shown.select("conv_id", F.transform("xs", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("history"))
    rows = now.select("conv_id").join(facts, "conv_id", "left").join(shown, "conv_id", "left").na.fill("", ["taking", "asked_about", "risks"]).na.fill(0, ["n_turns"])
    return rows.withColumn("flagged", F.coalesce("flagged", F.lit(False))).withColumn("history", F.coalesce("history", F.array().cast("array<struct<role:string,text:string>>")))
