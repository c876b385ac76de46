"""Named things in texts: dictionaries, their members, pairs of them, and rules that they and facts of the text trigger.

Dictionaries and rule tables are DataFrames of the caller. They are small by nature, but nothing here relies on it: where
a table's size is not known, the joins are left to the planner, which broadcasts only below its own threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normal_key
from .automaton import names_in
from .overlay import keep_first


def members(pairs: DataFrame, group: str, member: str, pos: str) -> DataFrame:
    """(group, members): each group's different members in the order of their first place."""
    first = pairs.groupBy(group, member).agg(F.min(pos).alias("at"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", member))), lambda x: x[member]).alias("members"))


def expanded(names: DataFrame, name: str, bridge: DataFrame, codes: DataFrame) -> DataFrame:
    """names with `member`: a row for each member that bridge(k, pos, member) has for the name's key, else the one of
    codes(k, member), else none (null)."""
    keyed = names.withColumn("k", normal_key(name))
    many = members(bridge, "k", "member", "pos")
    both = keyed.join(many, "k", "left").join(codes.groupBy("k").agg(F.min("member").alias("code")), "k", "left")
    found = F.coalesce("members", F.when(F.col("code").isNotNull(), F.array("code")))
    return both.withColumn("member", F.explode_outer(found)).drop("k", "members", "code")


def class_expanded(terms: DataFrame, term: str, classes: DataFrame) -> DataFrame:
    """terms with `member`: the members of a class(term, member), or the term itself."""
    known = classes.withColumnRenamed(term, "__class").select("__class", "member").distinct()
    return terms.join(known, F.col(term) == F.col("__class"), "left").withColumn("member", F.coalesce("member", F.col(term))).drop("__class")


def mentioned(texts: DataFrame, key: str, text: str, dictionary: DataFrame, name: str, least: int = 2) -> DataFrame:
    """(key, name): the names of a dictionary table that a text holds, both without case, spaces and middle dots."""
    return names_in(texts, key, text, dictionary, name, least, "names").drop("start")


def pairs_of(items: DataFrame, group: str, item: str, pairs: DataFrame) -> DataFrame:
    """(group, a, b, kind, reason): the pairs of a group's different items that pairs(a, b, kind, reason) lists.

    The listed pairs are looked up from their least item on: a group's items meet only the partners that are listed for
    them, and never all the others.
    """
    own = items.select(group, F.col(item).alias("a")).distinct()
    listed = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind", "reason")
    asked = own.join(listed, "a")
    return asked.join(own.withColumnRenamed("a", "b"), [group, "b"]).select(group, "a", "b", "kind", "reason")


def crossed(items: DataFrame, risks: DataFrame, rules: DataFrame, group: str) -> DataFrame:
    """(group, item, risk_type, reason, pos): rules(item, risk_type, reason) met by a group's items(group, item, pos) and
    risks(group, risk_type); the first place of each counts."""
    found = items.join(rules, "item").join(risks.select(group, "risk_type").distinct(), [group, "risk_type"])
    return keep_first(found.select(group, "item", "risk_type", "reason", "pos"), [group, "item", "risk_type"], ["pos", "reason"])


def verified(mentions: DataFrame, texts: DataFrame, key: str, dictionary: DataFrame) -> DataFrame:
    """mentions(key, pos, name, span) whose span stands in the text (as it is or normalised) and whose name a
    dictionary(k) has; the first of each key and name's key."""
    held = mentions.join(texts.select(key, F.col("text").alias("__text")), key)
    stands = F.contains("__text", F.col("span")) | F.contains(normal_key("__text", r"(?!)"), normal_key("span", r"(?!)"))
    named = held.where((F.col("span") != "") & stands).drop("__text").withColumn("k", normal_key("name"))
    known = named.join(dictionary.select("k").distinct(), "k", "left_semi")
    return keep_first(known, [key, "k"], ["pos"])


def first_by_type(layers: list[DataFrame], key: str, kind: str) -> DataFrame:
    """The rows of several tables in order, the first of each (key, kind)."""
    rows = layers[0].withColumn("layer", F.lit(0))
    for i, layer in enumerate(layers[1:], 1):
        rows = rows.unionByName(layer.withColumn("layer", F.lit(i)))
    rest = [c for c in rows.columns if c not in (key, kind, "layer")]
    return keep_first(rows, [key, kind], ["layer", *rest])


def hits_once(hits: DataFrame, group: str, keys: list[str], severity: str, pos: str) -> DataFrame:
    """The hits of a group without repeats: of equal keys the most severe, then the first."""
    return keep_first(hits, [group, *keys], [-F.col(severity), F.col(pos)])


def severe_first(hits: DataFrame, group: str, severity: str, pos: str, critical: int = 90, notices: int = 2) -> DataFrame:
    """hits with `part`: all from `critical` on, and the `notices` most severe of the rest."""
    few = Window.partitionBy(group).orderBy(F.desc(severity), pos)
    rest = hits.where(F.col(severity) < critical).withColumn("__n", F.row_number().over(few)).where(F.col("__n") <= notices).drop("__n")
    return hits.where(F.col(severity) >= critical).withColumn("part", F.lit("critical")).unionByName(rest.withColumn("part", F.lit("notice")))


def risks_in(text: Column, patterns: dict[str, str], age_pattern: str, age: Column | None = None, elderly: int = 65, child: int = 12) -> Column:
    """(risk_type, matched) of each risk whose pattern a text matches, its first match, in the patterns' order; then
    elderly or pediatric by the age in the text, or else by `age`."""
    found = [F.when(text.rlike(p), F.struct(F.lit(k).alias("risk_type"), F.regexp_extract(text, p, 0).alias("matched"))) for k, p in patterns.items()]
    said = F.regexp_extract(text, age_pattern, 1).try_cast("int")
    years = said if age is None else F.coalesce(said, age)
    by_age = F.when(years >= elderly, F.lit("elderly")).when(years < child, F.lit("pediatric"))
    found.append(F.when(by_age.isNotNull(), F.struct(by_age.alias("risk_type"), years.cast("string").alias("matched"))))
    return F.array_compact(F.array(*found))
