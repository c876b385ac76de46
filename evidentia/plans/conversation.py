"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversation as C
from .common import query, table


@query("last_user", "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user(spark, d):
    return C.last_user(table(spark, d, "conversations"))


@query(
    "transcript",
    "SELECT conv_id, string_agg(role || ': ' || left(text, 700), chr(10) ORDER BY turn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant')) WHERE n <= 5 GROUP BY conv_id",
)
def transcript(spark, d):
    said = table(spark, d, "conversations").where("role in ('user', 'assistant')").withColumn("text", F.concat("role", F.lit(": "), F.left("text", F.lit(700))))
    return C.transcript(C.last_turns(said, 5), "\n")


@query(
    "recent_context",
    "SELECT conv_id, CASE WHEN length(trim(text)) <= 80 AND before IS NOT NULL THEN before || chr(10) || text ELSE text END AS text FROM (SELECT conv_id, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') WHERE n = 1",
)
def recent_context(spark, d):
    return C.recent_context(table(spark, d, "conversations"))


@query("clean_history", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant') AND length(trim(text)) > 0) WHERE n <= 4")
def clean_history(spark, d):
    return C.clean_history(table(spark, d, "conversations"), 4).select("conv_id", "turn", "role", "text")


NAME = "th[a-z]{3,8}"


@query(
    "deictic_resolve",
    f"WITH n AS (SELECT conv_id, max(turn) AS now, arg_max(text, turn) AS current FROM conversations WHERE role = 'user' GROUP BY conv_id), e AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations JOIN n USING (conv_id) WHERE role = 'user' AND turn < now AND text <> current), "
    f"f AS (SELECT conv_id, count(DISTINCT x) AS c, min(x) AS entity FROM (SELECT conv_id, nullif(regexp_extract(text, '{NAME}'), '') AS x FROM e WHERE k <= 3) GROUP BY conv_id) SELECT n.conv_id, CASE WHEN c = 1 THEN entity END AS entity FROM n LEFT JOIN f USING (conv_id)",
)
def deictic_resolve(spark, d):
    return C.deictic(table(spark, d, "conversations"), NAME)


PACK = {"taking": "(?: the | de )", "medicine": "[a-z]*tion[a-z]*", "age": "[0-9]+", "duration": "[0-9]+ [a-z]+", "risks": {"a": "ous", "b": "ent", "c": "ich"}, "flag": "b"}


#: {user} and {assistant}: the characters to which turns are cut.
SESSION = (
    "WITH n AS (SELECT conv_id, max(turn) AS now FROM conversations WHERE role = 'user' GROUP BY conv_id), o AS (SELECT conv_id, turn, text, nullif(regexp_extract(text, '[a-z]*tion[a-z]*'), '') AS m, nullif(regexp_extract(text, '[0-9]+'), '') AS g, nullif(regexp_extract(text, '[0-9]+ [a-z]+'), '') AS u, regexp_matches(text, '(?: the | de )') AS tk FROM conversations JOIN n USING (conv_id) WHERE role = 'user' AND turn <> now), "
    "f AS (SELECT conv_id, arg_min(g, turn) FILTER (WHERE g IS NOT NULL) AS age, arg_min(u, turn) FILTER (WHERE u IS NOT NULL) AS duration, coalesce(array_to_string(list_sort(list_distinct(list(m) FILTER (WHERE tk AND m IS NOT NULL))), ','), '') AS taking, coalesce(array_to_string(list_sort(list_distinct(list(m) FILTER (WHERE NOT tk AND m IS NOT NULL))), ','), '') AS asked_about, "
    "bool_or(contains(text, 'ent')) AS flagged, concat_ws(',', CASE WHEN bool_or(contains(text, 'ous')) THEN 'a' END, CASE WHEN bool_or(contains(text, 'ent')) THEN 'b' END, CASE WHEN bool_or(contains(text, 'ich')) THEN 'c' END) AS risks, count(*) AS n_turns FROM o GROUP BY conv_id), "
    "h AS (SELECT conv_id, string_agg(role || ':' || left(coalesce(text, ''), CASE role WHEN 'user' THEN {user} ELSE {assistant} END), chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations JOIN n USING (conv_id) WHERE role IN ('user', 'assistant') AND (role <> 'user' OR turn <> now)) WHERE k <= 8 GROUP BY conv_id) "
    "SELECT n.conv_id, age, duration, coalesce(taking, '') AS taking, coalesce(asked_about, '') AS asked_about, coalesce(risks, '') AS risks, coalesce(flagged, false) AS flagged, md5(coalesce(history, '')) AS history, coalesce(n_turns, 0) AS n_turns FROM n LEFT JOIN f USING (conv_id) LEFT JOIN h USING (conv_id)"
)


def history_digest(c="history"):
    return F.md5(F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["role"], x["text"])), "\n")).alias("history")


@query("session_replay", SESSION.replace("{user}", "1200").replace("{assistant}", "1200"))
def session_replay(spark, d):
    found = C.session(table(spark, d, "conversations"), **PACK)
    return found.select(*[c for c in found.columns if c != "history"], history_digest())


@query(
    "proxy_score",
    "SELECT conv_id, round(greatest(0.0, least(1.0, (raw + 25) / 44.0::DOUBLE)), 4) AS score FROM (SELECT conv_id, CASE WHEN length(a) > 200 THEN 8 ELSE -5 END + CASE WHEN contains(z, '.') THEN 4 ELSE -4 END + CASE WHEN regexp_matches(z, '[0-9]') THEN 3 ELSE 0 END + CASE WHEN length(z) < 40 THEN -10 ELSE 2 END + CASE WHEN a = z THEN -6 ELSE 1 END + CASE WHEN contains(a, 'the') THEN 1 ELSE 0 END AS raw FROM (SELECT conv_id, arg_min(text, turn) AS a, arg_max(text, turn) AS z FROM conversations WHERE role = 'assistant' GROUP BY conv_id))",
)
def proxy_score(spark, d):
    """Additive features of the first and the last answer, scaled from -25..19 to 0..1."""
    ends = table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("z"))
    a, z = F.col("a"), F.col("z")
    points = lambda c, yes, no: F.when(c, yes).otherwise(no)
    raw = points(F.length(a) > 200, 8, -5) + points(F.contains(z, F.lit(".")), 4, -4) + points(z.rlike("[0-9]"), 3, 0) + points(F.length(z) < 40, -10, 2) + points(a == z, -6, 1) + points(F.contains(a, F.lit("the")), 1, 0)
    return ends.select("conv_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw + 25) / 44.0)), 4).alias("score"))
