"""Queries over recorded replies: the tables at hand are written as a log of attempts, which the data source reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import replies as R
from ..sources.shared import new_path
from .common import query, table

TOTAL, PER_TRY, TRIES = 70.0, 40.0, 3
STATUS = "CASE (event_id * 7 + attempt * 3) % 10 WHEN 0 THEN 503 WHEN 1 THEN 429 WHEN 2 THEN 404 WHEN 3 THEN NULL ELSE 200 END"
SECONDS = "value / 2 + attempt"
BODIES = [
    ('{"jsonrpc": "2.0", "result": {"content": [{"type": "text", "text": "', "plain words", '"}]}}'),
    ('event: message\r\ndata: {"result": {"structuredContent": {"result": ', None, "}}}\r\n\r\n"),
    ('{"error": {"code": -32000, "message": "', "no such tool", '"}}'),
    ('{"result": {"isError": true, "content": [{"text": "', "upstream is down", '"}]}}'),
    ("<html>", "busy", "</html>"),
    (': a note\ndata: not json\ndata: {"result": {"content": [{"text": "', "after a note", '"}]}}\n'),
    ('{"result": {"found": ', None, "}}"),
]


def attempts(spark, d):
    """(tool, key, attempt, status, seconds, body): three attempts of each event, in seven kinds of bodies."""
    events = table(spark, d, "events").select("event_id", "event_type", "value", "props", F.explode(F.array(*map(F.lit, range(TRIES)))).alias("attempt"))
    body = F.lit(None).cast("string")
    for i, (before, inside, after) in enumerate(BODIES):
        body = F.when(F.col("event_id") % len(BODIES) == i, F.concat(F.lit(before), F.col("props") if inside is None else F.lit(inside), F.lit(after))).otherwise(body)
    return events.select(F.col("event_type").alias("tool"), F.col("event_id").cast("string").alias("key"), F.col("attempt").cast("int").alias("attempt"), F.expr(STATUS).cast("int").alias("status"), F.expr(SECONDS).cast("double").alias("seconds"), body.alias("body"))


def logged(spark, rows):
    path = new_path(spark, "replies")
    R.recorded(rows, path)
    return R.replies(spark, path)


@query("replies_read", f"SELECT event_type AS tool, event_id::VARCHAR AS key, attempt, {STATUS} AS status, {SECONDS} AS seconds FROM events, range({TRIES}) r(attempt) WHERE event_type IN ('click', 'error') AND value > 20")
def replies_read(spark, d):
    """The attempts of two tools that took their time: the tool is the reader's to filter by, the time is Spark's."""
    return logged(spark, attempts(spark, d)).where("tool in ('click', 'error') and seconds - attempt > 10").select("tool", "key", "attempt", "status", "seconds")


def fold_sql() -> str:
    """What the attempts of a call come to, one attempt after the other."""
    steps = [f"x0 AS (SELECT *, 0.0::DOUBLE AS base, true AS goes, 0 AS n, 0.0::DOUBLE AS spent, NULL::VARCHAR AS said FROM (SELECT event_id, event_type, value, props FROM events))"]
    for i in range(TRIES):
        status, seconds = STATUS.replace("attempt", str(i)), SECONDS.replace("attempt", str(i))
        wait = f"least({PER_TRY}::DOUBLE, {TOTAL}::DOUBLE - base)"
        said = f"CASE WHEN sec > {wait} THEN 'late' WHEN st IS NULL THEN 'broken' WHEN st = 200 THEN 'answered' WHEN st IN (503, 429) THEN 'busy' ELSE 'refused' END"
        steps.append(f"y{i} AS (SELECT *, ({status}) AS st, ({seconds}) AS sec FROM x{i}), z{i} AS (SELECT * EXCLUDE (st, sec, n, spent, said), CASE WHEN goes THEN {i + 1} ELSE n END AS n, CASE WHEN goes THEN base + least(sec, {wait}) ELSE spent END AS spent, CASE WHEN goes THEN {said} ELSE said END AS said FROM y{i})")
        pause = 1.5 * 2**i
        steps.append(f"x{i + 1} AS (SELECT * EXCLUDE (base, goes), spent + {pause} AS base, goes AND said IN ('late', 'broken', 'busy') AND {TOTAL}::DOUBLE - spent > {pause} AS goes FROM z{i})")
    return ", ".join(steps)


KINDS = ["answered", "answered", "error", "tool_error", "unreadable", "answered", "answered"]
PAYLOADS = ["'plain words'", "replace(props, ' ', '')", "NULL", "NULL", "NULL", "'after a note'", "'{\"found\":' || replace(props, ' ', '') || '}'"]
KIND_SQL, PAYLOAD_SQL = (f"CASE event_id % {len(BODIES)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(x)) + " END" for x in ([f"'{k}'" for k in KINDS], PAYLOADS))


@query("tool_answers", f"WITH {fold_sql()} SELECT event_id, CASE WHEN said = 'answered' THEN {KIND_SQL} ELSE said END AS outcome, CASE WHEN said = 'answered' THEN {PAYLOAD_SQL} END AS payload, n AS tries, round(spent, 6) AS spent FROM x{TRIES}")
def tool_answers(spark, d):
    """What a client with limits on time and attempts gets out of the log; failures of any kind carry no payload."""
    done = R.answers(logged(spark, attempts(spark, d)), TOTAL, PER_TRY, TRIES)
    return done.select(F.col("key").cast("bigint").alias("event_id"), "outcome", "payload", "tries", "spent")


@query("tools_listed", "SELECT p_brand AS name, min(p_type) AS description, '{\"type\":\"object\"}' AS schema FROM part GROUP BY p_brand")
def tools_listed(spark, d):
    """A server's list of tools, one for each brand."""
    tools = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_type").alias("description"))
    tool = F.struct("name", "description", F.struct(F.lit("object").alias("type")).alias("inputSchema"))
    body = tools.agg(F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(tool)).alias("tools")).alias("result"))).alias("body"))  # a list of brands
    rows = body.select(F.lit("tools/list").alias("tool"), F.lit("").alias("key"), F.lit(0).alias("attempt"), F.lit(200).alias("status"), F.lit(0.5).alias("seconds"), "body")
    return R.tool_list(R.answers(logged(spark, rows)))


#: The services' names for what they find: one as the common names are, the others with their own.
SERVICES = {"guide": {}, "shelf": {"text": ["abstract", "text"], "locator": [("pmid", "PMID:")]}, "law": {"title": ["article", "title"], "locator": ["code"]}}


def searched(spark, d, k: int = 3):
    """Each conversation asks three services; its turns are what they find."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    n = F.col("turn").cast("string")
    forms = {
        "guide": F.struct(F.col("role").alias("title"), F.lit("").alias("text"), F.col("text").alias("content"), n.alias("page"), F.col("turn").alias("score")),
        "shelf": F.struct(F.col("role").alias("title"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("abstract"), F.lit("short").alias("text"), n.alias("pmid")),
        "law": F.struct(F.lit("").alias("article"), F.col("role").alias("title"), F.col("text").alias("snippet"), n.alias("code"), F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), "high").otherwise("0.5").alias("score")),
    }
    rows = None
    for name, (tool, item) in zip(("results", "items", "data"), forms.items()):
        own = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("x")))), lambda x: x["x"]).alias("xs"))  # a conversation's turns
        body = F.to_json(F.struct(F.array().cast("array<string>").alias("results" if name != "results" else "items"), F.col("xs").alias(name)))
        status = F.when((F.col("conv_id") + len(tool)) % 4 == 0, 500).otherwise(200)
        own = own.select(F.lit(tool).alias("tool"), F.col("conv_id").cast("string").alias("key"), F.lit(0).alias("attempt"), status.alias("status"), (F.col("conv_id") % 10).cast("double").alias("seconds"), body.alias("body"))
        rows = own if rows is None else rows.unionByName(own)
    return R.documents(R.answers(logged(spark, rows), total=8.0, retries=1, wrapped=False), SERVICES, k)


UP = "(conv_id + {}) % 4 <> 0 AND conv_id % 10 <= 8"
TURNS = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)"
FOUND = (
    f"SELECT 'guide' AS source, conv_id::VARCHAR AS query, place, role AS title, text, turn::VARCHAR AS locator, turn::DOUBLE AS score FROM {TURNS} WHERE {UP.format(5)} "
    f"UNION ALL SELECT 'shelf', conv_id::VARCHAR, place, role, CASE WHEN turn % 2 = 0 AND text <> '' THEN text ELSE 'short' END, 'PMID:' || turn, 0.0 FROM {TURNS} WHERE {UP.format(5)} "
    f"UNION ALL SELECT 'law', conv_id::VARCHAR, place, role, text, turn::VARCHAR, 0.5 FROM {TURNS} t WHERE {UP.format(3)} AND NOT (conv_id % 5 = 0 AND EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = t.conv_id AND c.turn = 1))"
)


@query("source_documents", f"SELECT source, query, place, title, md5(text) AS digest, locator, score FROM ({FOUND}) WHERE place <= 3")
def source_documents(spark, d):
    """Three documents of each service for each conversation; services that are down, late or answer nonsense give none."""
    return searched(spark, d).select("source", "query", F.col("place").cast("bigint").alias("place"), "title", F.md5("text").alias("digest"), "locator", "score")


@query("first_text", f"SELECT c.query, md5(coalesce(f.text, '')) AS digest FROM (SELECT DISTINCT conv_id::VARCHAR AS query FROM conversations) c LEFT JOIN ({FOUND}) f ON f.query = c.query AND f.source = 'shelf' AND f.place = 1")
def first_text(spark, d):
    """The text of one service's first document for each question, or none."""
    asked = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("query")).distinct()
    return R.top_text(asked, searched(spark, d, 1), "shelf").select("query", F.md5("text").alias("digest"))
