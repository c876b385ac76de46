"""Queries over semi-structured payloads, which are made from the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from .common import query, table

DIGESTS = "SELECT conv_id, turn, 'cite-' || conv_id || '-' || turn AS cite_uid, md5({}) AS digest FROM conversations"


def turns(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return t.withColumn("key", F.concat_ws("-", "conv_id", "turn")).withColumn("cite", F.concat(F.lit("cite-"), F.concat_ws("-", "conv_id", "turn")))


def harvest_of(rows, payload, **options):
    """(conv_id, turn, cite_uid, digest) from a payload column of turns."""
    found = E.harvested(rows.withColumn("payload", payload), "key", "payload", **options)
    ids = F.split("key", "-")
    return found.select(ids[0].cast("bigint").alias("conv_id"), ids[1].cast("bigint").alias("turn"), "cite_uid", F.md5("body").alias("digest"))


@query("harvest", f"{DIGESTS.format('text')} UNION ALL SELECT conv_id, turn, 'page-' || conv_id || '-' || turn, md5(role || chr(10) || text) FROM conversations")
def harvest(spark, d):
    """Each turn twice in a nested payload: once as a text beside a shorter copy, once as pages two levels down."""
    hit = F.struct(F.col("cite").alias("cite_uid"), F.col("role").alias("title"), F.col("text").alias("content"))
    copy = F.struct(F.col("cite").alias("cite_uid"), F.left("text", F.lit(3)).alias("snippet"))
    pages = F.array(*[F.struct(F.lit(i).alias("page"), F.col(c).alias("text")) for i, c in enumerate(("role", "text"), 1)])
    deep = F.struct(F.struct(F.concat(F.lit("page-"), F.col("key")).alias("cite_uid"), pages.alias("pages"), F.lit("unread").alias("content")).alias("inner"))
    payload = F.to_json(F.struct(F.struct(F.array(copy).alias("short"), F.array(hit).alias("full")).alias("results"), deep.alias("meta")))
    return harvest_of(turns(spark, d), payload)


@query("harvest_v2", DIGESTS.format("left(role || ' http://x/' || turn || chr(10) || '[p.1] ' || role || chr(10) || '[p.2] ' || text, 4000)"))
def harvest_v2(spark, d):
    """With page numbers and a head."""
    pages = F.array(*[F.struct(F.lit(i).alias("page"), F.col(c).alias("text")) for i, c in enumerate(("role", "text"), 1)])
    hit = F.struct(F.col("cite").alias("cite_uid"), F.col("role").alias("title"), F.concat(F.lit("http://x/"), "turn").alias("url"), pages.alias("pages"))
    return harvest_of(turns(spark, d), F.to_json(F.struct(F.array(hit).alias("data"))), how="v2")


@query("harvest_v3", DIGESTS.format("text"))
def harvest_v3(spark, d):
    """From JSON within a string of JSON; the first of an id counts."""
    hit = F.struct(F.col("cite").alias("cite_uid"), F.col("text").alias("text"))
    later = F.struct(F.col("cite").alias("cite_uid"), F.concat("text", F.lit(" and more")).alias("text"))
    payload = F.to_json(F.struct(F.to_json(F.struct(F.array(hit, later).alias("items"))).alias("content")))
    return harvest_of(turns(spark, d), payload, how="v3", first=True)


@query("render_fields", "SELECT p_partkey, 'p_name: ' || p_name || chr(10) || 'p_brand: ' || p_brand || chr(10) || 'p_size: ' || p_size AS fields FROM part")
def render_fields(spark, d):
    payload = F.to_json(F.struct(F.lit("x").alias("cite_uid"), "p_name", "p_brand", F.lit("").alias("note"), "p_size", F.repeat(F.lit("["), F.lit(601)).alias("deep")))
    return table(spark, d, "part").select("p_partkey", E.rendered_fields(payload, ["cite_uid", "url"]).alias("fields"))


PAYLOADS = {"error": '{"error": "Timeout"}', "view": "{ }", "signup": '{"items": [], "n": 0}'}


@query("usable_payload", "SELECT event_id, event_type NOT IN ('error', 'view', 'signup') AS usable FROM events")
def usable_payload(spark, d):
    payload = F.col("props")
    for kind, p in PAYLOADS.items():
        payload = F.when(F.col("event_type") == kind, p).otherwise(payload)
    return table(spark, d, "events").select("event_id", E.usable(payload, ["error", "timed out", "not found", "exception"]).alias("usable"))


@query("json_salvage", "SELECT event_id, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events WHERE event_type <> 'view'")
def json_salvage(spark, d):
    """JSON among words: alone, in a fence before a stray brace, before a second object, and none at all."""
    kind = F.col("event_type")
    text = F.when(kind == "click", F.concat(F.lit("Sure: "), "props")).when(kind == "error", F.concat(F.lit("```json\n"), "props", F.lit("\n``` then {")))
    text = text.when(kind == "view", F.lit("nothing {here")).otherwise(F.concat("props", F.lit(' and {"k": 1, "s": "}"}')))
    found = E.salvaged(table(spark, d, "events").select("event_id", text.alias("text")), "event_id", "text").where("json is not null")
    return found.select("event_id", F.variant_get(F.parse_json("json"), "$.k", "bigint").alias("k"))


@query("sse_parse", "SELECT event_id, regexp_extract(props, '[0-9]+')::BIGINT AS answer, event_id AS first_id FROM events")
def sse_parse(spark, d):
    """A notice, the result, and a closing block that is no JSON."""
    body = F.concat(F.lit('event: note\r\ndata: {"id": '), "event_id", F.lit('}\r\n\r\nevent: message\r\ndata: {"result": '), "props", F.lit("}\r\n\r\ndata: [DONE\r\n\r\n"))
    rows = table(spark, d, "events").select("event_id", E.sse_answer(body).alias("last"), E.sse_answer(body, "first").alias("first"))
    return rows.select("event_id", F.variant_get(F.parse_json("last"), "$.result.k", "bigint").alias("answer"), F.variant_get(F.parse_json("first"), "$.id", "bigint").alias("first_id"))
