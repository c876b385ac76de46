"""Queries over calls: a log of events stands for the calls of requests (user: request, type: tool)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evidence as E
from ..operators import planner as P
from ..operators.digest import digested, refined
from ..sources.providers import TableSource, TableTools
from ..sources.shared import new_path
from ..streaming.session import session_stream
from .common import query, quoted, table
from .conversation import PACK, SESSION, history_digest
from .text import chunk_sql

SPEC = [("user", "fr", "phrase"), ("assistant", None, "keywords"), ("judge", "en", "ingredient")]
LANG = "CASE WHEN contains({}, 'é') THEN 'fr' ELSE 'en' END"
SPEC_SQL = "(VALUES ('user', 'fr', 'phrase'), ('assistant', NULL, 'keywords')) AS s(tool, lang, form)"
SENTENCE = f"(@ <> '' AND (regexp_matches(@, '[?？]') OR regexp_matches(@, '{X.INTERROGATIVE}') OR length(@) > 25))".replace("@", "trim(picked)")
KEYWORDS = f"CASE WHEN contains(@, ',') AND length(@) < 60 THEN @ ELSE array_to_string(list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(@, {quoted(X.KEYWORD)})), lambda w: {{'n': -length(w), 'w': w}}))[1:3], lambda x: x.w), ', ') END".replace("@", "trim(picked)")


@query(
    "normalize_args",
    f"WITH c AS (SELECT conv_id, turn, role, trim(CASE WHEN turn % 3 = 2 THEN '' ELSE text END) AS value, CASE WHEN turn % 2 = 1 THEN 'en' END AS corpus FROM conversations), "
    f"p AS (SELECT conv_id, turn, text, {LANG.format('text')} AS lang FROM conversations WHERE trim(text) <> ''), o AS (SELECT conv_id, lang, arg_min(text, turn) AS own FROM p GROUP BY ALL), a AS (SELECT conv_id, arg_min(text, turn) AS anyl FROM p GROUP BY ALL), "
    f"j AS (SELECT c.conv_id, c.turn, s.form, s.tool IS NOT NULL AS known, coalesce(s.lang, c.corpus) AS lang, c.value FROM c LEFT JOIN {SPEC_SQL} ON s.tool = c.role), "
    f"k AS (SELECT j.*, CASE WHEN NOT known THEN value WHEN value = '' OR coalesce(({LANG.format('value')}) <> j.lang, false) THEN CASE WHEN j.lang IS NULL THEN anyl ELSE own END ELSE value END AS picked FROM j LEFT JOIN o ON o.conv_id = j.conv_id AND o.lang = j.lang LEFT JOIN a ON a.conv_id = j.conv_id) "
    f"SELECT conv_id, turn, md5(CASE WHEN form = 'keywords' AND {SENTENCE} THEN {KEYWORDS} ELSE picked END) AS digest, CASE WHEN picked IS NULL THEN 'no text in ' || coalesce(lang, 'any') END AS skip FROM k",
)
def normalize_args(spark, d):
    """Each turn is a call of the tool that its role names; a conversation's texts are the pool of replacements."""
    turns = table(spark, d, "conversations")
    of = lambda c: F.when(F.contains(c, F.lit("é")), "fr").otherwise("en")
    calls = turns.select(F.col("conv_id").alias("request"), "turn", F.col("role").alias("tool"), F.when(F.col("turn") % 3 == 2, "").otherwise(F.col("text")).alias("value"), F.when(F.col("turn") % 2 == 1, "en").alias("corpus"))
    forms = F.explode(F.array(*map(F.lit, ("phrase", "keywords", "ingredient"))))
    pools = turns.select(F.col("conv_id").alias("request"), forms.alias("form"), of(F.col("text")).alias("lang"), F.col("turn").alias("pos"), "text")
    done = P.normal_arguments(calls, spark.createDataFrame(SPEC, "tool string, lang string, form string"), pools, of(F.trim("value")))
    return done.select(F.col("request").alias("conv_id"), "turn", F.md5("query").alias("digest"), "skip")


@query("call_dedupe", "SELECT user_id, event_type, regexp_extract(props, '[0-9]+') AS k, min(event_id) AS event_id FROM events GROUP BY ALL")
def call_dedupe(spark, d):
    """The first call of each key in a request."""
    calls = table(spark, d, "events").withColumn("key", P.call_key(F.col("event_type"), F.from_json("props", "map<string,string>")))
    first = P.first_calls(calls.select("user_id", "key", "event_type", "props", "event_id"), ["user_id", "key"], "event_id")
    return first.select("user_id", "event_type", F.regexp_extract("props", "[0-9]+", 0).alias("k"), "event_id")


@query(
    "barren_tools",
    "WITH i AS (SELECT *, sum(CASE WHEN value > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events), r AS (SELECT *, sum(CASE WHEN value > 40 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type, g ORDER BY event_id) AS run FROM i) "
    "SELECT user_id, event_type, event_id, run::BIGINT AS run, coalesce(max(run >= 2) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS closed FROM r",
)
def barren_tools(spark, d):
    calls = table(spark, d, "events").select("user_id", "event_type", "event_id", (F.col("value") > 40).alias("fruitful"))
    return P.barren(calls, "user_id", "event_type", "event_id", "fruitful").drop("fruitful")


@query(
    "call_planner",
    "WITH e AS (SELECT user_id, event_id, event_type <> 'signup' AS valid, event_type || '|' || props AS key, floor(value / 10)::BIGINT AS s FROM events), f AS (SELECT *, CASE WHEN valid THEN row_number() OVER (PARTITION BY user_id, key, valid ORDER BY event_id) END AS k FROM e), "
    "g AS (SELECT *, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER w AS n, sum(CASE WHEN k = 1 THEN s ELSE 0 END) OVER w AS t FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), h AS (SELECT user_id, event_id, valid, k, (n - CASE WHEN k = 1 THEN 1 ELSE 0 END)::BIGINT AS n_before, (t - CASE WHEN k = 1 THEN s ELSE 0 END)::BIGINT AS spent_before FROM g) "
    "SELECT user_id, event_id, CASE WHEN NOT valid THEN 'contract' WHEN k > 1 THEN 'repeat' WHEN n_before >= 6 THEN 'over calls' WHEN spent_before >= 30 THEN 'over time' ELSE 'fine' END AS kind, n_before, spent_before FROM h",
)
def call_planner(spark, d):
    """Which calls of a log broke the contract, asked again, or came after a budget of calls or time was used up."""
    events = table(spark, d, "events")
    log = events.select("user_id", "event_id", F.concat_ws("|", "event_type", "props").alias("key"), (F.col("event_type") != "signup").alias("valid"), F.floor(F.col("value") / 10).alias("seconds"))
    return P.over_budget(log, "user_id", "event_id", "key", "valid", "seconds", 6, 30)


@query("tool_cap", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 8.0::DOUBLE ELSE 18.0::DOUBLE END AS seconds FROM events")
def tool_cap(spark, d):
    return table(spark, d, "events").select("event_id", P.tool_cap(F.col("event_type"), ["click", "view"]).alias("seconds"))


@query(
    "ttl_cache",
    "WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts::TIMESTAMP) AS t, value > 40 AS ok FROM events) SELECT event_id, t - p AS since, coalesce(t - p < 86400000000, false) AS repeat FROM (SELECT *, max(CASE WHEN ok THEN t END) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e)",
)
def ttl_cache(spark, d):
    """Which calls came within a day of a good one by the same user with the same tool."""
    calls = table(spark, d, "events").select(F.concat_ws("|", "user_id", "event_type").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", (F.col("value") > 40).alias("ok"))
    return P.repeats(calls, "key", "at", "event_id", "ok", 86_400_000_000).select("event_id", "since", "repeat")


@query("hop_budget", "SELECT event_id, CASE WHEN event_type = 'error' THEN 2 ELSE greatest(3, (user_id % 5)::INT) END AS hops FROM events")
def hop_budget(spark, d):
    urgent = F.col("event_type") == "error"
    return table(spark, d, "events").select("event_id", P.hop_budget(F.when(urgent, 2).otherwise(3), (F.col("user_id") % 5).cast("int"), urgent).alias("hops"))


@query(
    "deadline_math",
    "SELECT event_id, CASE WHEN r IS NOT NULL THEN round(greatest(2.0::DOUBLE, least(18.0::DOUBLE, r - 10.0::DOUBLE)), 6) END AS cap, CASE WHEN r IS NOT NULL THEN round(greatest(5.0::DOUBLE, least(30.0::DOUBLE, r)), 6) END AS timeout FROM (SELECT event_id, CASE WHEN event_type <> 'signup' THEN 40.0::DOUBLE - value / 5.0::DOUBLE END AS r FROM events)",
)
def deadline_math(spark, d):
    left = F.when(F.col("event_type") != "signup", 40.0 - F.col("value") / 5.0)
    cap, wait = P.call_cap(left, F.lit(18.0), F.lit(2.0), F.lit(10.0)), P.answer_timeout(left, F.lit(30.0), F.lit(5.0))
    return table(spark, d, "events").select("event_id", F.round(cap, 6).alias("cap"), F.round(wait, 6).alias("timeout"))


@query("digest_gate", "SELECT doc_id, CASE WHEN lang = 'es' THEN 'mode' WHEN n_chars < 300 THEN 'small' WHEN n_chars < 1200 THEN 'fits' WHEN n_chars % 3 = 0 THEN 'whole' WHEN n_chars % 7 < 2 THEN 'late' END AS reason FROM documents")
def digest_gate(spark, d):
    n = F.col("n_chars")
    reason = P.digest_gate(F.when(F.col("lang") == "es", "off").otherwise("map"), n, F.lit(600), n % 3, (n % 7).cast("double"), 300, 2.0)
    return table(spark, d, "documents").select("doc_id", reason.alias("reason"))


#: Sizes of the digest: of a chunk, of what the offline provider takes for short, of a note, of all; notes met at a time.
CHUNK, SHORT, NOTE, BUDGET, FAN = 600, 60, 150, 400, 3


def start_of(text: str) -> str | None:
    """An offline provider: the start of a text; it fails for short ones, and finds nothing in what begins with a digit."""
    return None if len(text) < SHORT else "NONE" if text[0].isdigit() else text[:NOTE].strip(" ")


START = f"CASE WHEN length(@) < {SHORT} THEN @ WHEN regexp_matches(@, '^[0-9]') THEN '' ELSE trim(left(@, {NOTE}), ' ') END"


@query(
    "digest_map",
    f"WITH RECURSIVE d AS (SELECT doc_id, text FROM documents), c AS MATERIALIZED ({chunk_sql(CHUNK)}), "
    f"t(doc_id, level, notes, calls) AS (SELECT doc_id, 0, list_transform(cs, lambda x: {START.replace('@', 'x')}), 0::BIGINT FROM c UNION ALL "
    f"SELECT doc_id, level + 1, list_transform(js, lambda x: CASE WHEN length(x) > {BUDGET} THEN {START.replace('@', 'x')} ELSE x END), calls + len(list_filter(js, lambda x: length(x) > {BUDGET})) FROM "
    f"(SELECT doc_id, level, calls, list_transform(range((len(notes) + {FAN - 1}) // {FAN}), lambda g: array_to_string(list_filter(notes[{FAN} * g + 1 : {FAN} * g + {FAN}], lambda n: n <> ''), chr(10))) AS js FROM t WHERE len(notes) > 1 OR level = 0) WHERE len(js) > 0) "
    "SELECT c.doc_id, len(cs) AS n_chunks, len(cs) AS n_called, coalesce(calls, 0) AS n_merged, md5(coalesce(notes[1], '')) AS digest FROM c LEFT JOIN (SELECT doc_id, arg_max(notes, level) AS notes, max(calls) AS calls FROM t GROUP BY doc_id) USING (doc_id)",
)
def digest_map(spark, d):
    """Whole documents as notes that meet in a tree until they are within a budget."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit("").alias("query"))
    done = digested(docs, "doc_id", "text", "query", start_of, BUDGET, CHUNK, None, FAN, SHORT, "\n")
    return done.select("doc_id", "n_chunks", "n_called", "n_merged", F.md5("text").alias("digest"))


def longer_start(note: str, chunk: str) -> str:
    return max(note, chunk[:NOTE].rstrip(), key=len)


@query(
    "digest_refine",
    f"WITH d AS (SELECT doc_id, text FROM documents), c AS ({chunk_sql(CHUNK)}), n AS (SELECT doc_id, cs, list_reduce(list_prepend('', list_transform(cs[1:16], lambda x: regexp_replace(left(x, {NOTE}), '\\s+$', ''))), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS note FROM c) "
    "SELECT doc_id, md5(note || CASE WHEN len(cs) > 16 THEN chr(10) || '[' || (len(cs) - 16) || ' unread]' ELSE '' END) AS digest FROM n",
)
def digest_refine(spark, d):
    """One note for a document, carried from chunk to chunk, here the longest start of one; what is not read is said."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit("").alias("query"))
    return refined(docs, "doc_id", "text", "query", longer_start, BUDGET, CHUNK, 16, "\n").select("doc_id", F.md5("text").alias("digest"))


TOKENS = f"list_distinct(list_transform(regexp_extract_all(text, {quoted(X.TOKEN_SCORING)}), lambda w: lower(w)))"


@query(
    "source_candidates",
    f"WITH q AS (SELECT query, unnest(t) AS w FROM (SELECT text AS query, {TOKENS} AS t FROM (SELECT DISTINCT text FROM benchmark))), p AS (SELECT page_id, unnest(t) AS w FROM (SELECT page_id, {TOKENS.replace('(text,', '(html,')} AS t FROM pages)), "
    "n AS (SELECT query, lpad(page_id::VARCHAR, 9, '0') AS title, count(*) AS n FROM q JOIN p USING (w) GROUP BY ALL) SELECT md5(query) AS query, place, title FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, title) AS place FROM n) WHERE place <= 3",
)
def source_candidates(spark, d):
    """Three pages for each question, from a table that stands for a search service."""
    pages = table(spark, d, "pages").select(F.lpad(F.col("page_id").cast("string"), 9, "0").alias("title"), F.col("html").alias("text"))
    found = TableSource(pages).candidates(table(spark, d, "benchmark").select(F.col("text").alias("query")), 3)
    return found.select(F.md5("query").alias("query"), "place", "title")


@query(
    "tool_replay",
    "WITH r AS (SELECT event_type, props, min(user_id::VARCHAR) AS payload FROM events WHERE value <= 60 GROUP BY ALL) SELECT e.event_id, r.payload FROM events e LEFT JOIN r USING (event_type, props)",
)
def tool_replay(spark, d):
    """Calls answered from a record of earlier ones; long ones are recorded as errors."""
    events = table(spark, d, "events")
    recorded = events.select(F.col("event_type").alias("tool"), F.col("props").alias("key"), F.col("user_id").cast("string").alias("payload"), (F.col("value") > 60).alias("is_error"))
    calls = events.select("event_id", F.col("event_type").alias("tool"), F.col("props").alias("key"))
    return TableTools(recorded).answers(calls).select("event_id", "payload")


@query("session_fold", SESSION.replace("{user}", "800").replace("{assistant}", "1200"))
def session_fold(spark, d):
    """The session facts from a stream of the turns, read to its end; of each conversation the last row counts."""
    path = new_path(spark, "session")
    schema = table(spark, d, "conversations").schema
    # A pattern, since a stream takes a single file by no other path; it fits a folder of parts as well.
    turns = spark.readStream.schema(schema).parquet(f"{d}/conversations.parque[t]")
    facts = session_stream(turns, **PACK, cuts=(800, 1200))
    running = facts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/facts").trigger(availableNow=True).start()
    running.awaitTermination()
    columns = [c for c in facts.columns if c not in ("conv_id", "seen")]
    last = spark.read.schema(facts.schema).parquet(f"{path}/facts").groupBy("conv_id").agg(F.max_by(F.struct(*columns), "seen").alias("x")).select("conv_id", "x.*")
    return last.select("conv_id", *[c for c in columns if c != "history"], history_digest())


WANTED = ["7", "none", "3", "12", "3x", "0"]


@query("offered_tools", "SELECT list_position(['7', 'none', '3', '12', '3x', '0'], item_id::VARCHAR)::BIGINT AS place, item_id::VARCHAR AS name, left(text, 100) AS description, '{\"type\": \"object\", \"properties\": {}}' AS schema FROM benchmark WHERE item_id::VARCHAR IN ('7', 'none', '3', '12', '3x', '0')")
def offered_tools(spark, d):
    """Items stand for tool definitions: those asked for, in the order of the request."""
    definitions = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.col("text").alias("description"), F.lit(None).cast("string").alias("schema"))
    return P.offered(definitions, WANTED, 100).withColumn("place", F.col("place").cast("bigint"))


@query("call_arguments", "SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE role END AS name, CASE WHEN turn % 4 < 2 THEN turn END AS n FROM conversations")
def call_arguments(spark, d):
    """Arguments as an object, as a string that holds one, as a broken string, and not at all."""
    args = F.to_json(F.struct(F.col("turn").alias("n")))
    whole = F.concat(F.lit('{"function": {"name": "'), "role", F.lit('", "arguments": '))
    call = F.when(F.col("turn") % 4 == 0, F.concat(whole, args, F.lit("}}"))).when(F.col("turn") % 4 == 1, F.concat(whole, F.to_json(F.array(args)).substr(F.lit(2), F.length(F.to_json(F.array(args))) - 2), F.lit("}}")))
    call = call.when(F.col("turn") % 4 == 2, F.concat(whole, F.lit('"{broken"}}'))).otherwise("{}")
    done = table(spark, d, "conversations").select("conv_id", "turn", E.call_arguments(call).alias("x"))
    return done.select("conv_id", "turn", "x.name", F.get_json_object("x.arguments", "$.n").cast("bigint").alias("n"))


@query("corpus_language", "SELECT doc_id, CASE WHEN source = 'src3' THEN 'en' WHEN lang IN ('de', 'fr') THEN lang WHEN source IN ('src1', 'src2') THEN 'es' ELSE 'any' END AS language FROM documents")
def corpus_language(spark, d):
    """Sources stand for tools and databases, languages for corpus tags."""
    args = F.to_json(F.struct(F.col("lang").alias("corpus_tag"), F.lit("unlisted").alias("collection_name"), F.col("source").alias("db_name")))
    found = P.corpus_language(F.col("source"), args, ["src3"], {"de": "de", "fr": "fr"}, {"k": "ko"}, {"src1": "es", "src2": "es"})
    return table(spark, d, "documents").select("doc_id", found.alias("language"))
