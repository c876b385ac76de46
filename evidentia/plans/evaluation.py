"""Queries that score runs, examples and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import linediff as D
from ..sources import files
from ..sources.providers import called
from ..sources.shared import new_path, stored
from .common import query, quoted, table

RUNS = "(SELECT user_id, event_type, event_id, value, floor(value * 10)::BIGINT AS latency, event_type = 'error' AS failed FROM events)"


def runs(spark, d):
    latency = F.floor(F.col("value") * 10)
    return table(spark, d, "events").select("user_id", "event_type", "event_id", "value", latency.alias("latency"), (F.col("event_type") == "error").alias("failed"))


@query("run_summary", f"SELECT user_id, count(*) AS n, count(*) FILTER (WHERE failed) AS errors, round(avg(value) FILTER (WHERE NOT failed), 4) AS mean, min(value) FILTER (WHERE NOT failed) AS worst, max(latency) AS longest, trunc(quantile_cont(latency::DOUBLE, 0.5))::BIGINT AS median FROM {RUNS} GROUP BY user_id")
def run_summary(spark, d):
    return V.run_summary(runs(spark, d), ["user_id"], "value", "latency", "failed")


@query(
    "bench_summary",
    "SELECT event_type, mean, median, worst, CASE WHEN n > 10 THEN round(x[f] + (p - f) * (x[f + 1] - x[f]), 6) END AS p10, n FROM (SELECT *, (n + 1) / 10.0::DOUBLE AS p, floor((n + 1) / 10.0::DOUBLE)::BIGINT AS f FROM "
    "(SELECT event_type, round(avg(value), 4) AS mean, quantile_cont(value, 0.5) AS median, min(value) AS worst, list_sort(list(value)) AS x, count(*) AS n FROM events GROUP BY event_type))",
)
def bench_summary(spark, d):
    return V.bench_summary(table(spark, d, "events").select("event_type", "value"), ["event_type"], "value")


CRITERIA = [("states a number that can be checked", 5, "text", "[0-9]", ["axis:facts", "level:row"]), ("is long enough to answer", 3, "text", "(?s).{400}", ["axis:form"]), ("shouts", -4, "text", "!!|%%%", ["axis:form", "theme:noise"]), ("is of the quality asked for", 7, "quality", None, ["theme:quality", "level:row"]), ("speaks of people", -2, "text", "@", ["theme:people"])]
VERDICTS = "(" + " UNION ALL ".join(f"SELECT doc_id, {i} AS pos, {quoted(c)} AS criterion, {p} AS points, {'quality = 1' if rx is None else f'regexp_matches(text, {quoted(rx)})'} AS met, {tags} AS tags FROM documents JOIN labels USING (doc_id)" for i, (c, p, _, rx, tags) in enumerate(CRITERIA)) + ")"


def verdicts(spark, d):
    """(doc_id, pos, criterion, points, met, tags): rule verdicts, as an offline stand-in for a judge."""
    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id")
    met = lambda rx: F.col("quality") == 1 if rx is None else F.col("text").rlike(rx)
    each = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("criterion"), F.lit(p).alias("points"), met(rx).alias("met"), F.array(*map(F.lit, tags)).alias("tags")) for i, (c, p, _, rx, tags) in enumerate(CRITERIA)]
    return rows.select("doc_id", F.inline(F.array(*each)))


@query("rubric_score", f"SELECT doc_id, round(coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, sum(CASE WHEN met THEN points ELSE 0 END)::DOUBLE / sum(points) FILTER (WHERE points > 0))), 0), 6) AS score FROM {VERDICTS} GROUP BY doc_id")
def rubric_score(spark, d):
    return V.rubric_scores(verdicts(spark, d), "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("tag_means", f"SELECT tag, round(avg(share), 4) AS mean, count(*) AS n FROM (SELECT doc_id, tag, round(avg(met::INT), 3) AS share FROM (SELECT doc_id, met, unnest(tags) AS tag FROM {VERDICTS}) GROUP BY doc_id, tag) WHERE starts_with(tag, 'axis:') OR starts_with(tag, 'theme:') GROUP BY tag")
def tag_means(spark, d):
    return V.tag_means(verdicts(spark, d), "doc_id", ["axis:", "theme:"])


@query("missed_topk", f"SELECT kind, left(criterion, 20) AS criterion, count(*) AS n FROM (SELECT *, CASE WHEN points > 0 AND NOT met THEN 'missed' WHEN points < 0 AND met THEN 'penalised' END AS kind FROM {VERDICTS}) WHERE kind IS NOT NULL GROUP BY ALL")
def missed_topk(spark, d):
    return V.missed_criteria(verdicts(spark, d), "doc_id", width=20)


RULES = [("loud", "!!|%%%"), ("number", "[0-9]{2,}"), ("the", " the "), ("table", " \\| "), ("never", "zzzz")]


@query("rule_eval", " UNION ALL ".join(f"SELECT '{n}' AS rule, round(count(*) FILTER (WHERE toxic = 1 AND h)::DOUBLE / nullif(count(*) FILTER (WHERE toxic = 1), 0), 6) AS recall, round(count(*) FILTER (WHERE toxic <> 1 AND h)::DOUBLE / nullif(count(*) FILTER (WHERE toxic <> 1), 0), 6) AS false_rate FROM (SELECT toxic, regexp_matches(text, {quoted(p)}) AS h FROM documents JOIN labels USING (doc_id))" for n, p in RULES))
def rule_eval(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id").withColumn("positive", F.col("toxic") == 1)
    return V.rule_eval(rows, "text", "positive", RULES)


@query("label_partition", f"SELECT doc_id, CASE WHEN bool_or(points > 0 AND contains(criterion, 'number') AND met) OR bool_or(list_contains(tags, 'theme:noise') AND met) THEN 'target' ELSE 'rest' END AS part FROM {VERDICTS} GROUP BY doc_id")
def label_partition(spark, d):
    """Examples whose positive criteria, or whose tags, speak of the target."""
    target = ((F.col("points") > 0) & F.contains("criterion", F.lit("number")) | F.array_contains("tags", "theme:noise")) & F.col("met")
    return verdicts(spark, d).groupBy("doc_id").agg(F.when(F.bool_or(target), "target").otherwise("rest").alias("part"))


@query("ngram_topk", "SELECT phrase, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+(?: [a-z]+){1,3}')) AS phrase FROM documents) WHERE length(phrase) BETWEEN 6 AND 40 GROUP BY phrase ORDER BY n DESC, phrase LIMIT 50")
def ngram_topk(spark, d):
    return V.top_phrases(table(spark, d, "documents"), "text", 50)


@query("probe_stats", "SELECT event_type, trunc(quantile_cont(size::DOUBLE, 0.5))::BIGINT AS median, max(size) AS largest, min(event_id) FILTER (WHERE size = top) AS at, count(*) FILTER (WHERE NOT regexp_matches(props, '[1-9]{2}')) AS without_id FROM (SELECT *, max(size) OVER (PARTITION BY event_type) AS top FROM (SELECT event_type, event_id, props, floor(value * 10)::BIGINT AS size FROM events)) GROUP BY event_type")
def probe_stats(spark, d):
    """Sizes of probed answers: the median, the largest and where, and how many hold no id."""
    rows = table(spark, d, "events").select("event_type", "event_id", "props", F.floor(F.col("value") * 10).alias("size"))
    top = F.max(F.struct("size", (-F.col("event_id")).alias("minus")))
    most = rows.groupBy("event_type").agg(top.alias("top"), F.count_if(~F.col("props").rlike("[1-9]{2}")).alias("without_id"))
    middle = V.medians(rows, ["event_type"], "size").withColumn("median", F.col("median").cast("bigint"))
    return most.join(middle, "event_type").select("event_type", "median", F.col("top.size").alias("largest"), (-F.col("top.minus")).alias("at"), "without_id")


@query("tool_cost", "SELECT event_type, count(*) AS n, sum(length(props))::BIGINT AS chars, trunc(sum(length(props)) * 0.3)::BIGINT AS tokens FROM events GROUP BY event_type")
def tool_cost(spark, d):
    """What definitions cost in tokens, by an estimate from their characters."""
    chars = F.sum(F.length("props"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), chars.alias("chars"), (chars * F.lit(0.3).cast("decimal(2,1)")).cast("bigint").alias("tokens"))


@query("synthetic_id", "SELECT event_id, 'cite-' || left(md5(event_type || props || left(coalesce(ts::DATE::VARCHAR, ''), 200)), 16) AS cite_id FROM events WHERE event_type <> 'view'")
def synthetic_id(spark, d):
    """An id for results that carry none, from the call and the start of its answer; exploratory calls get none."""
    made = F.concat(F.lit("cite-"), F.left(F.md5(F.concat("event_type", "props", F.left(F.coalesce(F.col("ts").cast("date").cast("string"), F.lit("")), F.lit(200)))), F.lit(16)))
    return table(spark, d, "events").where("event_type != 'view'").select("event_id", made.alias("cite_id"))


@query("trace_events", """SELECT event_id, '{"stage":"' || event_type || '","user":' || user_id || ',"ms":' || floor(value * 10)::BIGINT || '}' AS trace FROM events""")
def trace_events(spark, d):
    """One compact JSON object for each step, without any text of the user."""
    return runs(spark, d).select("event_id", F.to_json(F.struct(F.col("event_type").alias("stage"), F.col("user_id").alias("user"), F.col("latency").alias("ms"))).alias("trace"))


@query("run_diff", "WITH b AS (SELECT l_orderkey, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS status FROM lineitem GROUP BY l_orderkey) SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, o_orderstatus AS before, status AS after FROM orders FULL JOIN b ON o_orderkey = l_orderkey WHERE o_orderstatus IS DISTINCT FROM status")
def run_diff(spark, d):
    """Orders whose status in one run differs from what the lines of another say."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("a"), F.max("l_linestatus").alias("b"))
    after = lines.select("o_orderkey", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("P").alias("o_orderstatus"))
    return V.changed(table(spark, d, "orders"), after, "o_orderkey", "o_orderstatus")


#: A later run of the documents: lines with two digits on end are gone, and a last line is new.
LATER = "array_to_string(list_append(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '[0-9]{2}')), '-- ' || doc_id || ' of a later run'), chr(10))"


def later_run(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: ~x.rlike("[0-9]{2}"))
    own = F.array_join(F.concat(lines, F.array(F.concat(F.lit("-- "), F.col("doc_id").cast("string"), F.lit(" of a later run")))), "\n")
    return table(spark, d, "documents").where("doc_id % 3 != 1").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(own).alias("text"))


@query(
    "run_line_diff",
    f"SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN len(old) ELSE len(old) + 1 - len(new) END AS n_removed, CASE WHEN doc_id % 3 = 1 THEN 0 ELSE 1 END AS n_added, CASE WHEN doc_id % 3 = 2 THEN md5(array_to_string(new, chr(10))) END AS after FROM (SELECT doc_id, string_split(text, chr(10)) AS old, string_split({LATER}, chr(10)) AS new FROM documents) WHERE doc_id % 3 <> 0",
)
def run_line_diff(spark, d):
    """Two runs of the documents, line by line: some texts are gone, some have lost lines and won one. The patches, applied
    to the first run, give the second."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = stored(D.line_diffs(docs, later_run(spark, d), "doc_id", "text"), "diffs")
    after = D.patched(docs, "doc_id", "text", found).select(F.col("doc_id").alias("id"), F.md5("patched").alias("after"))
    return found.join(after, F.col("doc_id") == F.col("id")).select("doc_id", "n_removed", "n_added", "after")


#: A collection in two variants, each in a file of its own.
VARIANTS = {"full": "full.jsonl", "numbers": "with-numbers.jsonl"}


@query("benchmark_variants", "SELECT 'full' AS variant, item_id, md5(text) AS digest FROM benchmark UNION ALL SELECT 'numbers', item_id, md5(text) FROM benchmark WHERE regexp_matches(text, '[0-9]')")
def benchmark_variants(spark, d):
    """The benchmark's items as JSON lines in two named variants, read back by their names."""
    items, folder = table(spark, d, "benchmark").select("item_id", "text"), new_path(spark, "variants")
    for name, rows in (("full", items), ("numbers", items.where(F.col("text").rlike("[0-9]")))):
        rows.select(F.to_json(F.struct("item_id", "text", F.lit(name).alias("unread"))).alias("value")).write.text(f"{folder}/{VARIANTS[name]}")
    read = [files.variant_lines(spark, folder, v, VARIANTS, "item_id bigint, text string").select(F.lit(v).alias("variant"), "item_id", F.md5("text").alias("digest")) for v in VARIANTS]
    return read[0].unionByName(read[1])


def ends_well(text: str) -> bool:
    """An offline judge: whether a text ends with a full stop; it gives no verdict on what is too short to judge."""
    if len(text) < 40:
        raise ValueError("too short to judge")
    return text.rstrip().endswith(".")


@query("judge_verdicts", "SELECT conv_id, turn, CASE WHEN length(text) >= 40 THEN ends_with(rtrim(text), '.') END AS verdict, CASE WHEN length(text) >= 40 THEN ends_with(rtrim(text), '.') ELSE regexp_matches(text, '[0-9]') END AS accepted FROM conversations WHERE role = 'assistant'")
def judge_verdicts(spark, d):
    """Answers as a judge sees them; where it fails there is no verdict, and a rule stands in for it."""
    answers = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    done = called(answers, "text", ends_well, "verdict", "boolean")
    return done.select("conv_id", "turn", "verdict", F.coalesce("verdict", F.col("text").rlike("[0-9]")).alias("accepted"))
