"""Queries that check texts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import quality as Q
from .common import query, quoted, table
from .text import TRIM

SIGNS = Q.RULE_LINE
LINES = "SELECT {0}, regexp_replace(unnest(string_split({1}, chr(10))), '^\\s+|\\s+$', '', 'g') AS line FROM {2}"


@query("dup_lines", f"SELECT doc_id, max(n) AS most FROM (SELECT doc_id, line, count(*) AS n FROM ({LINES.format('doc_id', 'text', 'documents')}) WHERE length(line) > 12 AND NOT regexp_matches(line, '{SIGNS}') GROUP BY doc_id, line) GROUP BY doc_id HAVING max(n) >= 3")
def dup_lines(spark, d):
    return Q.repeated_lines(table(spark, d, "documents"), "doc_id", "text").where("most >= 3")


DEFLECT = " (?:there|you|pas|nicht)"
ANSWERS = "(SELECT conv_id, turn, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS asker, role FROM conversations)"
CITED = "list_transform(regexp_extract_all({0}, '\\[([0-9]{{1,2}})\\]', 1), lambda x: x::INT)"


def answers(spark, d):
    """(conv_id, turn, question, answer): assistant turns and the turn before."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("question", F.lag("text").over(own))
    return rows.where("role = 'assistant'").select("conv_id", "turn", "question", F.col("text").alias("answer"))


BODY = r"regexp_replace(answer, '^\s+|\s+$', '', 'g')"
BARE = f"regexp_replace({BODY}, {quoted(Q.TRAILING)}, '')"
RUN = f"len(list_filter(list_distinct(string_split({BODY}, '')), lambda c: NOT regexp_matches(c, '[-=*_~#\\s]') AND contains({BODY}, repeat(c, 20)))) > 0"
REPEATS = f"SELECT conv_id, turn, max(n) AS most FROM (SELECT conv_id, turn, line, count(*) AS n FROM ({LINES.format('conv_id, turn', 'answer', ANSWERS)} WHERE role = 'assistant') WHERE length(line) > 12 AND NOT regexp_matches(line, '{SIGNS}') GROUP BY ALL) GROUP BY ALL"
LEFT = f"length(regexp_replace({BODY}, '{DEFLECT}', '', 'g'))"


@query(
    "defect_flags",
    f"SELECT conv_id, turn, CASE WHEN {BODY} = '' THEN 'empty' ELSE concat_ws(',', CASE WHEN length({BODY}) < 40 THEN 'short' END, CASE WHEN NOT regexp_matches({BARE}, {quoted(Q.CLOSED)}) THEN 'open' END, CASE WHEN {RUN} THEN 'run' END, "
    f"CASE WHEN most >= 3 THEN 'repeat' END, CASE WHEN len(regexp_extract_all(coalesce(question, ''), 'é')) >= 3 AND len(regexp_extract_all({BODY}, 'é')) < greatest(5, length({BODY}) // 20) THEN 'script' END, "
    f"CASE WHEN len(list_filter({CITED.format(BODY)}, lambda n: n < 1 OR n > 3)) > 0 THEN 'citation' END, CASE WHEN regexp_matches({BODY}, '{DEFLECT}') AND length({BODY}) < 300 AND {LEFT} < 150 THEN 'deflect' END) END AS defects "
    f"FROM {ANSWERS} LEFT JOIN ({REPEATS}) USING (conv_id, turn) WHERE role = 'assistant'",
)
def defect_flags(spark, d):
    found = Q.defects(F.col("answer"), F.col("question"), F.lit(3), DEFLECT, script="é")
    return answers(spark, d).select("conv_id", "turn", F.array_join(found, ",").alias("defects"))


WORDS = f"list_distinct(list_filter(list_transform(regexp_extract_all(@, {quoted(X.TOKEN_REVIEW)}), lambda w: lower(w)), lambda w: NOT list_contains([{', '.join(map(quoted, X.STOPWORDS))}], w)))"

ASKED, SAID = WORDS.replace("@", "coalesce(question, '')"), WORDS.replace("@", "answer")


@query(
    "coverage_gaps",
    f"SELECT conv_id, turn, concat_ws(',', CASE WHEN len(q) > 0 AND len(list_intersect(q, a)) < 0.5 * len(q) THEN 'terms' END, CASE WHEN n >= 2 AND length(answer) < 250 * n THEN 'depth' END) AS gaps, len(list_filter(q, lambda w: NOT list_contains(a, w))) AS n_missing FROM "
    f"(SELECT conv_id, turn, answer, {ASKED} AS q, {SAID} AS a, len(regexp_extract_all(coalesce(question, ''), '[.]')) AS n FROM {ANSWERS} WHERE role = 'assistant')",
)
def coverage_gaps(spark, d):
    """These tables ask without question marks: a full stop ends a question here."""
    q, a = F.col("question"), F.col("answer")
    return answers(spark, d).select("conv_id", "turn", F.array_join(Q.gaps(q, a, "[.]"), ",").alias("gaps"), F.size(Q.missing_terms(q, a)).cast("bigint").alias("n_missing"))


@query("invented_citations", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter({CITED.format('t')}, lambda n: n < 1 OR n > 40))), ',') AS invented FROM (SELECT doc_id, regexp_replace(text, '([0-9]+)', '[\\1]', 'g') AS t FROM documents)")
def invented_citations(spark, d):
    """Every number is put into brackets first, since these texts cite nothing."""
    text = F.regexp_replace("text", "([0-9]+)", r"[$1]")
    return table(spark, d, "documents").select("doc_id", F.array_join(Q.invented(text, F.lit(40)), ",").alias("invented"))


CHECKS = [("contains_any", ["the", "les"]), ("contains_any_more", ["and", "der", "que"]), ("contains_all", ["a", "e"]), ("not_contains", ["!!", "%%%"]), ("not_match", "[0-9]{3}"), ("first_sentence_contains", ["e", "a"]), ("max_question_marks", 0), ("max_script_chars", 0), ("min_chars", 100), ("max_chars", 5000)]


def check_sql(kind: str, want) -> str:
    first = "regexp_extract(text, '(?s)^(.*?)(?:[.!?。]\\s|\\n|$)', 1)"
    any_of = lambda c: "(" + " OR ".join(f"contains({c}, {quoted(w)})" for w in want) + ")"
    return {
        "contains_any": lambda: any_of("text"), "contains_any_more": lambda: any_of("text"), "not_contains": lambda: f"NOT {any_of('text')}", "first_sentence_contains": lambda: any_of(first),
        "contains_all": lambda: "(" + " AND ".join(f"contains(text, {quoted(w)})" for w in want) + ")", "not_match": lambda: f"NOT regexp_matches(text, {quoted(want)})",
        "max_question_marks": lambda: f"len(regexp_extract_all(text, '[?？]')) <= {want}", "max_script_chars": lambda: f"len(regexp_extract_all(text, '[가-힣]')) <= {want}",
        "min_chars": lambda: f"length(text) >= {want}", "max_chars": lambda: f"length(text) <= {want}",
    }[kind]()


@query("probe_checks", "SELECT doc_id, failed = '' AS passed, failed FROM (SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({check_sql(k, w)}) THEN '{k}' END" for k, w in CHECKS) + ") AS failed FROM documents)")
def probe_checks(spark, d):
    return Q.probed(table(spark, d, "documents"), "doc_id", "text", CHECKS)


NEW = f"{TRIM.format('answer')}"
OLD = f"{TRIM.format('''coalesce(question, '')''')}"


@query(
    "review_decide",
    f"SELECT conv_id, turn, reason = 'revised' AS accepted, reason, length(CASE WHEN reason = 'revised' THEN new ELSE old END) AS n_chars FROM (SELECT conv_id, turn, {NEW} AS new, {OLD} AS old, CASE WHEN turn % 7 = 6 THEN 'unparsed' WHEN turn % 5 = 4 THEN 'cut' WHEN contains(answer, '!!') THEN 'kept' WHEN {NEW} = '' THEN 'empty' WHEN length({NEW}) < length({OLD}) // 2 THEN 'short' WHEN NOT regexp_matches({BARE}, {quoted(Q.CLOSED)}) OR length({BODY}) < 40 THEN 'defects' ELSE 'revised' END AS reason FROM {ANSWERS} WHERE role = 'assistant')",
)
def review_decide(spark, d):
    """The turn before stands for the draft and the answer for its revision; verdicts follow from the texts."""
    rows = answers(spark, d)
    text = F.col("answer")
    flaws = F.filter(Q.defects(text, F.lit(""), F.lit(999), "(?!)"), lambda x: x.isin("empty", "open", "short"))
    verdict = F.when(F.col("turn") % 7 == 6, None).when(F.contains("answer", F.lit("!!")), "pass").otherwise("revise")
    finish = F.when(F.col("turn") % 5 == 4, "length").otherwise("stop")
    done = Q.decision(F.coalesce("question", F.lit("")), text, verdict, finish, flaws, most=1 << 20)
    return rows.select("conv_id", "turn", done.alias("x")).select("conv_id", "turn", "x.accepted", "x.reason", F.length("x.text").cast("bigint").alias("n_chars"))


@query("critique_gate", "SELECT user_id, bool_or(event_type = 'error' OR value >= 300) AS rewrite FROM events GROUP BY user_id")
def critique_gate(spark, d):
    """Each event is an item of a critique; its value over its full scale is the confidence."""
    item = F.array(F.struct(F.col("event_type").alias("item"), (F.col("value") / 300.0).alias("confidence")))
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(Q.rewrites(item, ["error"], 1.0)).alias("rewrite"))


@query("critique_rounds", "SELECT user_id, event_type, n, n = 0 OR coalesce(n >= lag(n) OVER (PARTITION BY user_id ORDER BY event_type), false) AS stop FROM (SELECT user_id, event_type, count(*) FILTER (WHERE value > 60) AS n FROM events GROUP BY user_id, event_type)")
def critique_rounds(spark, d):
    """Rounds of a review stop where nothing is left or nothing got better."""
    rounds = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("value") > 60).alias("n"))
    return Q.converged(rounds, "user_id", "event_type", "n")
