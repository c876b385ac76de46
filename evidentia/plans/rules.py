"""Queries of the rule packs over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from .common import query, quoted, table



def hit(p: str) -> str:
    return f"regexp_matches(text, {quoted(p)})"


def any_sql(patterns: list[str]) -> str:
    return "(" + " OR ".join(map(hit, patterns)) + ")"


FIRST = [("spam", ["casino|!!", "%%%|\\*\\*\\*"]), ("table", [" \\| "]), ("number", ["[0-9]{2,}"]), ("english", [" with ", " the "])]


def first_sql(field: str) -> str:
    whens = []
    for c, ps in FIRST:
        for p in ps:
            value = {"category": quoted(c), "pattern": quoted(p), "matched": f"regexp_extract(text, {quoted(p)})"}[field]
            whens.append(f"WHEN {hit(p)} THEN {value}")
    return f"CASE {' '.join(whens)} END"


@query("redflag_first_match", f"SELECT * FROM (SELECT doc_id, {', '.join(f'{first_sql(f)} AS {f}' for f in ('category', 'pattern', 'matched'))} FROM documents) WHERE category IS NOT NULL")
def redflag_first_match(spark, d):
    found = table(spark, d, "documents").select("doc_id", R.first_match(F.col("text"), FIRST).alias("hit"))
    return found.where("hit is not null").select("doc_id", "hit.*")


SOLO, PAIRS = ["!!!", "URGENT"], [("%%%", "&&&"), ("[0-9]", "@"), (" the ", "\\$\\$\\$"), ("#", "\\*")]


@query("urgency_rules", f"SELECT doc_id, {any_sql(SOLO)} OR {' OR '.join(f'({hit(a)} AND {hit(b)})' for a, b in PAIRS)} AS urgent FROM documents")
def urgency_rules(spark, d):
    return table(spark, d, "documents").select("doc_id", R.urgent(F.col("text"), SOLO, PAIRS).alias("urgent"))


GATE = ["th[a-z]*wh", "ea the", "und der", "que el"]


@query(
    "emergency_gate",
    f"SELECT conv_id, turn, CASE WHEN NOT {any_sql(GATE)} THEN NULL WHEN regexp_matches(text, '[0-9]') THEN 'call' WHEN length(text) > 200 THEN 'see' ELSE 'watch' END AS response FROM (SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM conversations)",
)
def emergency_gate(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"\s+", " ").alias("text"))
    text = F.col("text")
    says = R.decided([(~R.any_of(text, GATE), None), (text.rlike("[0-9]"), "call"), (F.length(text) > 200, "see")], "watch")
    return t.select("conv_id", "turn", says.alias("response"))


DATES = ["[12][0-9]{3}", "[0-9]{1,2}[./-][0-9]{1,2}", "(?i)latest|today|current|now", "[0-9]+ ?(?:%|€|\\$)"]


@query("date_sensitive", f"SELECT doc_id, {any_sql(DATES)} AS date_sensitive FROM documents")
def date_sensitive(spark, d):
    return table(spark, d, "documents").select("doc_id", R.any_of(F.col("text"), DATES).alias("date_sensitive"))


EVIDENCE = ["(?i)source|study|evidence", "th[a-z]+tion", "[0-9]+ ?%"]


@query(
    "needs_evidence",
    f"SELECT conv_id, {any_sql(EVIDENCE)} AS needed FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') WHERE n <= 2 GROUP BY conv_id)",
)
def needs_evidence(spark, d):
    from ..operators.conversation import last_turns, transcript

    recent = transcript(last_turns(table(spark, d, "conversations").where("role = 'user'"), 2), "\n")
    return recent.select("conv_id", R.any_of(F.col("text"), EVIDENCE).alias("needed"))


EXPERT, LAY = ["tion[a-z]*", "ment", "keit", "ción"], [" he ", " de ", " is ", " el "]


@query(
    "persona_vote",
    f"SELECT conv_id, CASE WHEN e > l THEN 'professional' WHEN l > 0 THEN 'lay' ELSE 'unknown' END AS persona FROM (SELECT conv_id, {' + '.join(f'{hit(p)}::INT' for p in EXPERT)} AS e, {' + '.join(f'{hit(p)}::INT' for p in LAY)} AS l FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id))",
)
def persona_vote(spark, d):
    """Votes of patterns over a conversation's user turns; the answers' words do not count, and each pattern votes once."""
    text, said = F.col("text"), table(spark, d, "conversations").where("role = 'user'")
    once = lambda ps: sum((F.bool_or(text.rlike(p)).cast("int") for p in ps), F.lit(0))
    n = said.groupBy("conv_id").agg(once(EXPERT).alias("e"), once(LAY).alias("l"))
    return n.select("conv_id", F.when(F.col("e") > F.col("l"), "professional").when(F.col("l") > 0, "lay").otherwise("unknown").alias("persona"))


WORDS = {"animal": ["bird", "hor", "eat"], "number": ["one", "ein", "un "], "place": ["there", "ici", "aqu"], "time": ["ora", "hour", "heu"]}


@query("caution_screen", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(text, {quoted(w)})' for w in ws)} THEN '{k}' END" for k, ws in sorted(WORDS.items())) + "], lambda x: x IS NOT NULL), ',') AS kinds FROM documents")
def caution_screen(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(R.screened(F.col("text"), WORDS), ",").alias("kinds"))


@query(
    "needs_clarification",
    "SELECT conv_id, turn, CASE WHEN regexp_matches(text, ' no ') THEN '' WHEN regexp_matches(text, 'th[a-z]*') AND NOT (contains(text, 'thing') OR contains(text, 'there')) THEN 'which one?' ELSE '' END AS question FROM conversations WHERE role = 'user'",
)
def needs_clarification(spark, d):
    text, known = F.col("text"), ["thing", "there"]
    named = F.lit(False)
    for k in known:
        named = named | F.contains(text, F.lit(k))
    says = R.decided([(text.rlike(" no "), ""), (text.rlike("th[a-z]*") & ~named, "which one?")], "")
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", says.alias("question"))


LOOKUP = [("[0-9]{4}", "price"), ("@", "contact"), ("[A-Z]{4}", "label"), ("tion ", "index"), (" (?:the|der|la) ", "search")]


@query("lookup_rules", "SELECT doc_id, CASE " + " ".join(f"WHEN {hit(p)} THEN '{t}'" for p, t in LOOKUP) + " END AS tool FROM documents")
def lookup_rules(spark, d):
    """An ordered decision list from a text to the tool that looks it up, or none."""
    return table(spark, d, "documents").select("doc_id", R.decided([(F.col("text").rlike(p), t) for p, t in LOOKUP]).alias("tool"))


INTENT = [("!!", "complaint"), ("[0-9]", "lookup"), ("\\n", "document")]


@query("intent_stub", "SELECT doc_id, CASE " + " ".join(f"WHEN {hit(p)} THEN '{t}'" for p, t in INTENT) + " ELSE 'other' END AS intent, regexp_matches(text, '[0-9]') OR regexp_matches(text, '@') AS expects_data FROM documents")
def intent_stub(spark, d):
    intent = R.decided([(F.col("text").rlike(p), t) for p, t in INTENT], "other")
    return table(spark, d, "documents").select("doc_id", intent.alias("intent"), R.any_of(F.col("text"), ["[0-9]", "@"]).alias("expects_data"))


KINDS = [("startswith", "c", "law"), ("contains", "pur", "shop"), ("startswith", "s", "guide")]


@query("source_type_case", "SELECT event_id, CASE WHEN starts_with(event_type, 'c') THEN 'law' WHEN contains(event_type, 'pur') THEN 'shop' WHEN starts_with(event_type, 's') THEN 'guide' ELSE 'other' END AS source_type FROM events")
def source_type_case(spark, d):
    rules = [(getattr(F, how)(F.col("event_type"), F.lit(part)), says) for how, part, says in KINDS]
    return table(spark, d, "events").select("event_id", R.decided(rules, "other").alias("source_type"))


@query(
    "route_coerce",
    "SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'other' END AS kind, CASE WHEN user_id % 3 = 0 THEN 'high' WHEN user_id % 3 = 1 THEN 'low' ELSE 'normal' END AS urgency FROM events",
)
def route_coerce(spark, d):
    """Unknown enum values become the default, never an error."""
    raw = F.element_at(F.array(F.lit("high"), F.lit("low"), F.lit("??")), (F.col("user_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", R.coerced(F.col("event_type"), ["click", "view", "purchase"], "other").alias("kind"), R.coerced(raw, ["high", "normal", "low"], "normal").alias("urgency"))


@query(
    "route_build",
    "SELECT conv_id, turn, urgent, dated OR urgent AS dated, CASE WHEN urgent THEN false ELSE ask END AS ask_back, CASE WHEN dated THEN 'search,dates' ELSE 'search' END AS tools, greatest(1, CASE WHEN dated THEN 2 ELSE 0 END) AS min_hops FROM (SELECT conv_id, turn, length(text) > 300 AS urgent, regexp_matches(text, '[0-9]') AS dated, length(text) < 60 AS ask FROM conversations WHERE role = 'user')",
)
def route_build(spark, d):
    """Rules only raise what a model says: an urgent turn asks nothing back, a dated one gets a further tool and hop."""
    text = F.col("text")
    t = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", (F.length(text) > 300).alias("urgent"), text.rlike("[0-9]").alias("dated"), (F.length(text) < 60).alias("ask"))
    tools = F.when(F.col("dated"), F.array_append(F.array(F.lit("search")), F.lit("dates"))).otherwise(F.array(F.lit("search")))
    return t.select(
        "conv_id", "turn", "urgent", (F.col("dated") | F.col("urgent")).alias("dated"), F.when(F.col("urgent"), False).otherwise(F.col("ask")).alias("ask_back"),
        F.array_join(tools, ",").alias("tools"), F.greatest(F.lit(1), F.when(F.col("dated"), 2).otherwise(0)).alias("min_hops"),
    )


@query(
    "plan_coerce",
    "SELECT conv_id, turn, left(text, 400) AS goal, CASE WHEN f THEN left(text, 50) END AS follow_up, CASE WHEN f THEN left(text, 30) END AS follow_reason, regexp_matches(text, '[0-9]') AS expects_output, coalesce(nullif(q, ''), left(text, 120)) AS query FROM (SELECT conv_id, turn, text, length(text) > 100 AND contains(text, 'the') AS f, regexp_extract(text, '[0-9]+') AS q FROM conversations)",
)
def plan_coerce(spark, d):
    """Lengths are cut; a follow-up needs its reason and its question, else both go; an empty query is the text's start."""
    text = F.col("text")
    reason, question = F.when(F.length(text) > 100, F.left(text, F.lit(30))), F.when(F.contains(text, F.lit("the")), F.left(text, F.lit(50)))
    both = reason.isNotNull() & question.isNotNull()
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.left(text, F.lit(400)).alias("goal"), F.when(both, question).alias("follow_up"), F.when(both, reason).alias("follow_reason"),
        text.rlike("[0-9]").alias("expects_output"), F.coalesce(F.nullif(F.regexp_extract(text, "[0-9]+", 0), F.lit("")), F.left(text, F.lit(120))).alias("query"),
    )
