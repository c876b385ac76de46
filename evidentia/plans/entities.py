"""Queries of dictionaries, pairs and rules over documents, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normal_key
from ..operators import entities as E
from ..operators.automaton import names_in
from ..operators.overlay import overlay
from .common import query, quoted, table

BRIDGE = [("redwidget", 0, "iron"), ("redwidget", 1, "paint"), ("smallring", 0, "gold"), ("smallring", 2, "iron"), ("smallring", 1, "gold"), ("hotgear", 0, "steel"), ("oldbolt", 0, "rust"), ("oldbolt", 1, "iron")]
CODES = [("bluebolt", "steel"), ("smallanvil", "iron"), ("redwidget", "unused")]
BRIDGE_DDL, CODES_DDL = "k string, pos int, member string", "k string, member string"


def values(rows: list[tuple], names: str) -> str:
    cell = lambda x: quoted(x) if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


B, C = values(BRIDGE, "k, pos, member"), values(CODES, "k, member")


@query(
    "ingredient_expand",
    f"WITH m AS (SELECT DISTINCT k, member FROM {B}), e AS (SELECT * FROM m UNION ALL SELECT k, member FROM {C} WHERE k NOT IN (SELECT k FROM m)) SELECT p_partkey, e.member FROM part LEFT JOIN e ON replace(lower(p_name), ' ', '') = e.k",
)
def ingredient_expand(spark, d):
    names = table(spark, d, "part").select("p_partkey", "p_name")
    return E.expanded(names, "p_name", spark.createDataFrame(BRIDGE, BRIDGE_DDL), spark.createDataFrame(CODES, CODES_DDL)).select("p_partkey", "member")


@query("class_members", "SELECT p_brand, string_agg(p_type, ',' ORDER BY lead, p_type) AS members FROM (SELECT p_brand, p_type, min(p_partkey) AS lead FROM part GROUP BY p_brand, p_type) GROUP BY p_brand")
def class_members(spark, d):
    return E.members(table(spark, d, "part"), "p_brand", "p_type", "p_partkey").select("p_brand", F.array_join("members", ",").alias("members"))


CLASSES = [("ECONOMY", "cheap"), ("ECONOMY", "plain"), ("SMALL", "tiny")]


@query("class_expand", f"SELECT p_partkey, coalesce(v.member, p_type) AS member FROM part LEFT JOIN {values(CLASSES, 'p_type, member')} USING (p_type)")
def class_expand(spark, d):
    return E.class_expanded(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", spark.createDataFrame(CLASSES, "p_type string, member string")).select("p_partkey", "member")


BARE = "translate(lower(trim({})), ' ·', '')"
WORDS = "[A-Za-z]{6,}"
#: The dictionary: what parts are called, and the longer words of the benchmark's items.
NAMES = f"(SELECT DISTINCT {BARE.format('n')} AS name FROM (SELECT p_name AS n FROM part UNION ALL SELECT unnest(regexp_extract_all(text, '{WORDS}')) FROM benchmark))"


def dictionary(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("name"))
    return table(spark, d, "part").select(F.col("p_name").alias("name")).unionByName(words)


@query("dict_contains_join", f"SELECT doc_id, name, instr({BARE.format('text')}, name) - 1 AS start FROM documents JOIN {NAMES} ON contains({BARE.format('text')}, name)")
def dict_contains_join(spark, d):
    """The names of the dictionary that a text holds, each with its first place."""
    return names_in(table(spark, d, "documents"), "doc_id", "text", dictionary(spark, d), "name", keep="names")


@query(
    "dict_all_hits",
    f"WITH n AS MATERIALIZED {NAMES}, z AS (SELECT DISTINCT length(name) AS l FROM n), d AS (SELECT doc_id, {BARE.format('text')} AS t FROM documents), p AS (SELECT doc_id, t, unnest(range(length(t))) AS start FROM d) "
    "SELECT doc_id, name, count(*) AS n_hits, min(start) AS first, max(start) AS last, sum(start)::BIGINT AS places FROM (SELECT doc_id, start, substr(t, start + 1, l) AS name FROM p, z WHERE start + l <= length(t)) JOIN n USING (name) GROUP BY doc_id, name",
)
def dict_all_hits(spark, d):
    """How often and where each name stands in a text, inside longer names and over others too."""
    found = names_in(table(spark, d, "documents"), "doc_id", "text", dictionary(spark, d), "name")
    return found.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n_hits"), F.min("start").alias("first"), F.max("start").alias("last"), F.sum("start").alias("places"))


@query(
    "dict_longest_hits",
    f"WITH RECURSIVE n AS MATERIALIZED {NAMES}, z AS (SELECT DISTINCT length(name) AS l FROM n), d AS (SELECT item_id, {BARE.format('text')} AS t FROM benchmark), p AS (SELECT item_id, t, unnest(range(length(t))) AS start FROM d), "
    "h AS MATERIALIZED (SELECT item_id, start, max(l) AS l FROM (SELECT item_id, start, substr(t, start + 1, l) AS name, l FROM p, z WHERE start + l <= length(t)) JOIN n USING (name) GROUP BY item_id, start), "
    "r(item_id, start, until) AS (SELECT item_id, min(start), arg_min(start + l, start) FROM h GROUP BY item_id UNION ALL SELECT r.item_id, min(h.start), arg_min(h.start + h.l, h.start) FROM r JOIN h ON h.item_id = r.item_id AND h.start >= r.until GROUP BY r.item_id) "
    "SELECT item_id, start, substr(t, start + 1, until - start) AS name FROM r JOIN d USING (item_id)",
)
def dict_longest_hits(spark, d):
    """The names that a text is made of, from the left on the longest at each place, without overlap."""
    return names_in(table(spark, d, "benchmark"), "item_id", "text", dictionary(spark, d), "name", keep="longest")


PAIRS = [(a, b, "mix" if (a + b) % 2 else "clash", f"{a} with {b}") for a in range(0, 200, 7) for b in range(1, 200, 11) if a != b]


@query(
    "pair_interactions",
    f"WITH v AS (SELECT least(x, y) AS a, greatest(x, y) AS b, kind, reason FROM {values(PAIRS, 'x, y, kind, reason')}), l AS (SELECT DISTINCT l_orderkey, l_partkey % 200 AS k FROM lineitem) "
    "SELECT p.l_orderkey, v.a::BIGINT AS a, v.b::BIGINT AS b, kind, reason FROM l p JOIN v ON p.k = v.a JOIN l q ON q.l_orderkey = p.l_orderkey AND q.k = v.b",
)
def pair_interactions(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 200).alias("code"))
    pairs = spark.createDataFrame(PAIRS, "a bigint, b bigint, kind string, reason string")
    return E.pairs_of(items, "l_orderkey", "code", pairs)


RULES = [("iron", "elderly", "heavy"), ("gold", "child", "small"), ("steel", "elderly", "sharp"), ("rust", "smoker", "dust"), ("paint", "child", "fumes")]
RISKS = "CASE WHEN c_acctbal < 500 THEN 'elderly' WHEN c_acctbal > 9000 THEN 'child' ELSE 'smoker' END"
ITEMS = f"SELECT o_custkey, b.member AS item, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN {B.replace(' AS v(', ' AS b(')} ON b.k = replace(lower(p_name), ' ', '') GROUP BY o_custkey, b.member"


def bought(spark, d):
    """(o_custkey, item, pos): what the parts that a customer ordered are made of, at its first place."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    made = E.expanded(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", spark.createDataFrame(BRIDGE, BRIDGE_DDL), spark.createDataFrame([], CODES_DDL)).dropna(subset=["member"])
    rows = lines.join(made, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("o_custkey", F.col("member").alias("item")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


def customer_risks(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.expr(RISKS).alias("risk_type"))


@query("risk_cross", f"SELECT i.o_custkey, i.item, v.risk_type, v.reason FROM ({ITEMS}) i JOIN {values(RULES, 'item, risk_type, reason')} ON v.item = i.item JOIN (SELECT c_custkey, {RISKS} AS risk_type FROM customer) r ON r.c_custkey = i.o_custkey AND r.risk_type = v.risk_type")
def risk_cross(spark, d):
    rules = spark.createDataFrame(RULES, "item string, risk_type string, reason string")
    return E.crossed(bought(spark, d), customer_risks(spark, d), rules, "o_custkey").select("o_custkey", "item", "risk_type", "reason")


CLASH = [("gold", "iron", "clash", 95), ("iron", "rust", "wear", 40), ("paint", "steel", "flake", 60), ("gold", "steel", "mark", 92)]


@query(
    "safety_gate",
    f"WITH i AS ({ITEMS}), p AS (SELECT x.o_custkey, v.kind, v.a || '+' || v.b AS what, v.severity, x.pos FROM {values(CLASH, 'a, b, kind, severity')} JOIN i x ON x.item = v.a JOIN i y ON y.item = v.b AND y.o_custkey = x.o_custkey), "
    f"r AS (SELECT i.o_custkey, 'risk' AS kind, i.item AS what, 50 AS severity, i.pos FROM i JOIN {values(RULES, 'item, risk_type, reason')} ON v.item = i.item JOIN (SELECT c_custkey, {RISKS} AS risk_type FROM customer) c ON c.c_custkey = i.o_custkey AND c.risk_type = v.risk_type), "
    "h AS (SELECT * FROM p UNION ALL SELECT * FROM r), u AS (SELECT o_custkey, kind, what, severity, row_number() OVER (PARTITION BY o_custkey, kind, what ORDER BY severity DESC, pos) AS n FROM h), "
    "s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, severity >= 90 ORDER BY severity DESC, what) AS k FROM u WHERE n = 1) SELECT o_custkey, kind, what, severity, CASE WHEN severity >= 90 THEN 'critical' ELSE 'notice' END AS part FROM s WHERE severity >= 90 OR k <= 2",
)
def safety_gate(spark, d):
    """Pair hits and risk hits of what a customer has ordered, once each, the critical ones and the first notices."""
    own = bought(spark, d)
    pairs = spark.createDataFrame(CLASH, "a string, b string, kind string, severity int")
    found = E.pairs_of(own, "o_custkey", "item", pairs.withColumn("reason", F.col("severity").cast("string")))
    found = found.join(own.select("o_custkey", F.col("item").alias("a"), "pos"), ["o_custkey", "a"])
    two = found.select("o_custkey", "kind", F.concat_ws("+", "a", "b").alias("what"), F.col("reason").cast("int").alias("severity"), "pos")
    rules = spark.createDataFrame(RULES, "item string, risk_type string, reason string")
    one = E.crossed(own, customer_risks(spark, d), rules, "o_custkey").select("o_custkey", F.lit("risk").alias("kind"), F.col("item").alias("what"), F.lit(50).alias("severity"), "pos")
    hits = E.hits_once(two.unionByName(one), "o_custkey", ["kind", "what"], "severity", "pos")
    return E.severe_first(hits, "o_custkey", "severity", "what").select("o_custkey", "kind", "what", "severity", "part")


@query("hit_dedupe", "SELECT user_id, event_type, severity, event_id FROM (SELECT user_id, event_type, (value * 100)::BIGINT % 100 AS severity, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (value * 100)::BIGINT % 100 DESC, event_id) AS n FROM events) WHERE n = 1")
def hit_dedupe(spark, d):
    hits = table(spark, d, "events").select("user_id", "event_type", (F.round(F.col("value") * 100).cast("bigint") % 100).alias("severity"), "event_id")
    return E.hits_once(hits, "user_id", ["event_type"], "severity", "event_id").select("user_id", "event_type", "severity", "event_id")


@query(
    "mention_verify",
    f"SELECT doc_id, k AS name, min(pos) AS pos FROM (SELECT doc_id, 0 AS pos, regexp_extract(text, '{WORDS}') AS name, regexp_extract(text, '{WORDS}') AS span, text FROM documents UNION ALL SELECT doc_id, 1, upper(regexp_extract(text, '{WORDS}')), 't h e', text FROM documents UNION ALL SELECT doc_id, 2, 'zzz', 'the', text FROM documents) "
    f"CROSS JOIN LATERAL (SELECT {BARE.format('name')} AS k) WHERE span <> '' AND (contains(text, span) OR contains({BARE.format('text')}, {BARE.format('span')})) AND k IN {NAMES} GROUP BY doc_id, k",
)
def mention_verify(spark, d):
    """Mentions that a rule and a model propose: kept if their span stands in the text and a dictionary has the name."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    word = F.regexp_extract("text", WORDS, 0)
    proposed = F.array(*[F.struct(F.lit(i).alias("pos"), n.alias("name"), s.alias("span")) for i, (n, s) in enumerate([(word, word), (F.upper(word), F.lit("t h e")), (F.lit("zzz"), F.lit("the"))])])
    mentions = docs.select("doc_id", F.inline(proposed))
    known = dictionary(spark, d).select(normal_key("name", r"(?!)").alias("k"))
    return E.verified(mentions, docs, "doc_id", known).select("doc_id", F.col("k").alias("name"), "pos")


@query("output_mentions", f"SELECT doc_id, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT doc_id, name FROM documents JOIN {NAMES} ON contains({BARE.format('text')}, name) UNION SELECT doc_id, lower(v.member) FROM documents JOIN {values(CLASSES, 'p_type, member')} ON contains(text, v.member)) GROUP BY doc_id")
def output_mentions(spark, d):
    """The sorted names and class members that a text speaks of."""
    docs = table(spark, d, "documents")
    held = F.filter(F.array(*[F.lit(m) for _, m in CLASSES]), lambda m: F.contains(F.col("text"), m))
    own = E.mentioned(docs, "doc_id", "text", dictionary(spark, d), "name").unionByName(docs.select("doc_id", F.explode(held).alias("name")))
    return own.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


RISK = {"noise": "!!|%%%", "money": "[0-9]+[.,][0-9]{2}", "contact": "[a-z]+@[a-z]+"}
AGE = "([0-9]{1,3})"


@query(
    "risk_extract",
    "SELECT doc_id, risk_type, matched FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS risk_type, regexp_extract(text, {quoted(p)}) AS matched FROM documents WHERE regexp_matches(text, {quoted(p)})" for k, p in RISK.items())
    + f" UNION ALL SELECT doc_id, CASE WHEN y >= 65 THEN 'elderly' WHEN y < 12 THEN 'pediatric' END, y::VARCHAR FROM (SELECT doc_id, TRY_CAST(regexp_extract(text, '{AGE}', 1) AS INT) AS y FROM documents)) WHERE risk_type IS NOT NULL",
)
def risk_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", F.inline(E.risks_in(F.col("text"), RISK, AGE)))


@query("risk_merge", "SELECT user_id, event_type, layer FROM (SELECT user_id, event_type, layer, row_number() OVER (PARTITION BY user_id, event_type ORDER BY layer) AS n FROM (SELECT DISTINCT user_id, event_type, CASE WHEN value < 20 THEN 0 ELSE 1 END AS layer FROM events)) WHERE n = 1")
def risk_merge(spark, d):
    """What earlier turns said stays; of the present ones, the kinds that are new."""
    events = table(spark, d, "events")
    past, now = (events.where(c).select("user_id", "event_type") for c in ("value < 20", "not value < 20"))
    return E.first_by_type([past, now], "user_id", "event_type")


@query("overlay_rules", "WITH s AS (SELECT p_brand, p_type, 'seed' AS reason, 1 AS layer FROM part WHERE p_size < 30), f AS (SELECT p_brand, p_type, 'file' AS reason, 0 AS layer FROM part WHERE p_size >= 48) SELECT DISTINCT p_brand, p_type, reason FROM (SELECT * FROM f UNION ALL SELECT * FROM s WHERE p_brand NOT IN (SELECT p_brand FROM f))")
def overlay_rules(spark, d):
    """A file's rules take the place of the seed's, brand by brand."""
    part = table(spark, d, "part")
    own, seed = (part.where(c).select("p_brand", "p_type", F.lit(r).alias("reason")).distinct() for c, r in (("p_size >= 48", "file"), ("p_size < 30", "seed")))
    return overlay([own, seed], ["p_brand"]).select("p_brand", "p_type", "reason")


CHECKS = [("dose", "[0-9]+ [a-z]+"), ("duration", "[0-9]+ (?:day|jour|Tag)"), ("split", "(?i)half|split")]


@query("single_checks", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, regexp_extract(text, {quoted(p)}) AS detail FROM documents WHERE regexp_matches(text, {quoted(p)})" for k, p in CHECKS) + " UNION ALL SELECT doc_id, 'age', regexp_extract(text, '[0-9]+') FROM documents WHERE TRY_CAST(regexp_extract(text, '[0-9]+') AS INT) >= 65")
def single_checks(spark, d):
    """Checks that a single named thing needs, by what its text says; each trigger stands alone."""
    text = F.col("text")
    hits = [F.when(text.rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract(text, p, 0).alias("detail"))) for k, p in CHECKS]
    number = F.regexp_extract(text, "[0-9]+", 0)
    hits.append(F.when(number.try_cast("int") >= 65, F.struct(F.lit("age").alias("kind"), number.alias("detail"))))
    return table(spark, d, "documents").select("doc_id", F.inline(F.array_compact(F.array(*hits))))
