"""Queries of the text functions over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .common import query, quoted, table

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def token_sql(pattern: str, particles: list[str], stop: list[str]) -> str:
    ending = quoted(f"^(.{{2,}}?)({'|'.join(particles)})$")
    words = f"list_transform(regexp_extract_all(text, {quoted(pattern)}), lambda w: CASE WHEN regexp_matches(w, '[가-힣]') THEN regexp_replace(w, {ending}, '\\1') ELSE lower(w) END)"
    if stop:
        words = f"list_filter({words}, lambda w: NOT list_contains([{', '.join(map(quoted, stop))}], w))"
    return f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_sort(list_distinct({words})) AS t FROM documents)"


@query("tokens_scoring", token_sql(X.TOKEN_SCORING, X.PARTICLES, []))
def tokens_scoring(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("tokens_review", token_sql(X.TOKEN_REVIEW, X.PARTICLES_REVIEW, X.STOPWORDS))
def tokens_review(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.review_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


DENSITY = f"(len(regexp_extract_all({{0}}, {quoted('(?i)' + X.MEASURE)})) + 0.7::DOUBLE * len(regexp_extract_all({{0}}, {quoted('(?i)' + X.COMPARE)})))"
DENSITY = f"CASE WHEN {DENSITY} <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, {DENSITY} / greatest(1.0::DOUBLE, length({{0}}) / 500.0::DOUBLE) / 4.0::DOUBLE) END"


@query("fact_density", f"SELECT doc_id, round({DENSITY.format('text')}, 6) AS density FROM documents")
def fact_density(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(X.fact_density("text"), 6).alias("density"))


@query("normalize_key", f"SELECT p_partkey, regexp_replace(translate(lower(trim(p_name)), ' ·', ''), '({X.DOSAGE_FORMS})$', '') AS k FROM part")
def normalize_key(spark, d):
    return table(spark, d, "part").select("p_partkey", X.normal_key("p_name").alias("k"))


@query(
    "split_clean",
    "SELECT doc_id, len(p) AS n_parts, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(list_transform(string_split_regex(text, '[,/|;·]|\\s{2,}'), "
    f"lambda p: regexp_replace(regexp_replace(p, '\\([^)]*\\)', '', 'g'), {quoted('(?i)' + X.DOSES)}, '', 'g')), lambda p: regexp_replace(p, '^[ .\\-·]+|[ .\\-·]+$', '', 'g')), lambda p: length(p) BETWEEN 2 AND 40) AS p FROM documents)",
)
def split_clean(spark, d):
    p = table(spark, d, "documents").select("doc_id", X.split_clean("text").alias("p"))
    return p.select("doc_id", F.size("p").cast("bigint").alias("n_parts"), F.md5(F.array_join("p", "|")).alias("digest"))


@query(
    "to_keywords",
    f"SELECT item_id, CASE WHEN contains(t, ',') AND length(t) < 60 THEN t ELSE array_to_string(list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(t, {quoted(X.KEYWORD)})), lambda w: {{'n': -length(w), 'w': w}}))[1:3], lambda x: x.w), ', ') END AS keywords FROM (SELECT item_id, trim(text) AS t FROM benchmark)",
)
def to_keywords(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.keywords("text").alias("keywords"))


@query("sentence_like", f"SELECT item_id, trim(text) <> '' AND (regexp_matches(text, '[?？]') OR regexp_matches(text, '{X.INTERROGATIVE}') OR length(trim(text)) > 25) AS is_sentence FROM benchmark")
def sentence_like(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.is_sentence("text").alias("is_sentence"))


@query(
    "strip_blocks",
    f"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, {TRIM.format('''regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script>.*?</script>', '', 'g'), '(?is)<script>.*$', ''), '(?i)</?script>', '', 'g')''')} AS t FROM pages)",
)
def strip_blocks(spark, d):
    t = table(spark, d, "pages").select("page_id", X.without_blocks("html", "script").alias("t"))
    return t.select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


CUT = 600


def _last_sql(sign: str) -> str:
    turned = sign[::-1]
    return f"CASE WHEN instr(reverse(head), {turned}) > 0 THEN length(head) - instr(reverse(head), {turned}) - {len(sign) - 0} + 1 ELSE -1 END"


@query(
    "safe_truncate",
    f"SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, CASE WHEN length(text) <= {CUT} THEN text ELSE regexp_replace(CASE WHEN cut > {CUT // 2} THEN substr(head, 1, cut + 1) ELSE head END, '\\s+$', '') END AS t FROM "
    f"(SELECT doc_id, text, head, greatest(CASE WHEN instr(reverse(head), ' .') > 0 THEN length(head) - instr(reverse(head), ' .') - 1 ELSE -1 END, CASE WHEN instr(reverse(head), chr(10) || '.') > 0 THEN length(head) - instr(reverse(head), chr(10) || '.') - 1 ELSE -1 END) AS cut FROM (SELECT doc_id, text, left(text, {CUT}) AS head FROM documents)))",
)
def safe_truncate(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.safe_cut("text", CUT, (". ", ".\n")).alias("t"))
    return t.select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


@query(
    "exact_dedupe",
    "SELECT doc_id, fp FROM (SELECT doc_id, fp, row_number() OVER (PARTITION BY fp ORDER BY doc_id) AS n FROM (SELECT doc_id, CASE WHEN b = '' THEN '' ELSE sha1(b) END AS fp FROM (SELECT doc_id, regexp_replace(text, '[^\\p{L}\\p{N}_]+', '', 'g') AS b FROM documents))) WHERE n = 1 OR fp = ''",
)
def exact_dedupe(spark, d):
    """The first document of each fingerprint; texts without one are never duplicates. Ids alone are compared: a
    partially aggregated minimum needs no window over a fingerprint's documents."""
    fp = table(spark, d, "documents").select("doc_id", X.fingerprint("text").alias("fp"))
    return fp.where("fp != ''").groupBy("fp").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "fp").unionByName(fp.where("fp = ''"))


@query(
    "paragraphs",
    "WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS a FROM documents), "
    "q AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM p), g AS (SELECT doc_id, x, i, sum(CASE WHEN i = 1 OR length(x) >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM q) "
    "SELECT doc_id, n AS place, md5(string_agg(x, chr(10) ORDER BY i)) AS digest FROM g GROUP BY doc_id, n",
)
def paragraphs(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.posexplode(X.paragraphs("text", r"\n")).alias("i", "p"))
    return p.select("doc_id", (F.col("i") + 1).cast("decimal(38,0)").alias("place"), F.md5("p").alias("digest"))


def chunk_sql(size: int) -> str:
    """d(doc_id, text): (doc_id, cs), a text's chunks as a fold over its lines."""
    start = "{'out': []::VARCHAR[], 'open': '', 'used': 0::BIGINT}"
    flush = f"s.used > 0 AND s.used + length(x.open) > {size}"
    step = f"{{'out': CASE WHEN {flush} THEN list_append(s.out, s.open) ELSE s.out END, 'open': CASE WHEN {flush} OR s.used = 0 THEN x.open ELSE s.open || chr(10) || chr(10) || x.open END, 'used': CASE WHEN {flush} THEN 0 ELSE s.used END + length(x.open) + 2}}"
    strip = "regexp_replace(regexp_replace(@, '^\\s+', ''), '\\s+$', '')"
    parts = f"list_filter(list_transform(string_split(t, chr(10)), lambda p: {strip.replace('@', 'p')}), lambda p: p <> '')"
    fold = f"list_reduce(list_prepend({start}, list_transform({parts}, lambda p: {{'out': []::VARCHAR[], 'open': p, 'used': 0::BIGINT}})), lambda s, x: {step})"
    return f"SELECT doc_id, CASE WHEN t = '' THEN []::VARCHAR[] WHEN length(t) <= {size} THEN [t] ELSE list_filter(list_append(f.out, CASE WHEN f.used > 0 THEN f.open ELSE '' END), lambda c: c <> '') END AS cs FROM (SELECT doc_id, t, {fold} AS f FROM (SELECT doc_id, {strip.replace('@', 'text')} AS t FROM d))"


@query("chunk_greedy", f"WITH d AS (SELECT doc_id, text FROM documents), c AS ({chunk_sql(2000)}) SELECT doc_id, generate_subscripts(cs, 1) AS place, length(unnest(cs)) AS n_chars, md5(unnest(cs)) AS digest FROM c")
def chunk_greedy(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode(X.chunks("text", 2000, "\n")).alias("i", "c"))
    return c.select("doc_id", (F.col("i") + 1).cast("bigint").alias("place"), F.length("c").cast("bigint").alias("n_chars"), F.md5("c").alias("digest"))


@query(
    "script_language",
    "SELECT doc_id, CASE WHEN regexp_matches(text, '[가-힣]') THEN 'ko' WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 'zh' WHEN regexp_matches(text, '[\\x{3040}-\\x{30FF}]') THEN 'ja' WHEN regexp_matches(text, '[\\x{0400}-\\x{04FF}]') THEN 'ru' WHEN regexp_matches(text, '[\\x{0600}-\\x{06FF}]') THEN 'ar' ELSE 'en' END AS script FROM documents",
)
def script_language(spark, d):
    return table(spark, d, "documents").select("doc_id", X.language("text").alias("script"))


@query("cite_uids", "SELECT page_id, array_to_string(list_distinct_ordered, ' ') AS ids FROM (SELECT page_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS list_distinct_ordered FROM (SELECT page_id, regexp_extract_all(url || ' ' || html, '[0-9]{3,8}') AS a FROM pages))")
def cite_uids(spark, d):
    """The pattern of ids is a parameter: these pages hold numbers."""
    ids = X.cite_ids(F.concat_ws(" ", "url", "html"), "[0-9]{3,8}")
    return table(spark, d, "pages").select("page_id", F.array_join(ids, " ").alias("ids"))


@query("dose_parse", "SELECT doc_id, nullif(regexp_extract(text, '[0-9]+(?:[.,][0-9]+)?'), '') AS amount, nullif(regexp_extract(text, '[0-9]+ [a-z]+'), '') AS amount_unit, regexp_matches(text, '(?i)half|split') AS wants_split FROM documents")
def dose_parse(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.first_match("text", "[0-9]+(?:[.,][0-9]+)?").alias("amount"), X.first_match("text", "[0-9]+ [a-z]+").alias("amount_unit"), F.col("text").rlike("(?i)half|split").alias("wants_split")
    )


@query("md5_score", "SELECT doc_id, item_id, round(0.5::DOUBLE + 0.5::DOUBLE * (('0x' || substr(md5(b.text || d.source), 1, 4))::BIGINT / 65535::DOUBLE) - 0.05::DOUBLE * (doc_id % 5), 4) AS score FROM documents d JOIN benchmark b ON b.item_id = doc_id % (SELECT count(*) FROM benchmark)")
def md5_score(spark, d):
    """A deterministic score of a query and a title, as an offline stand-in for a search service."""
    items = table(spark, d, "benchmark")
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % max(1, items.count())).alias("item_id"))
    share = F.conv(F.substring(F.md5(F.concat("text", "source")), 1, 4), 16, 10).cast("double") / 65535
    return docs.join(items, "item_id").select("doc_id", "item_id", F.round(0.5 + 0.5 * share - 0.05 * (F.col("doc_id") % 5), 4).alias("score"))


SENTENCES = "[^.\\n]*[.\\n]|[^.\\n]+"


@query("sentence_drop", f"SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, coalesce(array_to_string(list_filter(regexp_extract_all(text, '{SENTENCES}'), lambda x: NOT regexp_matches(x, 'the |para |der |pour ')), ''), '') AS t FROM documents)")
def sentence_drop(spark, d):
    """A text without the sentences that match a list of words."""
    kept = F.filter(F.regexp_extract_all("text", F.lit(SENTENCES), F.lit(0)), lambda x: ~x.rlike("the |para |der |pour "))
    t = table(spark, d, "documents").select("doc_id", F.array_join(kept, "").alias("t"))
    return t.select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


@query("alias_coalesce", "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)', 1)), ''), nullif(trim(url), ''), 'page ' || page_id) AS label FROM pages")
def alias_coalesce(spark, d):
    """The first of several columns that is not blank."""
    from ..operators.overlay import first_filled

    named = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), "url", F.concat(F.lit("page "), "page_id").alias("number"))
    return named.select("page_id", first_filled(named, ["heading", "title", "url", "number"]).alias("label"))


@query("entity_regex", "SELECT doc_id, nullif(regexp_extract(text, '([A-Za-z]{3,20}) of the', 1), '') AS owned, CASE WHEN len(h) > 0 THEN regexp_extract(h[-1], '([A-Za-z]{3,20}),', 1) END AS topic FROM (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]{3,20}, ') AS h FROM documents)")
def entity_regex(spark, d):
    """A named thing by an owning phrase (its first place), and by the phrase before a comma (its last place)."""
    h = X.find_all("text", "[A-Za-z]{3,20}, ")
    owned = F.nullif(F.regexp_extract("text", "([A-Za-z]{3,20}) of the", 1), F.lit(""))
    return table(spark, d, "documents").select("doc_id", owned.alias("owned"), F.regexp_extract(F.try_element_at(h, F.lit(-1)), "([A-Za-z]{3,20}),", 1).alias("topic"))
