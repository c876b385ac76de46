"""Queries that score and select documents' passages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import selection as S
from .common import query, quoted, table
from .text import DENSITY

def words_sql(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({text}, {quoted(X.TOKEN_SCORING)}), lambda w: lower(w)))"


PASSAGES = (
    "p AS (SELECT d.doc_id, b.text AS query, list_filter(list_transform(string_split(d.text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS a FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)), "
    "q AS (SELECT doc_id, query, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM p), g AS (SELECT doc_id, query, x, i, sum(CASE WHEN i = 1 OR length(x) >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM q), "
    f"r AS (SELECT doc_id, any_value(query) AS query, n - 1 AS pos, string_agg(x, chr(10) ORDER BY i) AS passage FROM g GROUP BY doc_id, n), t AS (SELECT *, {words_sql('passage')} AS ts, count(*) OVER (PARTITION BY doc_id) AS total FROM r), "
    f"qw AS (SELECT DISTINCT doc_id, unnest({words_sql('query')}) AS w FROM r), pw AS (SELECT doc_id, pos, unnest(ts) AS w FROM t), h AS (SELECT pw.* FROM pw JOIN qw USING (doc_id, w)), df AS (SELECT doc_id, w, count(*) AS c FROM h GROUP BY doc_id, w), "
    "lx AS (SELECT h.doc_id, h.pos, sum(ln(1 + t.total / (1 + df.c))) AS s FROM h JOIN df USING (doc_id, w) JOIN t ON t.doc_id = h.doc_id AND t.pos = h.pos GROUP BY h.doc_id, h.pos), "
    f"sc AS (SELECT t.doc_id, t.pos, t.passage, 0.6::DOUBLE * least(1.0::DOUBLE, coalesce(lx.s, 0) / greatest(1.0::DOUBLE, sqrt(len(ts))) / 2) + 0.9::DOUBLE * {DENSITY.format('t.passage')} AS score FROM t LEFT JOIN lx ON t.doc_id = lx.doc_id AND t.pos = lx.pos)"
)


def with_query(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    return docs.withColumn("item_id", F.col("doc_id") % max(1, items.count())).join(items.withColumnRenamed("text", "query"), "item_id")


@query("para_score", f"WITH {PASSAGES} SELECT doc_id, pos::BIGINT AS pos, round(score, 6) AS score FROM sc")
def para_score(spark, d):
    scores = S.passage_scores(with_query(spark, d), "doc_id", "text", "query", r"\n")
    return scores.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.round("score", 6).alias("score"))


@query(
    "prune_paragraphs",
    f"WITH {PASSAGES}, o AS (SELECT doc_id, list({{'used': length(passage)::BIGINT + 1, 'kept': [{{'pos': pos, 'p': passage}}]}} ORDER BY round(score, 9) DESC, pos) AS xs FROM sc GROUP BY doc_id), "
    "kf AS (SELECT doc_id, xs, list_reduce(list_prepend({'used': 0::BIGINT, 'kept': xs[1].kept[1:0]}, xs), lambda s, x: CASE WHEN s.used + x.used <= 1200 THEN {'used': s.used + x.used, 'kept': list_concat(s.kept, x.kept)} ELSE s END).kept AS kept FROM o), "
    "w AS (SELECT doc_id, trim(text, ' ') AS t FROM documents), c AS (SELECT doc_id, xs[1].used > 1200 AS alone, xs[1].kept[1].p AS best, len(xs) AS n, kept FROM kf), "
    "z AS (SELECT w.doc_id, CASE WHEN length(t) <= 1200 THEN 0 WHEN alone THEN n - 1 ELSE n - len(kept) END AS dropped, CASE WHEN length(t) <= 1200 THEN t ELSE CASE WHEN alone THEN left(best, 1200) ELSE array_to_string(list_transform(list_sort(kept), lambda x: x.p), chr(10) || chr(10)) END || CASE WHEN alone AND n > 1 THEN chr(10) || chr(10) || '[+' || (n - 1) || ']' WHEN NOT alone AND n > len(kept) THEN chr(10) || chr(10) || '[+' || (n - len(kept)) || ']' ELSE '' END END AS text FROM w JOIN c USING (doc_id)) "
    "SELECT doc_id, dropped, length(text) AS n_chars, md5(text) AS digest FROM z",
)
def prune_paragraphs(spark, d):
    """The best passages of each document for its query, within 1,200 characters."""
    kept = S.pruned(with_query(spark, d), "doc_id", "text", "query", 1200)
    return kept.select("doc_id", "dropped", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


BARE = "regexp_replace(text, '[^\\p{L}\\p{N}_]+', '', 'g')"


@query(
    "evidence_pack",
    f"WITH d AS (SELECT item_id, doc_id AS pos, n_chars % 97 / 97.0::DOUBLE AS relevance, documents.text, {BARE.replace('text', 'documents.text')} AS fp FROM documents JOIN benchmark ON item_id = doc_id % (SELECT count(*) FROM benchmark)), "
    "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, fp ORDER BY pos) AS k FROM d) WHERE k = 1 OR fp = ''), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, pos) AS rank FROM u) WHERE rank <= 5), "
    "c AS (SELECT item_id, pos, relevance, left(text, greatest(300, 6000 // count(*) OVER (PARTITION BY item_id))::INT) AS text FROM f), g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, pos) AS r, count(*) OVER (PARTITION BY item_id) AS n FROM c WHERE text <> '') "
    "SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN n >= 3 AND r = 1 THEN 0 WHEN n >= 3 AND r = 2 THEN 2 ELSE 1 END, pos) AS place, md5(text) AS digest FROM g",
)
def evidence_pack(spark, d):
    """The five most relevant documents of each query, packed into 6,000 characters. Of equal fingerprints only the first
    takes a place; ids alone are compared, and texts are fetched for those chosen."""
    docs = with_query(spark, d).select("item_id", F.col("doc_id").alias("pos"), (F.col("n_chars") % 97 / 97).alias("relevance"), "text")
    ids = docs.select("item_id", "pos", "relevance", X.fingerprint("text").alias("fp"))
    first = ids.where("fp != ''").groupBy("item_id", "fp").agg(F.min(F.struct("pos", "relevance")).alias("x")).select("item_id", "x.*")
    best = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("relevance"), "pos"))
    few = first.unionByName(ids.where("fp = ''").drop("fp")).withColumn("rank", best).where("rank <= 5").select("item_id", "pos")
    return S.packed_evidence(docs.join(few, ["item_id", "pos"], "left_semi"), "item_id", 6000).select("item_id", "pos", "place", F.md5("text").alias("digest"))


@query(
    "quota_topk",
    "WITH d AS (SELECT lang, source, doc_id AS pos, n_chars % 1000 / 1000.0::DOUBLE AS score FROM documents), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY score DESC, pos) AS k FROM d) WHERE k <= 5), "
    "o AS (SELECT lang, list({'o': [{'rank': -score, 'pos': pos, 'source': source}]} ORDER BY score DESC, pos) AS xs FROM b GROUP BY lang), "
    "c AS (SELECT lang, list_transform(xs, lambda x: x.o[1]) AS every, CASE WHEN len(xs) <= 5 THEN list_transform(xs, lambda x: x.o[1]) ELSE list_reduce(list_prepend({'o': xs[1].o[1:0]}, xs), lambda s, x: CASE WHEN len(s.o) >= 5 OR (len(list_filter(s.o, lambda y: y.source = x.o[1].source)) >= 2 AND len(s.o) < 4) THEN s ELSE {'o': list_concat(s.o, x.o)} END).o END AS got FROM o), "
    "f AS (SELECT lang, list_concat(got, list_filter(every, lambda x: NOT list_contains(got, x)))[1:5] AS xs FROM c) SELECT lang, generate_subscripts(xs, 1)::INT AS place, unnest(xs).pos AS pos, unnest(xs).source AS source FROM f",
)
def quota_topk(spark, d):
    """Five documents of a language, of one source two at most, but for the last place."""
    best = Window.partitionBy("lang", "source").orderBy(F.desc("score"), "pos")
    docs = table(spark, d, "documents").select("lang", "source", F.col("doc_id").alias("pos"), (F.col("n_chars") % 1000 / 1000).alias("score"))
    docs = docs.withColumn("k", F.row_number().over(best)).where("k <= 5")  # no more of a source can be taken
    return S.quota_top(docs, "lang", "source", 5)


@query("context_budget", "WITH g AS (SELECT source, list({'used': c, 'n': 1::BIGINT} ORDER BY n_chars % 1000 DESC, doc_id) AS xs FROM (SELECT source, doc_id, n_chars, trunc(n_chars * 0.7::DOUBLE)::BIGINT + 1 AS c FROM documents) GROUP BY source), f AS (SELECT source, len(xs) AS total, list_reduce(list_concat([{'used': 0::BIGINT, 'n': 0::BIGINT}], xs), lambda s, x: CASE WHEN s.used + x.used <= 20000 THEN {'used': s.used + x.used, 'n': s.n + 1} ELSE s END) AS k FROM g) SELECT source, k.n AS n_kept, total - k.n AS n_dropped, k.used AS used FROM f")
def context_budget(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars", (F.col("n_chars") * 0.7).cast("int").alias("tokens"))
    return S.within_budget(docs, "source", [-(F.col("n_chars") % 1000), F.col("doc_id")], F.col("tokens") + 1, 20_000)


@query("render_budget", "SELECT source, count(*) FILTER (WHERE upto <= 12000) AS n_kept, count(*) FILTER (WHERE upto > 12000) AS n_dropped, coalesce(sum(size) FILTER (WHERE upto <= 12000), 0)::BIGINT AS used FROM (SELECT source, size, sum(size) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM (SELECT source, doc_id, least(n_chars, 4000) AS size FROM documents)) GROUP BY source")
def render_budget(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.least("n_chars", F.lit(4000)).alias("size"))
    return S.within_budget(docs, "source", [F.col("doc_id")], F.col("size"), 12_000, stop=True)


@query("holdout_split", "SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, doc_id) <= floor(count(*) OVER () * 0.2::DOUBLE) AS held FROM documents")
def holdout_split(spark, d):
    """A fifth of the documents, to the document."""
    return S.hash_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.2)


@query("evict_oldest", "SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) > 1500 AS evicted FROM conversations")
def evict_oldest(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return S.evict_oldest(turns, "conv_id", "turn", "size", 1500).select("conv_id", "turn", "evicted")


@query("fallback_top3", "SELECT source, doc_id, n AS place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3")
def fallback_top3(spark, d):
    """Three longest of each source: a bounded top list, which each task cuts before the rows are shuffled."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, d, "documents").select("source", "doc_id", "n_chars").withColumn("place", place).where("place <= 3").drop("n_chars")


@query("severity_split", "SELECT doc_id, CASE WHEN sev >= 90 THEN 'critical' ELSE 'notice' END AS part FROM (SELECT doc_id, sev, row_number() OVER (PARTITION BY source, sev >= 90 ORDER BY sev DESC, doc_id) AS n FROM (SELECT doc_id, source, n_chars % 100 AS sev FROM documents)) WHERE sev >= 90 OR n <= 2")
def severity_split(spark, d):
    hits = table(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") % 100).alias("sev"))
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("sev"), "doc_id"))
    few = hits.where("sev < 90").withColumn("n", n).where("n <= 2").select("doc_id", F.lit("notice").alias("part"))
    return hits.where("sev >= 90").select("doc_id", F.lit("critical").alias("part")).unionByName(few)


BRIDGE = [("en", 0, "guide"), ("en", 1, "drug"), ("en", 2, "law"), ("en", 3, "index"), ("fr", 0, "law"), ("fr", 1, "guide"), ("de", 0, "index")]
BRIDGE_SQL = "(VALUES " + ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in BRIDGE) + ") AS r(lang, pos, source_name)"


@query("route_sources", f"SELECT doc_id, coalesce(names, 'guide') AS sources FROM documents LEFT JOIN (SELECT lang, string_agg(source_name, ',' ORDER BY pos) AS names FROM {BRIDGE_SQL} WHERE source_name IN ('guide', 'drug', 'index', 'law') AND pos < 3 GROUP BY lang) USING (lang)")
def route_sources(spark, d):
    bridge = spark.createDataFrame(BRIDGE, "lang string, pos int, source_name string")
    names = bridge.where("source_name in ('guide', 'drug', 'index', 'law')").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "source_name"))).alias("xs"))
    names = names.select("lang", F.array_join(F.transform(F.slice("xs", 1, 3), lambda x: x["source_name"]), ",").alias("names"))
    return table(spark, d, "documents").join(F.broadcast(names), "lang", "left").select("doc_id", F.coalesce("names", F.lit("guide")).alias("sources"))


TOOLS = [("the", "dict"), ("tion", "index"), ("der", "law"), ("que", "guide"), ("[0-9]", "price"), ("ing", "search")]


@query("tool_subset", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{t}' END" for p, t in TOOLS) + "], lambda x: x IS NOT NULL)[1:3], ',') AS tools FROM documents")
def tool_subset(spark, d):
    """The tools whose words a text holds, in order, three at most."""
    tools = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(t)) for p, t in TOOLS]))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(tools, 1, 3), ",").alias("tools"))


@query("citation_select", "SELECT user_id, event_id, score, n AS place FROM (SELECT user_id, event_id, round(greatest(0.0, least(1.0, value / 100.0)), 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click') WHERE n <= 3")
def citation_select(spark, d):
    """The first three cited events of a user that were observed (clicks), with scores held within 0 and 1."""
    cited, seen = table(spark, d, "events"), table(spark, d, "events").where("event_type = 'click'").select("event_id")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100)), 6)
    return cited.join(seen, "event_id", "left_semi").withColumn("place", place).where("place <= 3").select("user_id", "event_id", score.alias("score"), "place")


@query("evidence_best", "SELECT source, arg_max(doc_id, n_chars * 1000000 - doc_id) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY source")
def evidence_best(spark, d):
    """The longest text of each id; of equal lengths the first."""
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("pos"))).alias("x")
    return table(spark, d, "documents").groupBy("source").agg(best).select("source", (-F.col("x.pos")).alias("doc_id"), "x.n_chars")


@query("render_block", "SELECT source, md5(string_agg('[' || n || '] ' || text, chr(10) ORDER BY n) || CASE WHEN max(c) > 5 THEN chr(10) || (max(c) - 5) || ' more' ELSE '' END) AS digest FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY source) AS c FROM documents) WHERE n <= 5 GROUP BY source")
def render_block(spark, d):
    """Numbered blocks of a source's first five texts, and how many were left out."""
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    totals = docs.groupBy("source").agg(F.count(F.lit(1)).alias("c"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    few = docs.select("source", "doc_id").withColumn("n", place).where("n <= 5")  # ids alone go to the windows
    first = few.join(docs.select("doc_id", "text"), "doc_id")
    own = first.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("xs")).join(totals, "source")
    block = F.array_join(F.transform("xs", lambda x: F.concat(F.lit("["), x["n"].cast("string"), F.lit("] "), x["text"])), "\n")
    more = F.when(F.col("c") > 5, F.concat(F.lit("\n"), (F.col("c") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return own.select("source", F.md5(F.concat(block, more)).alias("digest"))


@query("render_warning", "SELECT doc_id, concat_ws(' / ', lang, CASE WHEN n_chars > 1000 THEN 'long' END, CASE WHEN contains(text, '!!') THEN 'loud' END, source) AS warning FROM documents")
def render_warning(spark, d):
    parts = [F.col("lang"), F.when(F.col("n_chars") > 1000, "long"), F.when(F.contains("text", F.lit("!!")), "loud"), F.col("source")]
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" / ", *parts).alias("warning"))


@query("search_union", "SELECT 0 AS source_pos, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark UNION ALL SELECT 2, page_id, url FROM pages")
def search_union(spark, d):
    """The results of several sources, one after another."""
    docs, items, pages = table(spark, d, "documents"), table(spark, d, "benchmark"), table(spark, d, "pages")
    parts = [docs.select("doc_id", "text"), items.select("item_id", "text"), pages.select("page_id", "url")]
    out = [p.toDF("id", "text").withColumn("source_pos", F.lit(i)) for i, p in enumerate(parts)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("best_items", "SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY coalesce(CASE WHEN n_chars % 11 > 0 THEN n_chars % 97 / 97::DOUBLE END, 0) DESC, doc_id) AS place FROM documents) WHERE place <= 6")
def best_items(spark, d):
    """The six most relevant documents of each source; some have no score."""
    items = table(spark, d, "documents").select("source", "doc_id", F.when(F.col("n_chars") % 11 > 0, F.col("n_chars") % 97 / 97).alias("score"))
    return S.best_items(items, "source", "score", "doc_id").select("source", "doc_id", "place")
