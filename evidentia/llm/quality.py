"""Quality rules: text statistics, and hashed n-grams' log-likelihood ratio between a trusted and the raw corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, stored

#: Buckets of the hashed n-grams' multinomials: what is broadcast is bounded by it.
BUCKETS = 1 << 14
#: A document goes if its score is lower than the trusted documents' mean by so many of their standard deviations.
SPREAD = 3.0
#: One in so many trusted documents, by a hash of doc_id, takes no part in the counts and sets the threshold.
HELD = 4
#: The target's model is fitted on about so many trusted documents at most, chosen by a hash of doc_id.
MOST_TRUSTED = 1 << 17
SYMBOLS = "#*$%&|<>"


def once(value: Column, use) -> Column:
    """use(value) with value computed a single time, though use refers to it again and again."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def pairs_with(a: Column, k: int, join) -> Column:
    """join(a[i], a[i + k]) for every i at which both are there."""
    n = F.size(a) - k
    return F.when(n > 0, F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(a, k + 1, F.greatest(n, F.lit(0))), join)).otherwise(F.array().cast("array<bigint>"))


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def buckets_of(hashes: Column, buckets: int) -> Column:
    """The buckets of a document's words and pairs of neighbouring words, in order; pairs follow words."""
    words = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pairs = pairs_with(hashes, 1, lambda a, b: F.xxhash64(a, b))
    return F.concat(words, F.transform(pairs, lambda h: F.pmod(h, F.lit(buckets)).cast("int")))


def repeat_words(hashes: Column) -> Column:
    """How many of a text's words stand in a three-word window that the text has twice or more."""

    def covered(windows):
        def at(order):
            twin = lambda i, j: order[i]["h"] == F.get(order, j)["h"]
            spots = F.filter(order, lambda x, i: F.coalesce(twin(i, i - 1), F.lit(False)) | F.coalesce(twin(i, i + 1), F.lit(False)))
            return once(F.transform(spots, lambda x: x["i"]), lambda p: F.size(F.array_distinct(F.flatten(F.array(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2))))))

        order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(once(order, at))

    n = F.greatest(F.size(hashes) - 2, F.lit(0))
    pair = F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 2, n), lambda a, b: F.xxhash64(a, b))
    return once(F.zip_with(pair, F.slice(hashes, 3, n), lambda a, b: F.xxhash64(a, b)), covered)


def text_rules(text: Column, hashes: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words as long columns."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return [
        F.size(hashes).cast("bigint").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("bigint").alias("word_chars"),
        F.when(text.rlike(f"[{SYMBOLS}]"), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(0).cast("bigint").alias("n_symbols"),
        once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeat_words(hashes).cast("bigint").alias("n_repeat_words"),
    ]


def ratio_weights(documents: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with `weights`: for each bucket, ln of its share in the trusted documents over its share in all.

    Counts are taken over every document, with one added to each bucket; trusted(doc_id) has each id once and is
    bounded (see MOST_TRUSTED): it goes to every task, so that no text is shuffled.
    """
    docs = documents.select("doc_id", word_hashes(F.col("text")).alias("hashes"))
    mark = F.broadcast(trusted.select("doc_id", F.lit(1).alias("good")))
    grams = docs.join(mark, "doc_id", "left").select("good", F.explode(buckets_of(F.col("hashes"), buckets)).alias("bucket"))
    counts = stored(grams.groupBy("bucket").agg(F.count("good").alias("good"), F.count(F.lit(1)).alias("every")), "grams")
    sums = counts.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("all_good"), F.coalesce(F.sum("every"), F.lit(0)).alias("all"))
    full = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["good", "every"])
    ratio = F.log((F.col("good") + 1) / (F.col("all_good") + buckets)) - F.log((F.col("every") + 1) / (F.col("all") + buckets))
    return full.join(F.broadcast(sums)).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", ratio.alias("w")))), lambda x: x["w"]).alias("weights"))


def with_scores(documents: DataFrame, weights: DataFrame, buckets: int) -> DataFrame:
    """documents with `q`, a structure of the text rules and the score. A generator makes it, so that it is made once
    whatever is filtered by it."""

    def mean_weight(b, w):
        return F.aggregate(b, F.lit(0.0), lambda s, x: s + F.get(w, x)) / F.size(b)

    hashes, w = F.col("__hashes"), F.col("__weights")
    score = F.when(F.size(hashes) > 0, once(buckets_of(hashes, buckets), lambda b: mean_weight(b, w))).otherwise(0.0)
    rows = documents.withColumn("__hashes", word_hashes(F.col("text"))).join(F.broadcast(weights.withColumnRenamed("weights", "__weights")))
    return rows.select(*documents.columns, F.explode(F.array(F.struct(*text_rules(F.col("text"), hashes), score.alias("score")))).alias("__q"))


def judged_rows(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS, spread: float = SPREAD, least_words: int = 50) -> DataFrame:
    """documents with `__q`: the text rules, score, base_failed and kept; see `judged`."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").dropna().distinct()
    good = stored(good, "trusted")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0
    fitting, judging = good.where(~held), good.where(held)
    every = max(1, -(-fitting.count() // MOST_TRUSTED))
    fitting = fitting.where(F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(every)) == 0)
    weights = stored(ratio_weights(documents, fitting, buckets), "weights")
    # All that are held out set the threshold: few ids go to the texts, many meet them in a shuffle.
    few = judging.count() <= MOST_TRUSTED
    trusted = documents.select("doc_id", "text").join(F.broadcast(judging) if few else judging.hint("merge"), "doc_id", "left_semi")
    mean, deviation = with_scores(trusted, weights, buckets).where(F.col("__q.n_words") >= least_words).agg(F.avg("__q.score"), F.stddev_pop("__q.score")).first()
    q = F.col("__q")
    fits = F.lit(True) if mean is None else q["score"] >= round(mean - spread * deviation, 9)
    failed = (q["n_words"] < least_words) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    return with_scores(documents, weights, buckets).withColumn("__q", q.withField("base_failed", failed).withField("kept", ~failed & fits))


def judged(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """A row for each document row: doc_id, the text rules, score, base_failed and kept.

    score is the mean, over a whole text's words and pairs of neighbouring words, of their buckets' weights (0 for a
    text without words). Trusted documents are those that labels calls of quality 1 and not toxic; one in HELD of them
    is kept out of the target's counts, which are taken over about MOST_TRUSTED of the others at most. Every document is held against one threshold: the mean score of those held out
    (all of them that have least_words words or more) less `spread` of their standard deviations; without any, nothing is rejected by it.
    A null text counts as empty and fails the base rules. Null labels and ids do not match, repeated ones count once;
    repeated rows are judged alike; an empty table gives no rows.
    """
    return judged_rows(documents.select("doc_id", "text"), labels, **options).select("doc_id", "__q.*")


def accepted(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The document rows that `judged` keeps, with their columns."""
    return judged_rows(documents, labels, **options).where("__q.kept").select(*documents.columns)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judged(documents, labels).drop("score")
