"""Target-distribution importance resampling: hashed n-gram features, gathered and scored on word tries of each task's own."""

from __future__ import annotations

import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import kth, numbered
from .common import CRC_TABLE, LOWER, UPPER, crc_of, few_rows, kept_by_worker, stored

#: Hash buckets of features, the longest run of words, and the share (in percent) of documents that is drawn.
BUCKETS, MOST, SHARE = 10_000, 1, 10
#: Documents of fewer words are scored but not drawn; what makes the draw's noise differ between draws.
LEAST_WORDS, SEED = 20, 2024
#: Nodes from which on a task folds its trie into the bucket totals and grows a new one, bytes of a text split at once,
#: and nodes looked up at once.
NODES, PIECE, AT_ONCE = 1 << 19, 1 << 20, 1 << 20
#: Bytes of words stay, A-Z are lower-cased, all others part words; what is not ASCII belongs to words.
PARTS = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
SIGNS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Words(dict):
    """Words as the trie's first level; a word that is not there yet becomes a node."""

    def __init__(self, trie):
        self.trie = trie

    def __missing__(self, word):
        node = self[word] = self.trie.add(zlib.crc32(word))
        self.trie.names[node] = word
        return node


class Trie:
    """A trie of words in flat arrays. Each node stands for a run of words and holds the CRC-32 state of the run joined by
    spaces, from which its children's states go on, and a number: the count of the run, or the gain of its bucket."""

    def __init__(self, most: int, buckets: int, gains: np.ndarray | None = None):
        self.most, self.buckets, self.gains = most, buckets, None if gains is None else gains.tolist()
        self.words, self.names, self.kids = Words(self), {}, {}
        self.states, self.held = array("Q"), array("q")

    def add(self, state: int) -> int:
        self.states.append(state)
        self.held.append(0 if self.gains is None else self.gains[state % self.buckets])
        return len(self.states) - 1

    def child(self, key: int) -> int:
        node = self.kids.get(key)
        if node is None:
            node = self.kids[key] = self.add(zlib.crc32(b" " + self.names[key & 0xFFFFFFFF], self.states[key >> 32]))
        return node

    def walk(self, words: list[bytes], before: int = 0) -> list[np.ndarray]:
        """The nodes of all runs of the words, level by level, but for runs that lie within the first `before` words."""
        own = level = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        out = [level[before:]]
        for k in range(2, min(self.most, len(words)) + 1):
            keys, at = np.unique(level[:-1] << 32 | own[k - 1 :], return_inverse=True)
            level = np.fromiter(map(self.child, keys.tolist()), np.int64, len(keys))[at]
            out.append(level[max(0, before - k + 1) :])
        return out

    def totals(self) -> np.ndarray:
        """The counts that the nodes hold, by bucket."""
        out = np.zeros(self.buckets, np.int64)
        np.add.at(out, (np.array(self.states, np.uint64) % np.uint64(self.buckets)).astype(np.int64), np.array(self.held, np.int64))
        return out


def runs_of(text: bytes | None, most: int):
    """A text's words in pieces, each led by the last most - 1 words of the one before, and how many those are."""
    text, last, at = text or b"", [], 0
    while at < len(text):
        parted = PARTS.search(text, min(len(text), at + PIECE))  # a piece ends where a word does
        end = parted.start() if parted else len(text)
        words = text[at:end].translate(SIGNS).split()
        if words:
            yield last + words, len(last)
            last = (last + words)[-(most - 1) :] if most > 1 else []
        at = end


def texts_of(column) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def walked(trie: Trie, texts: list[bytes | None]):
    """The nodes of all features of some texts, some at once, with (text, new words, start, end) of each stretch of them."""
    nodes, spans, size = [], [], 0
    for row, own in enumerate(texts):
        for words, before in runs_of(own, trie.most):
            levels = trie.walk(words, before)
            n = sum(map(len, levels))
            nodes += levels
            spans.append((row, len(words) - before, size, size + n))
            size += n
            if size > AT_ONCE:
                yield np.concatenate(nodes), spans
                nodes, spans, size = [], [], 0
    if spans:
        yield np.concatenate(nodes), spans


def bucket_totals(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, most: int = MOST) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends at most a number for each bucket."""

    def count(batches):
        trie, found = Trie(most, buckets), np.zeros(buckets, np.int64)
        for batch in few_rows(batches):
            for nodes, _ in walked(trie, texts_of(batch.column(0))):
                trie.held = array("q", (np.array(trie.held, np.int64) + np.bincount(nodes, minlength=len(trie.held))).tobytes())
            if len(trie.held) > NODES:
                found += trie.totals()
                trie.words.trie, trie = None, Trie(most, buckets)
        found += trie.totals()
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], ["bucket", "n"])

    rows = texts.select(F.col(text)).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # `buckets` rows at most
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the raw corpus, both with one added."""
    n = len(raw)
    return np.floor(1000 * np.log((target + 1.0) * (raw.sum() + float(n)) / ((raw + 1.0) * (target.sum() + float(n))))).astype(np.int64)


def weighted(documents: DataFrame, gains: np.ndarray, most: int = MOST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document: weight is the floored mean of its features' gains, 0 if it
    has none. Tries are walked once more, now with the gains at their nodes."""
    spark, buckets, label = documents.sparkSession, len(gains), uuid.uuid4().hex
    sent = spark.sparkContext.broadcast(gains)  # a number for each bucket

    def score(batches):
        own_gains = kept_by_worker("gains", label, lambda: sent.value)
        trie = Trie(most, buckets, own_gains)
        for batch in few_rows(batches):
            n_words, n_features, totals = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for nodes, spans in walked(trie, texts_of(batch.column(1))):
                upto = np.concatenate([[0], np.cumsum(np.array(trie.held, np.int64)[nodes])])
                for row, words, start, end in spans:
                    n_words[row] += words
                    n_features[row] += end - start
                    totals[row] += upto[end] - upto[start]
            if len(trie.held) > NODES:
                trie.words.trie, trie = None, Trie(most, buckets, own_gains)
            weights = np.where(n_features > 0, totals // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weights))], ["doc_id", "n_words", "n_features", "weight"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def drawn(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows(doc_id, n_words, score, ...) with rank: 1, 2, ... for the floor(share * N / 100) highest scores of the N rows of
    at least `least_words` words, ties to the smaller doc_id (null first), null for all others.

    The score at the cut is found by counting in ranges, so only what may be drawn is sorted, and that in many tasks.
    """
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    known = stored(rows.withColumn("__down", -F.col("score")).withColumn("__able", able), "scored")
    chosen = known.where("__able")
    most = share * chosen.count() // 100
    found = kth(chosen, "__down", most)
    none = F.lit(None).cast("bigint").alias("rank")
    if found is None:
        return known.select(*rows.columns, none)
    near = F.col("__able") & (F.col("__down") <= found[0])
    top = numbered(known.where(near), [F.col("__down"), F.col("doc_id")], "__place")
    rank = F.when(F.col("__place") < most, F.col("__place") + 1).alias("rank")
    return top.select(*rows.columns, rank).unionByName(known.where(~near).select(*rows.columns, none))


def scored(documents: DataFrame, targets: DataFrame, buckets: int = BUCKETS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row of documents, for drawing the rows most like the targets' texts.

    Features are runs of 1 to `most` words (lower-cased A-Z, digits and all that is not ASCII) hashed by CRC-32; weight is
    the mean gain of a document's features and score adds Gumbel noise that depends on the seed and the id alone, so the
    highest scores are a draw without replacement. Null texts have no words and weight 0, a null id has the noise of an
    empty one, repeated rows count as often as they stand, empty tables give no rows; other columns are not read.
    """
    gains = bucket_gains(bucket_totals(documents, "text", buckets, most), bucket_totals(targets, "text", buckets, most))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(named, 256), F.lit(8)), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))
    return weighted(documents, gains, most).withColumn("score", F.col("weight") + noise)


def resampled(documents: DataFrame, targets: DataFrame, share: int = SHARE, **options) -> DataFrame:
    """The drawn rows of documents, whole, with their rank. Rows that repeat an id are drawn or left as their id's best is."""
    found = drawn(scored(documents, targets, **options), share).where("rank is not null")
    best = found.groupBy(F.col("doc_id").alias("__id")).agg(F.min("rank").alias("__rank"))
    plain = documents.drop("rank")
    return plain.join(best, F.col("doc_id").eqNullSafe(F.col("__id"))).select(*plain.columns, F.col("__rank").alias("rank"))


def op13_word_trie_resampling(spark, sf_dir: str) -> DataFrame:
    documents, targets = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return drawn(scored(documents, targets)).select("doc_id", "n_features", "weight", "score", "rank")


def oracle() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return (
        f"WITH d AS (SELECT doc_id, unnest({words}) AS w FROM documents), b AS (SELECT unnest({words}) AS w FROM benchmark), dc AS (SELECT doc_id, w, count(*) AS n FROM d GROUP BY ALL), "
        "c AS (SELECT w, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM (SELECT w, n AS s, 0 AS t FROM dc UNION ALL SELECT w, 0, 1 FROM b) GROUP BY w), "
        f"k AS ({CRC_TABLE}), h AS (SELECT w, s, c.t, {crc_of('w', 'k.t')} % {BUCKETS} AS bucket FROM c, k), "
        f"g AS (SELECT bucket, floor(1000 * ln((sum(t)::DOUBLE + 1) * (any_value(a.sa)::DOUBLE + {BUCKETS}) / ((sum(s)::DOUBLE + 1) * (any_value(a.ta)::DOUBLE + {BUCKETS}))))::BIGINT AS gain FROM h, (SELECT sum(s) AS sa, sum(t) AS ta FROM c) a GROUP BY bucket), "
        "w AS (SELECT doc_id, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM dc JOIN h USING (w) JOIN g USING (bucket) GROUP BY doc_id), "
        f"x AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents d LEFT JOIN w USING (doc_id)), "
        f"r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_features >= {LEAST_WORDS}), m AS (SELECT {SHARE} * count(*) // 100 AS most FROM r) "
        "SELECT x.*, CASE WHEN rank <= (SELECT most FROM m) THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)"
    )
