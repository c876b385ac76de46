"""Dropping repeated lines: a sharded minimal perfect hash indexes all different lines and the counts of their documents."""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, stored

#: Line rows that a shard is meant to serve; shards grow in number with the lines, not in size.
SHARD_ROWS = 1 << 16
LEAST_SHARDS = 256
GAMMA = 2.0


def line_hash(line: str, least: int) -> bytes | None:
    """128 bits of a line's key (stripped, A-Z lower-cased), or None if it has fewer than `least` code points."""
    line = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= least else None


def mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A hash of 128-bit keys for a level of the perfect hash."""
    with np.errstate(over="ignore"):
        x = a ^ (b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD6E8FEB86659FD93))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def build_hash(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Bit arrays, one a level, that map n distinct 128-bit keys one to one to 0..n-1: at each level a key that is alone
    at its place is settled there, the others go on to the next."""
    levels = []
    while len(a):
        size = max(64, -(-int(GAMMA * len(a)) // 64) * 64)
        at = (mixed(a, b, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little"))
        left = ~alone[at]
        a, b = a[left], b[left]
    return levels


def places(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each key's place; a key that the hash was not built from gets any place, or -1."""
    out, open_, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
    for k, packed in enumerate(levels):
        bits = np.unpackbits(packed, bitorder="little").astype(bool)
        at = (mixed(a[open_], b[open_], k) % np.uint64(len(bits))).astype(np.int64)
        rank = np.cumsum(bits) - 1
        hit = bits[at]
        out[open_[hit]] = base + rank[at[hit]]
        open_, base = open_[~hit], base + int(bits.sum())
    return out


def build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """The arrays of one shard: level bits, and at each key's place its fingerprint, count and last document."""
    a, b = rows["a"].to_numpy().view(np.uint64), rows["b"].to_numpy().view(np.uint64)
    levels = build_hash(a, b)
    at = places(levels, a, b)
    prints, counts, last = np.empty(len(a), np.uint64), np.empty(len(a), np.uint32), np.empty(len(a), np.int64)
    prints[at], counts[at], last[at] = b, np.minimum(rows["n_docs"].to_numpy(), 2**32 - 1), rows["last"].to_numpy()
    one = {"shard": rows["shard"].iloc[0], "salts": rows["salts"].iloc[0], "levels": [x.tobytes() for x in levels], "prints": prints.tobytes(), "counts": counts.tobytes(), "last": last.tobytes()}
    return pd.DataFrame([one])


SHARD = "shard int, salts int, levels array<binary>, prints binary, counts binary, last binary"


def probe(least_docs: int):
    def probed(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        """The asked lines that their documents lose."""
        if not len(index) or not len(asked):
            return asked.iloc[:0][["doc_id", "a", "b"]]
        x = index.iloc[0]
        a, b = asked["a"].to_numpy().view(np.uint64), asked["b"].to_numpy().view(np.uint64)
        at = places([np.frombuffer(y, np.uint8) for y in x["levels"]], a, b)
        prints, counts, last = np.frombuffer(x["prints"], np.uint64), np.frombuffer(x["counts"], np.uint32), np.frombuffer(x["last"], np.int64)
        hit = (at >= 0) & (prints[at] == b) & (counts[at] >= least_docs)
        hit &= last[at] != asked["doc_id"].to_numpy()
        return asked.loc[hit, ["doc_id", "a", "b"]]

    return probed


def document_lines(documents: DataFrame, least: int) -> DataFrame:
    """(doc_id, a, b): the 128-bit hashes of each document row's different keys; rows without an id have none."""

    def hashed(batches):
        for batch in batches:
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {h for x in (text or "").split("\n") if (h := line_hash(x, least))}
                ids += [i] * len(own)
                keys += own
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "a", "b"])

    ids = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return ids.mapInArrow(hashed, "doc_id bigint, a bigint, b bigint")


def doomed_lines(documents: DataFrame, least: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc_id, a, b) for each line that a document loses, by the index of shared lines.

    Lines are counted once a document, and every different line goes to the shards of a minimal perfect hash, with a
    64-bit fingerprint beside the 64 bits that place a key, its count and its last document. Documents' lines probe the
    shards' arrays: the count decides. A shard that serves far more lines than the others (lines that a large part of
    all documents hold) is copied over salts, each of which answers for its part of the documents.
    """
    spark = documents.sparkSession
    lines = stored(document_lines(documents, least).distinct(), "lines")
    n = lines.count()
    shards = max(LEAST_SHARDS, -(-n // SHARD_ROWS))
    shard = F.pmod(F.col("a"), F.lit(shards)).cast("int")
    counted = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last"))
    counted = stored(counted.withColumn("shard", shard), "counted")
    load = max(1, 2 * n // shards)
    # At most n / load shards, less than the shards' number, can need salts; a row for each goes to every task.
    salts = counted.groupBy("shard").agg(F.ceil(F.sum("n_docs") / load).cast("int").alias("salts"))
    salts = stored(salts, "salts")
    index = stored(counted.join(salts, "shard").groupBy("shard").applyInPandas(build_shard, SHARD), "index")
    hot = F.broadcast(salts.where("salts > 1"))
    asked = lines.withColumn("shard", shard).join(hot, "shard", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    copied = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    found = asked.select("shard", "salt", "doc_id", "a", "b").groupBy("shard", "salt").cogroup(copied.groupBy("shard", "salt"))
    return found.applyInPandas(probe(least_docs), "doc_id bigint, a bigint, b bigint")


def without_shared_lines(documents: DataFrame, least: int = 20, least_docs: int = 3) -> DataFrame:
    """documents with text as its kept lines, joined by newlines, and with n_lines and n_dropped.

    A line's key is the line without blanks at its ends, A-Z lower-cased. A key of at least `least` code points that at
    least least_docs doc_ids hold loses all its lines but those in the largest doc_id that holds it. A null or empty
    text is one empty line. Rows that repeat a doc_id count once and lose the same lines; rows without an id neither
    count nor lose any; an empty table gives no rows. Other columns are carried as they are; n_lines and n_dropped
    replace columns of those names.
    """
    columns = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    lost = doomed_lines(documents, least, least_docs)
    lost = lost.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct("a", "b")).alias("__lost"))
    rows = documents.select(*columns).join(lost, documents["doc_id"] == F.col("__doc"), "left").drop("__doc")
    at = columns.index("text")

    def rewritten(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, lost in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                if lost:
                    gone = {np.array([x["a"], x["b"]], np.int64).tobytes() for x in lost}
                    kept = [x for x in lines if line_hash(x, least) not in gone]
                    text = "\n".join(kept)
                    n_dropped.append(len(lines) - len(kept))
                else:
                    n_dropped.append(0)
                texts.append(text or "")
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    fields = documents.select(*columns).schema.add("n_lines", T.LongType()).add("n_dropped", T.LongType())
    return rows.mapInArrow(rewritten, fields)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = without_shared_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM t),
k AS (SELECT rid, doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT rid, k.doc_id, line, pos, coalesce(k.doc_id <> last, false) AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""
