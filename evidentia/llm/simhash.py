"""Near duplicates by SimHash, with candidates from pigeonring chains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, stored

#: Segments of the ring and the most bits in which linked fingerprints differ.
SEGMENTS, BITS = 8, 2
#: Fingerprints under one key from which on the key is split by the further segments of its chain.
CROWDED = 32
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, size: int = 3) -> np.ndarray:
    """The hash of each of a text's word shingles, repeats included; fewer than `size` words are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    n = max(1, len(words) - size + 1)
    last = ends[len(words) - n :] - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_of(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    return majority(shingle_hashes(text, size))


def fingerprints(documents: DataFrame, size: int = 3, keyed: bool = False) -> DataFrame:
    """(doc_id, fp), if `keyed` with row_key, for each document row; fp is the fingerprint's bits as a long."""

    def hashed(batches):
        for batch in batches:
            fps = np.array([fingerprint_of(t, size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])

    rows = documents.select("doc_id", "text", *[row_key().alias("row_key")] * keyed)
    return rows.mapInArrow(hashed, f"doc_id {dict(documents.dtypes)['doc_id']}, fp bigint" + ", row_key string" * keyed)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks(segments: int) -> list[int]:
    """The bits of each segment, in ring order."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def chain_fits(a: Column, b: Column, start: Column, segments: int, bits: int) -> Column:
    """Whether, from segment `start` on around the ring, each chain of l segments differs in at most l * bits / segments bits."""
    ring = masks(segments)
    differ = [F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(signed(m)))) for m in ring]

    def from_(i: int) -> Column:
        fits, total = F.lit(True), F.lit(0)
        for k in range(segments):
            total = total + differ[(i + k) % segments]
            fits = fits & (total <= (k + 1) * bits // segments)
        return fits

    out = F.when(start == 0, from_(0))
    for i in range(1, segments):
        out = out.when(start == i, from_(i))
    return out


def longer_chains(ring: list[int], bits: int) -> tuple[list[list[int]], list[list[int]]]:
    """For each start: the masks of its longer chain, one for each of its segments that may differ, and the rest of each.

    A chain's first segments are equal; the segments after them differ in one bit altogether until the budget reaches
    two, so all of them but one are equal too.
    """
    n = len(ring)
    exact, longer = max(1, -(-n // bits) - 1), min(n, max(1, -(-2 * n // bits) - 1))
    chains = [[[ring[(i + k) % n] for k in range(longer) if k != skip] for skip in range(exact, longer)] for i in range(n)]
    return [[sum(c) for c in own] for own in chains], [[((1 << 64) - 1) ^ sum(c) for c in own] for own in chains]


def links(found: DataFrame, segments: int = SEGMENTS, bits: int = BITS, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) that join the different fingerprints of found(fp) just as all pairs within `bits` bits do (bits 1 or 2).

    By the pigeonring principle, some chain around the ring stays within its proportional budgets wherever the whole ring
    does. The leading segments of such a chain, whose budget is below one bit, are equal: they are the key under which
    fingerprints meet; the further budgets prune what meets, the last one being the full check. A key under which more
    than `crowded` meet is split along its chain: the segments whose budget is below two bits join the key, but for the
    one that may differ, so that with the default ring 48 bits are equal instead of 24. Where more than `crowded` meet
    even so (a cloud of fingerprints around one text), not all pairs are listed: on the bits that are left, any two within
    two bits of each other lie within one bit of a common word, and those around a word are linked to their least.
    """
    ring = masks(segments)
    exact = max(1, -(-segments // bits) - 1)
    keys = [sum(ring[(i + k) % segments] for k in range(exact)) for i in range(segments)]
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(keys)]))
    rows = stored(found.select("fp", at.alias("at")).select("fp", "at.*"), "chains")
    met = rows.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stored(rows.join(met, ["start", "key"]), "met")
    near = pairs_under(met.where(F.col("n") <= crowded), ["start", "key"], segments, bits)

    chains, rests = longer_chains(ring, bits)
    skips = len(chains[0])
    mask = F.get(F.array(*[F.lit(signed(m)) for own in chains for m in own]), F.col("start") * skips + F.col("skip"))
    long = met.where(F.col("n") > crowded).select("fp", "start", F.explode(F.sequence(F.lit(0), F.lit(skips - 1))).alias("skip"))
    long = long.withColumn("key", F.col("fp").bitwiseAND(mask))
    sizes = long.groupBy("start", "skip", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    long = stored(long.join(sizes, ["start", "skip", "key"]), "longer")
    pairs = pairs_under(long.where(F.col("n") <= crowded), ["start", "skip", "key"], segments, bits)

    free = [[[b for b in range(64) if rest >> b & 1] for rest in own] for own in rests]
    most = max(len(b) for own in free for b in own)
    ones = F.array(*[F.lit(signed(1 << b[k])) if k < len(b) else F.lit(None).cast("bigint") for own in free for b in own for k in range(most)])
    bit = F.get(ones, (F.col("start") * skips + F.col("skip")) * most + F.col("k"))
    cloud = long.where(F.col("n") > crowded).select("fp", "start", "skip", F.explode(F.sequence(F.lit(0 if bits == 1 else -1), F.lit(most - 1))).alias("k")).withColumn("bit", bit)
    # Within one bit: equal once that bit is set. Within two bits: around the same word.
    word = F.col("fp").bitwiseOR(F.col("bit")) if bits == 1 else F.when(F.col("k") < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.col("bit")))
    by = ["word", "bit"] if bits == 1 else ["word"]
    words = cloud.withColumn("word", word).where("word is not null").select("fp", *by).distinct()
    least = words.groupBy(*by).agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1")
    stars = words.join(least, by).where("fp != a").select("a", F.col("fp").alias("b"))
    return near.unionByName(pairs).unionByName(stars).distinct()


def pairs_under(met: DataFrame, by: list[str], segments: int, bits: int) -> DataFrame:
    """The pairs (a, b) of met(fp, start, ...) under one key whose chains, from its start on, keep their budgets."""
    other = met.select(*by, F.col("fp").alias("b"))
    fits = chain_fits(F.col("a"), F.col("b"), F.col("start"), segments, bits)
    return met.withColumnRenamed("fp", "a").join(other, by).where((F.col("a") < F.col("b")) & fits).select("a", "b")


def near_duplicates(documents: DataFrame, size: int = 3, segments: int = SEGMENTS, bits: int = BITS, crowded: int = CROWDED, keyed: bool = False) -> DataFrame:
    """A row for each document row: doc_id, fp, class_fp and component_id, and row_key if `keyed`.

    Words are lower-cased (A-Z) runs of non-blanks; a text with fewer than `size` words is one shingle, one without
    words (or null) has fingerprint zero. Fingerprints link at `bits` or fewer differing bits; class_fp stands for the
    component's fingerprints and component_id is its smallest doc_id (null if it has none). Repeated rows and equal
    texts are one fingerprint; an empty table gives no rows.
    """
    docs = stored(fingerprints(documents, size, keyed), "fingerprints")
    groups = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    found = components(links(groups.select("fp"), segments, bits, crowded), "a", "b")
    roots = groups.join(found, groups["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("class_fp"))
    roots = stored(roots, "roots")
    ids = roots.groupBy("class_fp").agg(F.min("least").alias("component_id"))
    # A row for each fingerprint, joined to all documents: a fingerprint that many documents share is split by the join.
    named = stored(roots.join(ids, "class_fp").select(F.col("fp").alias("own"), "class_fp", "component_id"), "named")
    return docs.join(named, docs["fp"] == named["own"]).select(*docs.columns, "class_fp", "component_id")


def row_key() -> Column:
    """A hash of doc_id and text, for either of them null too: it tells rows without an id, or with equal ones, apart."""
    i = F.col("doc_id").cast("string")
    return F.sha2(F.concat(F.coalesce(F.concat(F.length(i).cast("string"), F.lit(":"), i), F.lit("-")), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("-"))), 256)


def one_row_of_each(documents: DataFrame, found: DataFrame) -> DataFrame:
    """One row of documents for each class of found(doc_id, row_key, class_fp): that of the least doc_id, then of the least
    key; rows without a doc_id come last. Rows of equal doc_id and text are one."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("row_key").alias("__kept"))
    kept = found.groupBy("class_fp").agg(F.min(order).alias("least")).select("least.__kept")
    rows = documents.withColumn("__key", row_key()).join(kept, F.col("__key") == F.col("__kept"), "left_semi")
    return rows.dropDuplicates(["__key"]).drop("__key")


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """documents without near duplicates: of each component one row stays, that of its smallest doc_id if it has any."""
    return one_row_of_each(documents, near_duplicates(documents, keyed=True, **options))


def op9_simhash_pigeonring(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
