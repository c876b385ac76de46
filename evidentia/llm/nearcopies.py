"""Near copies by similarity: SimHash fingerprints and shared shingles propose pairs, exact Jaccard similarity decides."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, few_rows, kept_by_worker, stored
from .simhash import links, majority, one_row_of_each, row_key, shingle_hashes

#: Words of a shingle, and the similarity from which on two documents are near copies, LEAST / OF.
WORDS, LEAST, OF = 5, 4, 5
#: Hash classes by which shingles are ordered, rare ones first. Any order gives the same pairs: the counts only keep
#: frequent shingles out of the prefixes.
CLASSES = 1 << 18
#: A pair is listed under its first common key where that is among so many first keys of both.
FIRST = 16
#: Classes of row keys by which rows whose texts are not asked for are left out before texts are shuffled.
ASKED = 1 << 20


def shingle_set(text: str | None) -> np.ndarray:
    """The different hashes of a text's word shingles, sorted; a text without words has none."""
    return np.unique(shingle_hashes(text, WORDS))


def name_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), len(shingles))


def read_once(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, name, fp) for each document row, and (class, n), how many different shingles of all documents are in
    each hash class. Equal shingle sets have equal names; fp is the fingerprint of the shingles, repeats included."""

    def read(batches):
        counts = np.zeros(CLASSES, np.int64)
        for batch in few_rows(batches):
            names, prints = [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(text, WORDS)
                own = np.unique(hashes)
                np.add.at(counts, (own % CLASSES).astype(np.int64), 1)
                names.append(name_of(own))
                prints.append(majority(hashes))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (names, prints)]
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *signed, none, none], fields)
        seen = np.flatnonzero(counts)
        empty = [pa.nulls(len(seen), t) for t in (kind, pa.string(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], fields)

    from pyspark.sql.pandas.types import to_arrow_type

    fields, kind = ["doc_id", "row_key", "name", "fp", "class", "n"], to_arrow_type(documents.schema["doc_id"].dataType)
    rows = documents.select("doc_id", row_key().alias("row_key"), "text")
    done = stored(rows.mapInArrow(read, f"doc_id {dict(documents.dtypes)['doc_id']}, row_key string, name bigint, fp bigint, class bigint, n bigint"), "names")
    return done.where("class is null").drop("class", "n"), done.where("class is not null").groupBy("class").agg(F.sum("n").alias("n"))


def prefixes(documents: DataFrame, counted: DataFrame) -> DataFrame:
    """(key, name, n, at): the first shingles of each document's set, of n shingles, in the common order.

    Sets whose similarity is LEAST / OF or more share at least that share of either, so at least one of the first
    n - ceil(n * LEAST / OF) + 1 shingles of each.
    """
    found, classes = counted.toArrow(), np.zeros(CLASSES, np.int64)  # CLASSES rows at most
    classes[found["class"].to_numpy()] = found["n"].to_numpy()
    sent, label = documents.sparkSession.sparkContext.broadcast(classes), uuid.uuid4().hex

    def cut(batches):
        counts = kept_by_worker("classes", label, lambda: sent.value)
        for batch in few_rows(batches):
            keys, names, sizes, places = ([np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int32, np.int32))
            for text in batch.column(0).to_pylist():
                own = shingle_set(text)
                if n := len(own):
                    k = n + (-n * LEAST) // OF + 1
                    order = np.lexsort((own, counts[own % CLASSES]))[:k]
                    keys.append(own[order])
                    names.append(np.full(k, name_of(own), np.uint64))
                    sizes.append(np.full(k, n, np.int32))
                    places.append(np.arange(k, dtype=np.int32))
            columns = [np.concatenate(keys).view(np.int64), np.concatenate(names).view(np.int64), np.concatenate(sizes), np.concatenate(places)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "name", "n", "at"])

    return documents.select("text").mapInArrow(cut, "key bigint, name bigint, n int, at int")


def confirmed(documents: DataFrame, named: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs(a, b) of names whose sets' similarity is at least LEAST / OF."""
    ends = pairs.select(F.col("a").alias("end")).distinct().union(pairs.select("b").distinct()).distinct()
    one = named.join(ends, F.col("name") == F.col("end"), "left_semi").groupBy("name").agg(F.min("row_key").alias("one")).select("one")
    one = stored(one, "ends")
    of = lambda key: F.pmod(F.xxhash64(key), F.lit(ASKED))
    asked = F.broadcast(one.select(of("one").alias("__class")).distinct())  # ASKED rows at most
    rows = documents.select("text", row_key().alias("__key")).join(asked, of("__key") == F.col("__class"), "left_semi")
    texts = rows.join(one, F.col("__key") == F.col("one"), "left_semi").dropDuplicates(["__key"]).select("text")

    def read(batches):
        for batch in few_rows(batches):
            own = [shingle_set(t) for t in batch.column(0).to_pylist()]
            names = np.array([name_of(x) for x in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], ["name", "own"])

    sets = stored(texts.mapInArrow(read, "name bigint, own array<bigint>"), "sets")
    left, right = (sets.select(F.col("name").alias(x), F.col("own").alias(f"own_{x}")) for x in "ab")
    both = F.size(F.array_intersect("own_a", "own_b"))
    held = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("own_a") + F.size("own_b")).alias("sizes"))
    return held.where(F.col("both") * (LEAST + OF) >= F.col("sizes") * LEAST).select("a", "b")


def fits(a: str, b: str):
    """Whether two sets under one key can be similar enough: by their sizes, and by what follows the key in either."""
    n, m = F.col(f"n_{a}"), F.col(f"n_{b}")
    rest = F.least(n - F.col(f"at_{a}"), m - F.col(f"at_{b}"))
    return (n * OF >= m * LEAST) & (m * OF >= n * LEAST) & (rest * (LEAST + OF) >= (n + m) * LEAST)


def fingerprint_pairs(named: DataFrame) -> DataFrame:
    """Pairs of names that SimHash proposes: sets of one fingerprint, and fingerprints that pigeonring chains link."""
    groups = stored(named.groupBy("fp").agg(F.min("name").alias("hub")), "fingerprints")
    same = named.select("fp", "name").distinct().join(groups, "fp").select(F.col("hub").alias("a"), F.col("name").alias("b"))
    near = links(groups.select("fp"))
    for end in "ab":
        near = near.join(groups.select(F.col("fp").alias(end), F.col("hub").alias(f"hub_{end}")), end)
    return same.unionByName(near.select(F.col("hub_a").alias("a"), F.col("hub_b").alias("b")))


def in_order(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_links(documents: DataFrame, named: DataFrame, counted: DataFrame) -> DataFrame:
    """Links (a, b) between names, each confirmed, that join the different sets just as all pairs of LEAST / OF or more do.

    First, the pairs that fingerprints propose, and, under each shingle of the prefixes, one set of each size band held
    against the others: what many documents share is joined with no more pairs than rows. Then, under each shingle, only
    sets that are not yet joined are held against each other, those outside its largest component against all: so a large
    group of near copies gives no pairs among itself, and no pair between different components is left out. A pair is
    listed once, under its first common shingle, and not under those that follow.
    """
    # One shuffle by key serves to make rows different, to count them and to leave out what no other set has.
    keys = prefixes(documents, counted).repartition("key").distinct()
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("key")
    band = F.floor(F.log("n") / F.log(F.lit(OF / LEAST))).cast("int").alias("band")
    keys = stored(keys.join(shared, "key", "left_semi").select("*", band), "met")
    first = F.min(F.struct("name", "n", "at")).alias("hub")
    hubs = keys.groupBy("key", "band").agg(first).select("key", "band", F.col("hub.name").alias("hub"), F.col("hub.n").alias("n_hub"), F.col("hub.at").alias("at_hub"))
    keys = stored(keys.join(hubs, ["key", "band"]), "hubs")
    tied = keys.withColumnsRenamed({"n": "n_own", "at": "at_own"}).where(fits("own", "hub")).select("hub", "name")
    pairs = stored(in_order(fingerprint_pairs(named).unionByName(tied.select(F.col("hub").alias("a"), F.col("name").alias("b")))), "pairs")
    joined = stored(confirmed(documents, named, pairs), "near")

    roots = components(joined, "a", "b")
    rows = keys.join(roots, keys["name"] == roots["node"], "left")
    rows = stored(rows.select("key", "band", "name", "n", "at", F.coalesce("root", "name").alias("own"), (F.col("name") == F.col("hub")).alias("is_hub")), "rows")
    sizes = rows.groupBy("key", "own").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("key").agg(F.max_by("own", F.struct("m", "own")).alias("most"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("key", "most")
    firsts = keys.where(F.col("at") < FIRST).groupBy(F.col("name").alias("of")).agg(F.collect_list(F.struct("at", "key")).alias("firsts"))
    rows = rows.join(largest, "key").join(firsts, F.col("name") == F.col("of"), "left")
    before = F.transform(F.filter("firsts", lambda f: f["at"] < F.col("at")), lambda f: f["key"])
    rows = stored(rows.withColumn("before", F.coalesce(before, F.array().cast("array<bigint>"))).drop("of", "firsts"), "apart")
    x, y = (rows.select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("band", "name", "n", "at", "own", "is_hub", "before")], *[F.col("most")] * (k == "x")) for k in "xy")
    apart = (F.col("own_x") != F.col("own_y")) & ((F.col("own_y") == F.col("most")) | (F.col("name_x") < F.col("name_y")))
    tested = (F.col("band_x") == F.col("band_y")) & (F.col("is_hub_x") | F.col("is_hub_y"))
    rest = x.where("own_x != most").join(y, "key").where(apart & ~tested & fits("x", "y") & ~F.arrays_overlap("before_x", "before_y"))
    rest = stored(in_order(rest.select(F.col("name_x").alias("a"), F.col("name_y").alias("b"))), "pairs")
    return joined.unionByName(confirmed(documents, named, rest))


def one_of_near_copies(documents: DataFrame) -> DataFrame:
    """documents without near copies: of each component one row stays, that of its smallest doc_id if it has any.

    Rows whose sets of five-word shingles (lower-cased A-Z words) have a Jaccard similarity of 0.8 or more are linked;
    texts without words (also null ones) are alike. SimHash fingerprints with pigeonring chains propose what lies within
    their radius; shared shingles propose the rest, since no radius that chains can serve reaches a similarity of 0.8. Each
    link is confirmed exactly. Repeated rows are one; rows without an id count as any other; an empty table gives no rows.
    """
    named, counted = read_once(documents)
    found = components(near_links(documents, named, counted), "a", "b")
    classes = named.join(found, named["name"] == found["node"], "left").select("doc_id", "row_key", F.coalesce("root", "name").alias("class_fp"))
    return one_row_of_each(documents, classes)
