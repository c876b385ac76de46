import random

from brute import fingerprint, simhash_components
from conftest import DATA, ROWS
from pyspark.sql import functions as F

from evidentia.llm.simhash import fingerprint_of, links, near_duplicates, one_of_each, op9_simhash_pigeonring, signed


def test_whole_table(spark, texts):
    wanted = simhash_components(texts)
    rows = op9_simhash_pigeonring(spark, DATA).collect()
    assert sorted((r[0], r[1], r[2]) for r in rows) == sorted((i, f"{fingerprint(t):016x}", wanted[fingerprint(t)]) for i, t in texts)


def clusters(pairs, nodes):
    root = {p: p for p in nodes}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in pairs:
        root[find(a)] = find(b)
    out = {}
    for p in nodes:
        out.setdefault(find(p), set()).add(p)
    return sorted(map(sorted, out.values()))


def test_links_join_what_all_pairs_join(spark):
    """Random clouds of fingerprints, sparse and dense, for one and two bits."""
    rng = random.Random(5)
    for bits in (1, 2):
        seeds = [rng.getrandbits(64) for _ in range(12)]
        prints = set(seeds)
        for s in seeds:
            for _ in range(rng.choice((3, 60))):
                x = rng.choice([p for p in prints if (p ^ s).bit_count() < 20])
                for _ in range(rng.choice((1, 2, 3))):
                    x ^= 1 << rng.randrange(64)
                prints.add(x)
        prints = [signed(p) for p in prints]
        wanted = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= bits]
        found = spark.createDataFrame([(p,) for p in prints], "fp bigint")
        for crowded in (1, 4, 32, 10_000):
            pairs = [tuple(r) for r in links(found, bits=bits, crowded=crowded).collect()]
            assert clusters(pairs, prints) == clusters(wanted, prints), (bits, crowded)


def test_crowded_keys_are_split_along_the_ring(spark):
    """Many unlike fingerprints under one 24-bit key, some near pairs among them, and a cloud around one word."""
    rng = random.Random(9)
    key = rng.getrandbits(24)
    prints = {key | rng.getrandbits(40) << 24 for _ in range(1500)}
    for p in rng.sample(sorted(prints), 40):
        prints.add(p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    centre = rng.getrandbits(64)
    prints |= {centre ^ 1 << i ^ 1 << j for i in range(0, 64, 3) for j in range(i)}
    prints = [signed(p) for p in prints]
    wanted = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    pairs = [tuple(r) for r in links(spark.createDataFrame([(p,) for p in prints], "fp bigint")).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in pairs)
    assert clusters(pairs, prints) == clusters(wanted, prints)


def test_awkward_rows(spark, awkward, empty):
    docs = [(i, t) for i, t, *_ in ROWS]
    wanted = simhash_components(docs)
    rows = near_duplicates(awkward).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == sorted((str(i), str(wanted[fingerprint(t)])) for i, t in docs)
    kept = one_of_each(awkward)
    assert kept.columns == awkward.columns
    groups = {wanted[fingerprint(t)] for i, t in docs}
    assert kept.count() == len(groups)
    assert near_duplicates(empty).count() == 0 and one_of_each(empty).count() == 0


def test_long_text():
    text = " ".join(f"w{i % 1000}" for i in range(150_000))
    assert fingerprint_of(text) == fingerprint(text)


def test_many_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the very same words in every one of these copies").otherwise(F.concat(F.lit("text of its own "), F.sha2(F.col("id").cast("string"), 256), F.lit(" and so on"))).alias("text"))
    assert one_of_each(docs).count() == 1001


def test_one_row_of_each_without_ids(spark):
    """Different texts without an id all stay, and an id that repeats with another text keeps both."""
    texts = [" ".join(f"{w}{k}" for w in "some words that no other text of this table holds at all".split()) for k in range(6)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[4]), (None, texts[5]), (9, texts[5])]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    wanted = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[5])]
    assert sorted(str(tuple(r)) for r in kept) == sorted(map(str, wanted))
