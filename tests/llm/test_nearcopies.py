import random

import corpus_pipeline as P

from evidentia.llm.common import stored
from evidentia.llm.nearcopies import name_of, near_links, one_of_near_copies, read_once, shingle_set


def shingles(text):
    own = text.lower().split()
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4)))


def like(a, b):
    return len(shingles(a) & shingles(b)), len(shingles(a) | shingles(b))


def planted():
    """Texts, each with copies whose tails or words were changed: similarities from well below 0.8 to 0.95 and above."""
    rng = random.Random(3)
    rows = []
    for _ in range(12):
        own = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((30, 100, 400)))]
        rows.append(" ".join(own))
        for share in (0.02, 0.05, 0.1, 0.12, 0.2, 0.3):
            rows.append(" ".join(own[: round(len(own) * (1 - share / 2))] + [f"v{rng.random()}" for _ in range(round(len(own) * share / 2))]))
        for changes in (1, 2, 3, 4):
            x = list(own)
            for i in rng.sample(range(len(x)), changes):
                x[i] = f"u{rng.random()}"
            rows.append(" ".join(x))
    rows = sorted(set(rows))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_all_pairs_and_components(spark):
    docs = planted()
    wanted, root = set(), {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in docs:
        for j, b in docs[:i]:
            both, either = like(a, b)
            if 5 * both >= 4 * either and both < either:
                wanted.add(frozenset((i, j)))
            if 5 * both >= 4 * either:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert sum(0.8 <= like(docs[i][1], docs[j][1])[0] / like(docs[i][1], docs[j][1])[1] <= 0.95 for i, j in map(tuple, wanted)) > 50
    table = stored(spark.createDataFrame(docs, "doc_id bigint, text string"), "test-planted")
    at = {name_of(shingle_set(t)): i for i, t in docs}
    pairs = {frozenset(at[x % 2**64] for x in p) for p in near_links(table, *read_once(table)).collect()}
    assert pairs <= wanted
    kept = P.near_dedup(spark, table, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({find(i) for i, _ in docs})


def test_a_large_group_of_near_copies(spark):
    """800 near copies of one text, and texts that share a passage with it without being near: one of each stays."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for k in range(800):
        x = list(base)
        x[rng.randrange(5, 115)] = f"u{k}"
        rows.append(" ".join(x))
    for k in range(60):
        rows.append(" ".join([*base[:40], *[f"v{k}_{i}" for i in range(80)]]))
    table = stored(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"), "test-group")
    kept = sorted(r["doc_id"] for r in one_of_near_copies(table).collect())
    assert kept == [0, *range(800, 860)]


def test_awkward_rows(awkward, empty):
    kept = one_of_near_copies(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, (1, 2, None, 6, 7, 8, 9, 10, 11)))
    assert one_of_near_copies(empty).count() == 0
