"""Each stage of the pipeline against a plain version, on its own input."""

import collections
import inspect

import corpus_pipeline as P
import pytest
from brute import ASCII, line_dedup, targets, words
from conftest import DATA

from evidentia.llm.common import stored
from evidentia.llm.quality import judged


@pytest.fixture(scope="module")
def steps(spark, documents):
    out = [documents]
    for name, stage in P.STAGES:
        out.append(stored(stage(spark, out[-1], DATA), f"test-{len(out)}"))
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_shape(steps):
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
    assert list(inspect.signature(P.run).parameters) == ["spark", "sf_dir"]
    for df in steps[:-1]:
        assert df.columns == steps[0].columns and df.dtypes == steps[0].dtypes and df.count() > 0


def test_quality(spark, steps):
    kept = judged(steps[0], spark.read.parquet(f"{DATA}/labels.parquet")).where("kept").select("doc_id").collect()
    assert sorted(i for i, _ in rows(steps[1])) == sorted(r[0] for r in kept)
    assert set(rows(steps[1])) <= set(rows(steps[0]))


def test_line_dedup(steps):
    import hashlib

    wanted = {(i, h) for i, _, _, h in line_dedup(rows(steps[1]))}
    assert {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows(steps[2])} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in steps[2].collect())


def test_one_of_each(steps):
    """One document of each component of exact similarity 0.8 or more, over five-word shingles, stays."""
    before = rows(steps[2])
    own = {}
    for i, t in before:
        w = words((t or "").translate(ASCII))
        own.setdefault(i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(own)
    for n, i in enumerate(order):
        for j in order[:n]:
            if own[i] == own[j] or 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(i for i, _ in rows(steps[3])) == sorted({find(i) for i in own})


def test_mix(steps):
    before, after = steps[3].collect(), steps[4].collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in before:
        sizes[r["source"]] += len(words(r["text"]))
    for r in after:
        taken[r["source"]] += len(words(r["text"]))
    n = collections.Counter((r["doc_id"], r["text"]) for r in after)
    assert max(n.values()) <= 2 and set(n) <= {(r["doc_id"], r["text"]) for r in before}
    longest = max(len(words(r["text"])) for r in before)
    for s, t in targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= max(0.05 * t, longest)


def test_pack(steps):
    packed = steps[5].collect()
    n = collections.Counter(i for i, _ in rows(steps[4]))
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == n
    fill = collections.Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048


def test_lower_case_is_ascii():
    assert "ÀA".translate(ASCII) == "Àa"
