import hashlib
import math
import re
import zlib

import pytest
from compare import duck, spark_rows
from conftest import DATA, LONG, ROWS

from evidentia.llm import resampling

TARGETS = ["The quick brown fox", "one shared line", None, "", "mail a.b@c.de — café"]


def features(text, most):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(rows, targets, buckets, most, share, seed=resampling.SEED):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t, most)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    raw, wanted = counts([r[1] for r in rows]), counts(targets)
    gains = [math.floor(1000 * math.log((t + 1) * (sum(raw) + buckets) / ((s + 1) * (sum(wanted) + buckets)))) for s, t in zip(raw, wanted)]
    out = []
    for i, text, *_ in rows:
        n_words, own = features(text, most)
        weight = sum(gains[zlib.crc32(f.encode()) % buckets] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n_words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / (1 << 32))))))
    able = sorted((-r[4], r[0] is not None, r[0] or 0) for r in out if r[1] >= resampling.LEAST_WORDS)
    return out, able[: share * len(able) // 100]


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_same_as_sql(spark):
    assert spark_rows(resampling.op13_word_trie_resampling(spark, DATA)) == duck(resampling.oracle())


@pytest.mark.parametrize("most,buckets,nodes,piece", [(1, 10_000, 1 << 19, 1 << 20), (2, 97, 4, 50), (3, 1000, 1 << 19, 7), (4, 10, 1, 1)])
def test_awkward_rows_by_brute_force(spark, awkward, monkeypatch, most, buckets, nodes, piece):
    """Runs of several words, tries that are folded again and again, and texts cut into small pieces."""
    monkeypatch.setattr(resampling, "NODES", nodes)
    monkeypatch.setattr(resampling, "PIECE", piece if len(LONG) < piece else max(piece, 1000))
    monkeypatch.setattr(resampling, "AT_ONCE", 1000)
    targets = spark.createDataFrame([(t,) for t in TARGETS], "text string")
    found = resampling.scored(awkward, targets, buckets, most)
    wanted, first = brute(ROWS, TARGETS, buckets, most, 50)
    assert in_order(found.collect()) == in_order(wanted)
    ranks = resampling.drawn(found, 50, resampling.LEAST_WORDS).where("rank is not null").orderBy("rank").collect()
    assert [(-r["score"], r["doc_id"] is not None, r["doc_id"] or 0) for r in ranks] == first
    assert [r["rank"] for r in ranks] == list(range(1, len(first) + 1))


def test_small_pieces(spark):
    """The pieces of a text give the words of the whole, whatever their size."""
    text = "a bb,ccc  dddd-e é𝒳 " * 9
    whole = next(resampling.runs_of(text.encode(), 1))[0]
    for size in range(1, 40):
        resampling.PIECE, kept = size, resampling.PIECE
        try:
            for most in (1, 2, 3):
                runs = list(resampling.runs_of(text.encode(), most))
                assert [w for words, before in runs for w in words[before:]] == whole
        finally:
            resampling.PIECE = kept


def test_empty(spark, empty, awkward):
    targets = spark.createDataFrame([(t,) for t in TARGETS], "text string")
    assert resampling.drawn(resampling.scored(empty, targets)).count() == 0
    assert resampling.scored(awkward, empty).count() == len(ROWS)
    got = resampling.resampled(awkward, targets, 100)
    assert set(got.columns) == set(awkward.columns) and got.count() > 0


def test_every_share(spark):
    rows = spark.createDataFrame([(i % 40, 30, -(i % 7)) for i in range(100)], "doc_id bigint, n_words bigint, score bigint")
    for share in (0, 1, 33, 100):
        got = resampling.drawn(rows, share).where("rank is not null").orderBy("rank").collect()
        assert [(-r["score"], r["doc_id"]) for r in got] == sorted((-r["score"], r["doc_id"]) for r in rows.collect())[:share]
