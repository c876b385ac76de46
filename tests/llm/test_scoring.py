import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import ASCII, unigram, words
from conftest import DATA, ROWS

from evidentia.llm import scoring
from evidentia.llm.scoring import Learner, Model, before_each, op8_log_bilinear, scored


def out(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def held(rows, docs):
    n, total = unigram(docs, lambda i: not out(i))
    p = {w: math.log10((c + 0.1) / (total + 0.1 * (len(n) + 1))) for w, c in n.items()}
    none = math.log10(0.1 / (total + 0.1 * (len(n) + 1)))
    wanted = []
    for i, t in docs:
        own = [*words((t or "").translate(ASCII)), None]
        wanted.append((str(i), out(i), len(own), sum(w in n for w in own), total, round(sum(p.get(w, none) for w in own), 4)))
    for got, want in zip(sorted(rows, key=lambda r: (str(r["doc_id"]), r["base_score"])), sorted(wanted, key=lambda w: (w[0], w[5]))):
        assert (str(got["doc_id"]), got["held_out"], got["n_tokens"], got["n_known"], got["train_tokens"]) == want[:5]
        assert got["base_score"] == pytest.approx(want[5], rel=1e-6, abs=1e-3)


@pytest.fixture(scope="module")
def rows(spark):
    return op8_log_bilinear(spark, DATA).collect()


def test_base_scores(rows, texts):
    held(rows, texts)


def test_better_than_unigrams_on_held_out_texts(rows):
    new, base = (sum(r[c] for r in rows if r["held_out"]) for c in ("score", "base_score"))
    assert 0 > new > base


def test_words_beyond_the_head_are_joined(spark, documents, rows):
    few, all_of_them = (scored(documents, head=h, most=300).collect() for h in (600, 1 << 17))
    for a, b, c in zip(sorted(few), sorted(rows), sorted(all_of_them)):
        assert a["n_known"] == b["n_known"] and a["base_score"] == pytest.approx(b["base_score"], abs=1e-6)
        assert a["score"] == pytest.approx(c["score"], abs=1e-2)


def test_the_model_is_normalised():
    """Over all words of the vocabulary, for any context, before and after steps of training."""
    rng = np.random.default_rng(0)
    model = Model(np.sort(rng.integers(1, 5000, 400))[::-1].astype(float), classes=20, dim=8)
    learner = Learner(model)
    for _ in range(5):
        ids = rng.integers(0, 400, 3000)
        learner.step(rng.integers(0, 400, (model.context, 3000)), ids)
    for params in (model.params, learner.p):
        model.params = params
        for context in ([3, 5], [399, 0]):
            before = np.repeat(np.array(context)[:, None], 400, 1)
            assert np.exp(model.scores(before, np.arange(400)).astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_training_learns_what_follows_what():
    """A language in which each word is followed by one of two: the model comes near one bit a word."""
    rng = np.random.default_rng(1)
    n, size = 60_000, 50
    ids = np.zeros(n, np.int64)
    for i in range(1, n):
        ids[i] = (7 * ids[i - 1] + 3 + rng.integers(0, 2)) % size
    counts = np.bincount(ids, minlength=size).astype(float)
    order = np.argsort(-counts, kind="stable")
    place = np.argsort(order)
    ids = place[ids]
    model = Model(counts[order], classes=5)
    learner = Learner(model)
    before = before_each(ids, model.context, 0)
    start = model.scores(before, ids).mean()
    for _ in range(6):
        for at in range(0, n, 1000):
            learner.step(before[:, at : at + 1000], ids[at : at + 1000])
    model.params = learner.p
    assert start < -3.5 and model.scores(before, ids).mean() > -1.6


def test_texts_share_a_probability_of_one(spark):
    """All texts of up to three words, over the words of the corpus and one for all that were never seen; the corpus is
    large enough for the model to see, better than unigrams can, that its texts end there."""
    corpus = [(i, " ".join("abcd"[(i * k + k * k) % 4] for k in range(i % 4))) for i in range(20_000) if not out(i)]
    asked = [" ".join(p) for n in range(4) for p in itertools.product(("a", "b", "c", "d", "never"), repeat=n)]
    ids = itertools.islice((i for i in range(50_000, 200_000) if out(i)), len(asked))
    docs = spark.createDataFrame([*corpus, *zip(ids, asked)], "doc_id bigint, text string")
    rows = scored(docs, most=2).where("held_out").collect()
    total, unigrams = (sum(10 ** r[c] for r in rows) for c in ("score", "base_score"))
    assert 0.8 < unigrams < total < 1.0001


def mean_held_out(rows, column="score"):
    return sum(r[column] for r in rows if r["held_out"]) / sum(r["n_tokens"] for r in rows if r["held_out"])


def test_tasks_do_not_matter(spark, documents, rows):
    """One, four and sixteen partitions give the same scores; several learners keep part of one's gain over unigrams."""
    gain = mean_held_out(rows) - mean_held_out(rows, "base_score")
    for n in (1, 4, 16):
        again = scored(documents.repartition(n)).collect()
        for a, b in zip(sorted(rows, key=lambda r: r["doc_id"]), sorted(again, key=lambda r: r["doc_id"])):
            assert a["score"] == pytest.approx(b["score"], abs=2e-3 * a["n_tokens"])
    many = scored(documents.repartition(3), learners=3).collect()
    assert mean_held_out(many) - mean_held_out(many, "base_score") > 0.3 * gain > 0


def test_scores_by_a_plain_pass():
    """Each token's class and word by plain sums of exponentials, one token at a time."""
    rng = np.random.default_rng(3)
    model = Model(np.sort(rng.integers(1, 900, 60))[::-1].astype(float), classes=7, dim=5)
    for k, v in model.params.items():
        model.params[k] = rng.normal(0, 0.7, v.shape).astype(np.float32)
    ids = rng.integers(0, 60, 200)
    before = before_each(ids, model.context, 0)
    p = {k: v.astype(float).tolist() for k, v in model.params.items()}
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    for t, i in enumerate(ids.tolist()):
        h = [sum(dot(p["r"][before[k][t]], [row[j] for row in p["c"][k]]) for k in range(model.context)) for j in range(5)]
        classes = [math.exp(dot(h, u) + d) for u, d in zip(p["u"], p["d"])]
        own = int(model.of[i])
        words = {w: math.exp(dot(h, p["q"][w]) + p["b"][w]) for w in range(60) if model.of[w] == own}
        wanted = math.log(classes[own] / sum(classes) * words[i] / sum(words.values()))
        assert model.scores(before[:, t : t + 1], ids[t : t + 1])[0] == pytest.approx(wanted, abs=1e-4)


def test_a_context_is_summed_once(monkeypatch):
    """Tokens after the same words share the sum over the classes; each still has its own sum over the words of its class."""
    rng = np.random.default_rng(5)
    model = Model(np.sort(rng.integers(1, 900, 60))[::-1].astype(float), classes=7, dim=5)
    model.params = {k: rng.normal(0, 0.7, v.shape).astype(np.float32) for k, v in model.params.items()}
    before, ids = np.array([[3, 9, 9], [4, 4, 8]])[:, rng.integers(0, 3, 500)], rng.integers(0, 60, 500)
    wanted = [model.scores(before[:, t : t + 1], ids[t : t + 1])[0] for t in range(500)]
    rows, plain = [], scoring.log_sum
    monkeypatch.setattr(scoring, "log_sum", lambda s, *more: (rows.append(len(s)), plain(s, *more))[1])
    assert model.scores(before, ids) == pytest.approx(wanted, abs=1e-5)
    assert sum(rows) <= 3 + 500


def test_words_of_texts():
    """Only A-Z is lower-cased, and only ASCII blanks split."""
    texts = ["", None, "  Ab\x0bc \t\r\n", "\x0c", "É\u00a0x\u2003Y\x1cz \x00 B", "one", "b\n\nB one "]
    different, at, sizes = scoring.words_of(pa.array(["skipped", *texts])[1:])
    found = iter(different.to_pylist()[i] for i in at)
    assert [[next(found) for _ in range(n)] for n in sizes] == [(t or "").encode().lower().split() for t in texts]
    assert next(found, None) is None and b"" not in [different.to_pylist()[i] for i in at]
    assert [part.num_rows for part in scoring.parts_of(pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(["a" * 9, None, "b" * 30, None])], ["doc_id", "text"]), 10)] == [2, 2]


def test_awkward_rows(spark, awkward, empty):
    held(scored(awkward).collect(), [(i, t) for i, t, *_ in ROWS])
    assert scored(empty).count() == 0
