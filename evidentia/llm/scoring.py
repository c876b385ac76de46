"""Scoring texts by a log-bilinear language model trained with noise-contrastive estimation."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Words of the model's vocabulary (those counted LEAST_COUNT times or more), beside the end token and one for all other
#: words: so many, or GROWTH times the root of the training tokens, where that is more; HEAD bounds them. The classes over
#: which the vocabulary is dealt: so many, or SPREAD times the vocabulary's root.
MODEL, GROWTH, LEAST_COUNT, CLASSES, SPREAD = 1 << 15, 4, 5, 64, 0.7
#: Context words, and components of a word's vector.
CONTEXT, DIM = 2, 24
#: Learners are the root of the training tokens over EACH: their number follows from the corpus, not from the tasks. All
#: start a round from the same parameters, which are averaged after it; a single learner needs no rounds.
EACH, ROUNDS = 1 << 20, 4
#: Noise words for each word that is read, and how many of a class are drawn for a batch (of classes, twice as many).
NOISE, DRAWN = 8.0, 32
#: Tokens of a training batch, at first and at last (an eighth of what a task has read), the learning rate (of biases, a tenth), and where the sums of squared gradients start: few data then stay near
#: the words' frequencies.
FIRST, BATCH, RATE, START = 1 << 11, 1 << 14, 0.15, 1.0
#: Tokens that are held against all classes at once: what they need stays in a processor's cache.
AT_ONCE = 1 << 10
#: Words whose counts go to every task; the counts of the others are joined.
HEAD = 1 << 17
SMOOTH = 0.1
END = b"\n"  # no word holds a blank
#: Characters of texts that are split into words at once (one text at least), and tokens that are scored at once.
SPLIT, SCORED = 1 << 24, 1 << 16
#: Parts in which tasks' parameters travel to where they are averaged.
PARTS = 64


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different lower-cased (A-Z) words of all texts, each word's number in order, and how many words a text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, sizes = split.flatten().dictionary_encode(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    at, words = words.indices.to_numpy(zero_copy_only=False), words.dictionary
    none = pc.index(words, "").as_py()  # before, after and between blanks there may be empty ones
    if none >= 0:
        full = at != none
        sizes = np.diff(np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(sizes)])])
        at = at[full]
    return words.cast(pa.binary()), at, sizes


def parts_of(batch: pa.RecordBatch, most: int = SPLIT):
    """A batch of ids and texts in stretches of about `most` bytes of text."""
    held = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(held // most)) + 1).tolist(), batch.num_rows]
    for first, last in zip(cuts, cuts[1:]):
        if last > first:
            yield batch.slice(first, last - first)


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def trains(doc_id) -> bool:
    return not held_out(doc_id)


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) over the training documents, with the end token of each under END."""

    def counted(batches):
        for batch in batches:
            for part in parts_of(batch):
                texts = part.column(1).filter(pa.array([trains(i) for i in part.column(0).to_pylist()], pa.bool_()))
                words, at, _ = words_of(texts)
                words, n = pa.concat_arrays([words, pa.array([END], pa.binary())]), np.append(np.bincount(at, minlength=len(words)), len(texts))
                yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], ["word", "n"]).filter(pa.array(n > 0))

    rows = documents.select("doc_id", "text").mapInArrow(counted, "word binary, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """Parameters of a log-bilinear model whose words stand in classes of neighbouring frequency.

    A token's context is the sum of the vectors of the words before it, each mapped by its position's matrix. The context's
    product with a class vector plus a bias is the class's score, that with a word's vector plus a bias the word's score
    among the words of its class. Words are numbered by falling count, so that a class is a range of numbers.
    """

    def __init__(self, counts: np.ndarray, classes: int | None = None, dim: int = DIM, context: int = CONTEXT, seed: int = 7):
        rng, n = np.random.default_rng(seed), len(counts)
        classes = classes or max(CLASSES, int(SPREAD * n**0.5))
        mass = np.cumsum(np.sqrt(counts))
        self.of = np.unique(np.minimum((mass / mass[-1] * classes).astype(np.int64), classes - 1), return_inverse=True)[1]
        self.starts = np.searchsorted(self.of, np.arange(self.of[-1] + 2))
        share = counts / counts.sum()
        self.class_share = np.add.reduceat(share, self.starts[:-1])
        self.word_share = share / self.class_share[self.of]
        f = np.float32
        self.params = {
            "r": rng.normal(0, 0.1, (n, dim)).astype(f), "q": np.zeros((n, dim), f), "b": np.log(self.word_share).astype(f),
            "c": np.stack([np.eye(dim) / (k + 1) for k in range(context)]).astype(f), "u": np.zeros((len(self.class_share), dim), f), "d": np.log(self.class_share).astype(f),
        }
        self.dim, self.context = dim, context

    def scores(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The natural log-probability of each token given the ids before it, one row for each position of the context.

        Both levels are normalised over all their classes and words, by matrix products.
        """
        p, own = self.params, self.of[ids]
        order = np.argsort(own.astype(np.uint16), kind="stable")
        ids, own = ids[order], own[order]
        room, before = Room(), before[:, order]
        # Tokens after the same words share their context, and the sum over all classes.
        code = sum(b.astype(object if len(self.of) ** self.context >> 62 else np.int64) * len(self.of) ** k for k, b in enumerate(before))
        _, first, at = np.unique(code, return_index=True, return_inverse=True)
        u, q = np.column_stack([p["u"], p["d"]]), np.column_stack([p["q"], p["b"]])
        h = np.ones((len(first), self.dim + 1), np.float32)
        h[:, :-1] = read_before(p["r"], before[:, first], room) @ p["c"].reshape(-1, self.dim)
        classes = np.concatenate([log_sum(h[x : x + AT_ONCE], u, room) for x in range(0, len(h), AT_ONCE)] or [np.empty(0, h.dtype)])
        h = np.take(h, at, 0, room("h", len(ids), self.dim + 1), "clip")
        out = np.einsum("td,td->t", h, np.take(u, own, 0, room("rows", *h.shape), "clip")) - classes[at]
        words = np.einsum("td,td->t", h, np.take(q, ids, 0, room("rows", *h.shape), "clip"))
        for k, x, y in segments(own):
            a, b = self.starts[k], self.starts[k + 1]
            if b - a > 1:
                out[x:y] += words[x:y] - log_sum(h[x:y], q[a:b], room)
        back = np.empty(len(out))
        back[order] = out
        return back


class Room:
    """Arrays that are used again for one purpose after the other: asking the system for memory costs more than the sums."""

    def __init__(self):
        self.held: dict = {}

    def __call__(self, purpose: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if purpose not in self.held or self.held[purpose].size < size:
            self.held[purpose] = np.empty(size + size // 4, np.float32)
        return self.held[purpose][:size].reshape(shape)


def read_before(r: np.ndarray, before: np.ndarray, room: Room) -> np.ndarray:
    """The vectors of the words before each token, side by side; their product with the stacked matrices is the context."""
    keys = before.T.ravel()
    return np.take(r, keys, 0, room("before", len(keys), r.shape[1]), "clip").reshape(before.shape[1], -1)


def log_sum(h: np.ndarray, rows: np.ndarray, room: Room) -> np.ndarray:
    """ln of the sum of exp(score) over all rows of vectors and biases, for each row of h, whose last component is one."""
    s = np.matmul(h, rows.T, out=room("scores", len(h), len(rows)))
    with np.errstate(over="ignore"):
        total = np.exp(s, out=s) @ np.ones(len(rows), np.float32)
    if 1e-30 < total.min() <= total.max() < 1e30:
        return np.log(total)
    s = h @ rows.T  # near the range of 32-bit numbers: row by row
    most = s.max(1)
    return most + np.log(np.exp(s - most[:, None]).sum(1))


def segments(own: np.ndarray) -> list[tuple[int, int, int]]:
    """(class, from, to) for each class in a rising array of classes."""
    cuts = np.flatnonzero(np.diff(own)) + 1
    starts = [0, *cuts.tolist()] if len(own) else []
    return list(zip(own[starts].tolist(), starts, [*cuts.tolist(), len(own)]))


class Learner:
    """Steps of noise-contrastive estimation over batches of tokens, by adaptive gradients from a model's parameters.

    A vector and its bias are one row, as a context is with a one at its end. q and b, and u and d, are views of them.
    """

    def __init__(self, model: Model, noise: float = NOISE, drawn: int = DRAWN, rate: float = RATE, start: float = START, seed=11, squares: dict | None = None):
        self.m, self.noise, self.drawn, self.rate = model, noise, drawn, np.float32(rate)
        self.rows, self.p = self.joined(model.params)
        self.square_rows, self.squares = self.joined(squares or {k: np.full_like(v, start) for k, v in model.params.items()})
        self.read, self.place = np.zeros(len(model.of), np.int64), np.zeros(len(model.of), np.int64)
        self.rng = np.random.default_rng(seed)
        self.word_bounds, self.class_bounds = np.cumsum(model.word_share), np.cumsum(model.class_share)
        self.word_shift, self.class_shift = (np.log(noise * x).astype(np.float32) for x in (model.word_share, model.class_share))
        self.single, self.room = np.diff(model.starts) == 1, Room()

    @staticmethod
    def joined(p: dict) -> tuple[dict, dict]:
        """The rows of vectors and biases, and the parameters as views of them."""
        rows = {"r": p["r"].copy(), "c": p["c"].copy(), "q": np.column_stack([p["q"], p["b"]]), "u": np.column_stack([p["u"], p["d"]])}
        return rows, {"r": rows["r"], "q": rows["q"][:, :-1], "b": rows["q"][:, -1], "c": rows["c"], "u": rows["u"][:, :-1], "d": rows["u"][:, -1]}

    def move(self, name: str, g: np.ndarray, at=None) -> None:
        p, squares = self.rows[name], self.square_rows[name]
        at = np.arange(len(p)) if at is None else at
        s = np.take(squares, at, 0, self.room("squares", *g.shape), "clip")
        s += np.multiply(g, g, out=self.room("move", *g.shape))
        squares[at] = s
        np.sqrt(s, out=s)
        np.divide(g, s, out=s)
        s *= self.rate
        if g.shape[-1] > self.m.dim:
            s[:, -1] /= 10
        p[at] = np.subtract(np.take(p, at, 0, self.room("move", *g.shape), "clip"), s, out=s)

    def sums(self, keys: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different keys, and the sums of the columns of g (components, keys) for each."""
        at = np.flatnonzero(np.bincount(keys, minlength=len(self.read)))
        self.place[at] = np.arange(len(at))
        keys, found = self.place[keys], self.room("found", len(g), len(at))
        for into, x in zip(found, g):
            into[:] = np.bincount(keys, x, len(at))
        return at, np.ascontiguousarray(found.T)

    def noise_of(self, bounds: np.ndarray, shift: np.ndarray, rows: np.ndarray, places: np.ndarray, low, high, weight: float):
        """What is drawn, each once, with the negative scores' rows and the weight of as often as it is drawn."""
        drawn, times = np.unique(np.searchsorted(bounds, places).clip(low, high), return_counts=True)
        negative = -rows[drawn]
        negative[:, -1] += shift[drawn]
        return drawn, negative, (weight * times).astype(np.float32)

    def step(self, before: np.ndarray, ids: np.ndarray) -> None:
        """One step over the tokens ids and the ids before them."""
        m, weight, n, dim, room = self.m, self.noise / self.drawn, len(ids), self.m.dim, self.room
        q, u, c = self.rows["q"], self.rows["u"], self.rows["c"]
        order = np.argsort(m.of[ids].astype(np.uint16), kind="stable")
        before, ids = before[:, order], ids[order]
        own = m.of[ids]
        context, h = read_before(self.rows["r"], before, room), room("h", n, dim + 1)
        np.matmul(context, c.reshape(-1, dim), out=room("product", n, dim))
        h[:, :-1], h[:, -1] = room("product", n, dim), 1
        # What is read: its class, and the word within it.
        rows = np.take(u, own, 0, room("back", n, dim + 1), "clip")
        hit = np.exp(np.einsum("td,td->t", h, rows) - self.class_shift[own])
        hit = -1 / (1 + hit)
        rows *= hit[:, None]
        back, rows = rows, np.take(q, ids, 0, room("rows", n, dim + 1), "clip")
        read = np.exp(np.einsum("td,td->t", h, rows) - self.word_shift[ids])
        read = -1 / (1 + read)
        read[self.single[own]] = 0
        rows *= read[:, None]
        back += rows
        # Classes drawn by their shares, the same ones for all tokens of the batch.
        drawn, negative, weights = self.noise_of(self.class_bounds, self.class_shift, u, self.rng.random(2 * self.drawn), 0, len(m.class_share) - 1, weight / 2)
        to_drawn = np.zeros((len(drawn), dim + 1), np.float32)
        for x in range(0, n, AT_ONCE):
            hk = h[x : x + AT_ONCE]
            g = likely(hk, negative, weights, room)
            back[x : x + AT_ONCE] -= g @ negative
            to_drawn += g.T @ hk
        to_u = np.zeros_like(u)
        to_u[drawn] = to_drawn
        # Words drawn from the class that is read, the same ones for a class in this batch.
        found = segments(own)
        many = np.array([k for k, _, _ in found if not self.single[k]], np.int64)[:, None]
        drawn, negative, weights = self.noise_of(self.word_bounds, self.word_shift, q, many + self.rng.random((len(many), self.drawn)), m.starts[many], m.starts[many + 1] - 1, weight)
        edges = np.searchsorted(drawn, m.starts).tolist()
        to_q = room("to_q", dim + 1, n + len(drawn))
        np.multiply(h.T, read, out=to_q[:, :n])
        for k, x, y in found:
            hk, a, b = h[x:y], edges[k], edges[k + 1]
            to_u[k] += hit[x:y] @ hk
            if b > a:
                g = likely(hk, negative[a:b], weights[a:b], room)
                back[x:y] -= g @ negative[a:b]
                to_q[:, n + a : n + b] = hk.T @ g
        turned, to_r = room("product", dim, n), room("to_r", dim, m.context * n)
        turned[:] = back[:, :-1].T
        for k in range(m.context):
            to_r[:, k * n : k * n + n] = np.matmul(c[k], turned, out=room("mapped", dim, n))
        at_q, to_q = self.sums(np.concatenate([ids, drawn]), to_q)
        at_r, to_r = self.sums(before.ravel(), to_r)
        to_c = (turned @ context).reshape(dim, m.context, dim).transpose(1, 2, 0)
        self.read += np.bincount(before.ravel(), minlength=len(self.read)) + np.bincount(ids, minlength=len(self.read))
        for move in (("u", to_u), ("q", to_q, at_q), ("c", to_c), ("r", to_r, at_r)):
            self.move(*move)


def likely(h: np.ndarray, negative: np.ndarray, weights: np.ndarray, room: Room) -> np.ndarray:
    """The weighted probabilities that what is drawn is data and not noise."""
    g = np.matmul(h, negative.T, out=room("likely", len(h), len(negative)))
    np.exp(g, out=g)
    g += 1
    return np.divide(weights, g, out=g)


def before_each(ids: np.ndarray, context: int, end: int) -> np.ndarray:
    """The ids before each token of a document, the end token standing before its first."""
    padded = np.concatenate([np.full(context, end, ids.dtype), ids])
    return np.stack([padded[context - 1 - k : len(padded) - 1 - k] for k in range(context)])


class Vocabulary:
    """Numbers of the words whose counts are known to every task, and the model's number of each."""

    def __init__(self, counts: dict[bytes, int], total: int, distinct: int, most: int = MODEL, least: int = LEAST_COUNT):
        self.words = sorted(counts.keys() | {END}, key=lambda w: (w != END, -counts.get(w, 0), w))
        n = np.array([counts.get(w, 0) for w in self.words], float)
        inside = np.zeros(len(n), bool)
        inside[0] = True
        inside[1 : most + 1] = n[1 : most + 1] >= least
        #: Tokens of words outside the model, and how many such words there are.
        self.rest, self.kinds = total - n[inside].sum(), distinct - int((n[inside] > 0).sum())
        size = np.concatenate([np.maximum(n[inside], SMOOTH), [self.rest + SMOOTH * (self.kinds + 1)]])
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(size), np.int64)
        place[order] = np.arange(len(size))
        #: Counts by the model's numbers; its number for each known word, then that of all other words.
        self.sizes, self.other, self.end = size[order], int(place[-1]), int(place[0])
        self.model_ids = np.full(len(n) + 1, self.other, np.int64)
        self.model_ids[np.flatnonzero(inside)] = place[:-1]
        self.logs = np.concatenate([np.log10(n + SMOOTH), [0.0]])
        self.seen = np.concatenate([n > 0, [False]])


def encoded(documents: DataFrame, vocabulary: Vocabulary, learners: int, rounds: int) -> DataFrame:
    """Each document once as numbers: doc_id, held_out, the learner and round that it is dealt to by its id, h by which a
    learner's documents are ordered, the known words' places (-1 for others; the end last) as bytes of 32-bit numbers, the
    others with their counts, and a number of the row."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def part(known, doc_ids, texts):
        plain_ids = doc_ids.to_pylist()
        order = [zlib.crc32(t or b"", zlib.crc32(str(i).encode())) for i, t in zip(plain_ids, texts.cast(pa.binary()).to_pylist())]
        dealt = [zlib.crc32(f"learner {i}".encode()) for i in plain_ids]
        words, at, sizes = words_of(texts)
        place = pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        # The end is the first of the known words.
        ends = np.concatenate([[0], np.cumsum(sizes + 1)])
        ids, inside = np.zeros(ends[-1], np.int32), np.ones(ends[-1], bool)
        inside[ends[1:] - 1] = False
        ids[inside] = place[at]
        numbers = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(4 * ends), pa.py_buffer(ids)]).cast(pa.binary())
        other = np.flatnonzero(place[at] < 0)
        pairs, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[other] * len(words) + at[other], return_counts=True)
        starts = pa.array(np.searchsorted(pairs, np.arange(len(sizes) + 1) * max(len(words), 1)), pa.int32())
        tails = [pa.ListArray.from_arrays(starts, x) for x in (words.take(pa.array(pairs % max(len(words), 1))), pa.array(times, pa.int64()))]
        columns = [[held_out(i) for i in plain_ids], [x % learners for x in dealt], [x // learners % rounds for x in dealt], order]
        columns = [pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.int32(), pa.int32(), pa.int64()))]
        return pa.RecordBatch.from_arrays([doc_ids, *columns, numbers, *tails], ["doc_id", "held_out", "learner", "round", "h", "ids", "words", "times"])

    def encode(batches):
        known = pa.array(sent.value.words, pa.binary())
        for batch in batches:
            for own in parts_of(batch):
                yield part(known, own.column(0), own.column(1))

    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, held_out boolean, learner int, round int, h bigint, ids binary, words array<binary>, times array<bigint>")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "encoded")


def numbers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of `encoded` ids, and how many a row has."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.int32), np.diff(ends) // 4


def trained(rows: DataFrame, vocabulary: Vocabulary, total: int, learners: int, rounds: int, **options) -> Model:
    """A model trained on all training documents of `encoded` rows.

    In each round every learner steps through its documents of that round, in their order, from the same parameters and
    sums of squared gradients; a word's are then averaged over the learners by how often each has read it, in the
    learners' order. Neither the dealing nor the order depends on how the rows lie in partitions, so that runs agree.
    """
    spark, shared, own = rows.sparkSession, ("c", "u", "d"), ("r", "q", "b")
    model = Model(vocabulary.sizes, **options)
    squares = None
    rows = rows.where("not held_out").select("learner", "round", "h", "ids")
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((vocabulary, model, squares))
        began = total // (learners * rounds) * turn

        def learn(batches, sent=sent, turn=turn, began=began):
            words, model, squares = sent.value
            now, learner, before, ids, held, read, size = None, None, [], [], 0, 0, 0

            def packed():
                both = [{k: x[k] for k in (*shared, *own)} for x in (learner.p, learner.squares)]
                for part in range(PARTS):
                    x = [x[:, None] if x.ndim == 1 else x for x in (learner.read[part::PARTS], *(p[k][part::PARTS] for p in both for k in own))]
                    yield part, np.concatenate(x, 1).astype(np.float32).tobytes()
                yield PARTS, np.concatenate([[float(learner.read.sum())], *[p[k].ravel() for p in both for k in shared]]).astype(np.float64).tobytes()

            def done():
                if held:
                    learner.step(np.concatenate(before, 1), np.concatenate(ids))
                for part, data in packed():
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([now], pa.int32()), pa.array([data], pa.binary())], ["part", "learner", "data"])

            for batch in batches:
                at, sizes = numbers_of(batch.column(1))
                for who, at in zip(batch.column(0).to_pylist(), np.split(words.model_ids[at], np.cumsum(sizes)[:-1])):
                    if who != now:
                        if learner:
                            yield from done()
                        now, learner = who, Learner(model, seed=[turn, who], squares=squares)
                        before, ids, held, read = [], [], 0, began
                        size = min(BATCH, max(FIRST, read // 8))
                    before.append(before_each(at, model.context, words.end))
                    ids.append(at)
                    held += len(at)
                    if held >= size:
                        x, y, place = np.concatenate(before, 1), np.concatenate(ids), 0
                        while held - place >= size:
                            learner.step(x[:, place : place + size], y[place : place + size])
                            place, read = place + size, read + size
                            size = min(BATCH, max(FIRST, read // 8))
                        before, ids, held = [x[:, place:]], [y[place:]], held - place
            if learner:
                yield from done()

        def averaged(batches, dim=model.dim):
            width, sums = 4 * dim + 3, {}
            for batch in batches:
                for part, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    x = np.frombuffer(data, np.float64 if part == PARTS else np.float32).astype(np.float64)
                    x = x[None] if part == PARTS else x.reshape(-1, width)
                    x = np.concatenate([x[:, :1], x[:, 1:] * x[:, :1]], 1)
                    sums[part] = sums[part] + x if part in sums else x
            for part, x in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "data"])

        dealt = rows.where(F.col("round") == turn).drop("round").repartition(learners, "learner").sortWithinPartitions("learner", "h", "ids")
        found = dealt.select("learner", "ids").mapInArrow(learn, "part int, learner int, data binary")
        means = found.repartition(PARTS, "part").sortWithinPartitions("part", "learner").mapInArrow(averaged, "part int, data binary").collect()  # a row for each part
        squares = squares or Learner(model).squares
        for part, data in means:
            x = np.frombuffer(data, np.float64)
            if part == PARTS:
                x, at = (x[1:] / x[0]).astype(np.float32), 0
                for into in (model.params, squares):
                    for k in shared:
                        n = into[k].size
                        into[k], at = x[at : at + n].reshape(into[k].shape), at + n
            else:
                x = x.reshape(-1, 4 * model.dim + 3)
                read = np.flatnonzero(x[:, 0] > 0)
                mean, at, first = (x[read, 1:] / x[read, :1]).astype(np.float32), part + PARTS * read, 0
                for into in (model.params, squares):
                    for k in own:
                        n = 1 if into[k].ndim == 1 else model.dim
                        into[k][at] = mean[:, first] if n == 1 else mean[:, first : first + n]
                        first += n
        sent.unpersist()
    return model


def scored(documents: DataFrame, head: int = HEAD, most: int | None = None, learners: int | None = None, rounds: int = ROUNDS, **options) -> DataFrame:
    """A row for each document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the lower-cased (A-Z) words of the whole text and one end. Training documents are those whose
    crc32(doc_id as text) mod 10 is not 0 (a null id counts as the text None); every one of them is counted, and read in
    training. base_score is the smoothed unigram's log10 probability. score is the log-bilinear model's: the class and then
    the word given the words before it (the end token before the first), and, for a word outside the model's vocabulary,
    the smoothed share of that word among all such words, one share being left for words never seen: the probabilities
    of all next words add up to 1. The model depends on the documents alone, not on how they lie in partitions. A null or empty text is the end alone; repeated rows are scored each; an empty table
    gives no rows.
    """
    spark = documents.sparkSession
    counts = stored(word_counts(documents), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # The most frequent words by whole steps of the logarithm of their counts: `head` rows at most go to every task.
    step = F.floor(F.log("n") * 64).cast("int")
    least, room = 1 << 20, head
    for at, n in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if n > room:
            break
        least, room = at, room - n
    known = {bytes(r["word"]): r["n"] for r in counts.where(step >= least).collect()}
    if END not in known:  # it is not among the head's words, or there is no training document
        known |= {bytes(r["word"]): r["n"] for r in counts.where(F.col("word") == F.lit(END)).collect()}
    vocabulary = Vocabulary(known, total, distinct, most or max(MODEL, int(GROWTH * total**0.5)))
    learners = learners or max(1, round((total / EACH) ** 0.5))
    rounds = rounds if learners > 1 else 1
    rows = encoded(documents, vocabulary, learners, rounds)
    model = trained(rows, vocabulary, total, learners, rounds, **options)
    base_floor, rest_floor = np.log10(total + SMOOTH * (distinct + 1)), np.log10(vocabulary.rest + SMOOTH * (vocabulary.kinds + 1))
    sent = spark.sparkContext.broadcast((vocabulary, model))

    def begun(batches):
        v, m = sent.value
        for batch in batches:
            at, sizes = numbers_of(batch.column(3))
            ends = np.cumsum(sizes)
            cuts = np.flatnonzero(np.diff((ends - sizes) // SCORED, prepend=-1)).tolist() + [batch.num_rows]
            for first, last in zip(cuts, cuts[1:]):
                yield part(v, m, batch.slice(first, last - first), at[ends[first] - sizes[first] : ends[last - 1]], sizes[first:last])

    def part(v, m, batch, at, sizes):
        starts = np.cumsum(sizes) - sizes
        ids = v.model_ids[at]
        before = np.concatenate([before_each(x, m.context, v.end) for x in np.split(ids, starts[1:])], 1)
        logs = np.concatenate([m.scores(before[:, i : i + SCORED], ids[i : i + SCORED]) for i in range(0, len(ids), SCORED)]) / np.log(10)
        logs = logs + np.where(ids == v.other, v.logs[at] - rest_floor, 0.0)
        columns = [sizes, *(np.add.reduceat(x, starts) for x in (v.seen[at].astype(np.int64), v.logs[at] - base_floor, logs))]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, columns)], [*batch.schema.names[:3], "n_tokens", "known", "base", "model"])

    fields = f"doc_id {dict(documents.dtypes)['doc_id']}, held_out boolean, row bigint, n_tokens bigint, known bigint, base double, model double"
    first = rows.select("doc_id", "held_out", "row", "ids").mapInArrow(begun, fields)
    tail = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    # A word is one row of the counts, so a partition's share of them fits a hash table; sorting the words would cost more than the rest.
    rare = counts.where((step < least) & (F.col("word") != F.lit(END))).withColumnRenamed("word", "w").hint("shuffle_hash")
    tail = tail.join(rare, F.col("word") == F.col("w"), "left")
    gain = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)
    more = tail.groupBy(F.col("row").alias("r")).agg(F.sum(gain).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("found"))
    joined = first.join(more, F.col("row") == F.col("r"), "left")
    added = F.coalesce("more", F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"), (F.col("base") + added).alias("base_score"), (F.col("model") + added).alias("score"),
    )


def op8_log_bilinear(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
