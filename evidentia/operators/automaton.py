"""Finding the names of a dictionary table in texts: a multi-pattern automaton in flat arrays, run over Arrow batches."""

from __future__ import annotations

from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normal_key
from ..sources.shared import stored
from .ranks import running_sum

#: Characters of the names of one automaton: a larger dictionary is split in the order of its names. It bounds what is
#: broadcast: some 30 bytes for each character, and the dense rows.
MOST_CHARACTERS = 1 << 21
#: Entries of the dense rows (of the states nearest to the start), chunks of a batch that are read side by side, and
#: characters of texts that are read at once.
DENSE, WIDE, AT_ONCE = 1 << 22, 4096, 1 << 22

#: classes: of each code point, 0 for those that no name has. dense: next state by state and class. edges, to: sorted
#: (state, class) pairs and where they lead. fail: the longest proper suffix that is a state. name: which name ends here,
#: or -1. shorter: the nearest suffix in which a name ends, or 0. lengths: of the names; longest: of all.
Automaton = namedtuple("Automaton", "classes kinds dense edges to fail name shorter lengths longest")


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def built(names: list[str]) -> Automaton:
    """The automaton of different, non-empty names. States are numbered level by level, and within a level by their parent
    and character, so the edges of all levels together are sorted as they are made."""
    lengths = np.array([len(n) for n in names], np.int64)
    whole = codes("".join(names))
    alphabet = np.unique(whole)
    kinds = len(alphabet) + 1
    classes = np.zeros(0x110000, np.int32)
    classes[alphabet] = np.arange(1, kinds)
    signs, starts = classes[whole].astype(np.int64), np.cumsum(lengths) - lengths

    at = np.zeros(len(names), np.int64)  # the state that each name has reached
    edges, to, levels, states = [], [], [], 1
    ends = np.full(len(names), -1, np.int64)
    for depth in range(int(lengths.max(initial=0))):
        on = np.flatnonzero(lengths > depth)
        keys, which = np.unique(at[on] * kinds + signs[starts[on] + depth], return_inverse=True)
        own = np.arange(states, states + len(keys))
        at[on] = own[which]
        edges.append(keys)
        to.append(own)
        levels.append((states, states + len(keys)))
        states += len(keys)
        done = on[lengths[on] == depth + 1]
        ends[done] = at[done]
    edges, to = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edges, to))

    name = np.full(states, -1, np.int64)
    name[ends] = np.arange(len(names))
    parent, sign = np.zeros(states, np.int64), np.zeros(states, np.int64)
    parent[to], sign[to] = edges // kinds, edges % kinds
    fail, shorter = np.zeros(states, np.int64), np.zeros(states, np.int64)
    n_dense = min(states, max(1, DENSE // kinds))
    dense = np.zeros((n_dense, kinds), np.int64)
    out = Automaton(classes, kinds, dense, edges, to, fail, name, shorter, lengths, int(lengths.max(initial=0)))
    for low, high in [(0, 1), *levels]:
        own = np.arange(low, high)
        if low > 1:
            deep = own[parent[own] > 0]
            fail[deep] = moved(out, fail[parent[deep]], sign[deep])
        shorter[own] = np.where(name[fail[own]] >= 0, fail[own], shorter[fail[own]])
        shorter[own[fail[own] == own]] = 0
        rows = own[own < n_dense]
        dense[rows] = dense[fail[rows]]
        first, last = np.searchsorted(edges, [low * kinds, min(high, n_dense) * kinds])
        dense[parent[to[first:last]], sign[to[first:last]]] = to[first:last]
    return out


def moved(a: Automaton, state: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """The states that follow, all at once: deep ones go by their edges or fall back until a dense row answers."""
    state = state.copy()
    out = np.zeros(len(state), np.int64)
    open_ = np.arange(len(state))
    while len(open_):
        near = state[open_] < len(a.dense)
        now = open_[near]
        out[now] = a.dense[state[now], sign[now]]
        open_ = open_[~near]
        if len(open_):
            keys = state[open_] * a.kinds + sign[open_]
            place = np.minimum(np.searchsorted(a.edges, keys), len(a.edges) - 1)
            leads = a.edges[place] == keys
            out[open_[leads]] = a.to[place[leads]]
            open_ = open_[~leads]
            state[open_] = a.fail[state[open_]]
    return out


def hits(a: Automaton, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, end) of every place where a name ends in a run of character classes, overlapping ones too.

    The run is cut into chunks that are read side by side, each from as far before its start as the longest name reaches.
    """
    if not len(signs) or not a.longest:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead = a.longest - 1
    size = max(64, 2 * lead, -(-len(signs) // WIDE))
    n = -(-len(signs) // size)
    padded = np.concatenate([np.zeros(lead, signs.dtype), signs, np.zeros(n * size - len(signs), signs.dtype)])
    begins, state = np.arange(n) * size, np.zeros(n, np.int64)
    names, ends = [], []
    for step in range(lead + size):
        state = moved(a, state, padded[begins + step])
        if step < lead:
            continue
        chunk = np.flatnonzero((a.name[state] >= 0) | (a.shorter[state] > 0))
        at = state[chunk]
        while len(chunk):
            here = a.name[at] >= 0
            names.append(a.name[at[here]])
            ends.append(begins[chunk[here]] + step - lead + 1)
            at = a.shorter[at]
            chunk, at = chunk[at > 0], at[at > 0]
    if not names:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(names), np.concatenate(ends)


def found_in(a: Automaton, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, name, start) of all names in some texts."""
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    starts = np.cumsum(sizes) - sizes
    signs = a.classes[codes("\0".join(texts) + "\0")].astype(np.int64)
    signs[starts + sizes - 1] = 0  # no name reaches from a text into the next
    names, ends = hits(a, signs)
    begin = ends - a.lengths[names]
    row = np.searchsorted(starts, begin, "right") - 1
    return row, names, begin - starts[row]


def leftmost_longest(row: np.ndarray, name: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which hits stand if, from the left on, the longest at a place is taken and what overlaps it is left out."""
    order = np.lexsort((-lengths[name], start, row))
    kept, last, until = [], -1, 0
    for i, r, s, n in zip(order.tolist(), row[order].tolist(), start[order].tolist(), lengths[name[order]].tolist()):
        if r != last:
            last, until = r, 0
        if s >= until:
            kept.append(i)
            until = s + n
    return np.array(kept, np.int64)


def grouped(batch: pa.RecordBatch, column: int, most: int):
    """Slices of an Arrow batch whose texts have about `most` characters together."""
    sizes = np.array([len(t or "") for t in batch.column(column).to_pylist()], np.int64)
    slot = (np.cumsum(sizes) - sizes) // most
    cuts = np.flatnonzero(np.diff(slot, prepend=-1)).tolist() + [batch.num_rows]
    for x, y in zip(cuts, cuts[1:]):
        yield batch.slice(x, y - x)


def names_in(texts: DataFrame, key: str, text: str, dictionary: DataFrame, name: str, least: int = 2, keep: str = "all") -> DataFrame:
    """(key, name, start): where the names of a dictionary table, of `least` characters or more, stand in texts, both without
    case, spaces and middle dots; start counts the characters of the text so normalised.

    keep: `all` hits, overlapping ones too; the `longest`, from the left on, without overlap; or each of a text's `names`
    once, at its first place. Null texts and names hold nothing, names that are equal once normalised are one.

    The dictionary is dealt into automata of at most MOST_CHARACTERS in the order of its names, so that those of one share
    their first characters; one after the other is built, broadcast and run over the texts, so their number, and not
    their size, grows with the dictionary. With `longest`, the longest at each place of several automata meet by text.
    """
    bare = normal_key(name, r"(?!)")
    known = dictionary.select(bare.alias("name")).where(F.length("name") >= max(1, least)).distinct()
    total, n = known.agg(F.sum(F.length("name")), F.count(F.lit(1))).first()
    shape = T.StructType([texts.schema[key], T.StructField("name", T.StringType()), T.StructField("start", T.LongType())])
    rows = texts.select(key, normal_key(text, r"(?!)").alias("__text"))
    if not n:
        return texts.sparkSession.createDataFrame([], shape)
    parts = -(-total // MOST_CHARACTERS)
    if parts > 1:
        upto = running_sum(known.withColumn("whole", F.lit(0)), ["whole"], [F.col("name")], F.length("name"), "upto")
        known = stored(upto.select("name", F.expr(f"(upto - 1) div {MOST_CHARACTERS}L").alias("part")), "dictionary")
    out = None
    for part in range(parts):
        own = known.where(F.col("part") == part) if parts > 1 else known
        done = scanned(rows, [r["name"] for r in own.select("name").collect()], shape, "starts" if keep == "longest" and parts > 1 else keep)
        out = done if out is None else out.unionByName(done)
    if parts > 1 and keep == "longest":
        out = longest_of(out, key)
    return out


def scanned(rows: DataFrame, names: list[str], shape: T.StructType, keep: str) -> DataFrame:
    """The hits of at most MOST_CHARACTERS of names in rows(key, text); with `starts`, the longest at each place."""
    names = sorted(names)
    sent = rows.sparkSession.sparkContext.broadcast((built(names), pa.array(names, pa.string()))) if names else None

    def scan(batches):
        if sent is None:
            return
        automaton, spelled = sent.value
        for batch in batches:
            for few in grouped(batch, 1, AT_ONCE):
                row, name, start = found_in(automaton, [t or "" for t in few.column(1).to_pylist()])
                if keep == "longest":
                    kept = leftmost_longest(row, name, start, automaton.lengths)
                elif keep in ("names", "starts"):
                    by = name if keep == "names" else start
                    order = np.lexsort((start if keep == "names" else -automaton.lengths[name], by, row))
                    new = np.ones(len(order), bool)
                    new[1:] = (np.diff(row[order]) != 0) | (np.diff(by[order]) != 0)
                    kept = order[new]
                else:
                    kept = np.lexsort((name, start, row))
                yield pa.RecordBatch.from_arrays([few.column(0).take(pa.array(row[kept])), spelled.take(pa.array(name[kept])), pa.array(start[kept])], shape.names)

    return rows.mapInArrow(scan, shape)


def longest_of(found: DataFrame, key: str) -> DataFrame:
    """The leftmost longest of what several automata have found: at most one hit of each for a character of the text."""

    def choose(table: pa.Table) -> pa.Table:
        name, start = table.column("name").to_pylist(), table.column("start").to_numpy()
        lengths = np.array([len(n) for n in name], np.int64)
        kept = leftmost_longest(np.zeros(len(name), np.int64), np.arange(len(name)), start, lengths)
        return table.take(pa.array(kept))

    return found.groupBy(key).applyInArrow(choose, found.schema)
