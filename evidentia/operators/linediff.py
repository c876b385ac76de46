"""Line diffs of two runs: the shortest edit script of each changed pair of texts, as hunks with context, and patches applied."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Work (lines times edits) that one stretch between common lines may cost; a stretch beyond it is replaced as a whole.
MOST_WORK = 250_000


def lines_of(text: str | None) -> list[str]:
    """A text's lines; null is no line at all, an empty text is one empty line."""
    return [] if text is None else text.split("\n")


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of lines that stand once in either text, as long a series of them as keeps its order."""
    once = lambda x: {line: i for i, line in enumerate(x) if line not in repeated(x)}
    ones, twos = once(a), once(b)
    pairs = [(i, twos[line]) for line, i in ones.items() if line in twos]
    tails, ends, before = [], [], {}
    for i, j in pairs:
        k = bisect_left(tails, j)
        before[i, j] = ends[k - 1] if k else None
        tails[k : k + 1], ends[k : k + 1] = [j], [(i, j)]
    out, at = [], ends[-1] if ends else None
    while at:
        out.append(at)
        at = before[at]
    return out[::-1]


def repeated(x: list[str]) -> set[str]:
    seen, again = set(), set()
    for line in x:
        (again if line in seen else seen).add(line)
    return again


def shortest(a: list[str], b: list[str]) -> list[tuple[int, int]] | None:
    """The pairs of lines that the shortest edit script from a to b keeps, by greedy furthest paths; null if that would
    cost more than MOST_WORK."""
    n, m = len(a), len(b)
    reach, trail = {1: 0}, []
    for edits in range(n + m + 1):
        if edits * (edits + 1) // 2 + edits > MOST_WORK:
            return None
        trail.append(dict(reach))
        for k in range(-edits, edits + 1, 2):
            x = reach[k + 1] if k == -edits or (k != edits and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                return kept(trail, n, m, edits)
    return []


def kept(trail: list[dict[int, int]], x: int, y: int, edits: int) -> list[tuple[int, int]]:
    out = []
    for d in range(edits, -1, -1):
        reach, k = trail[d], x - y
        last = k + 1 if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else k - 1
        px = reach[last] if d else 0
        py = px - last if d else 0
        while x > px and y > py:
            x, y = x - 1, y - 1
            out.append((x, y))
        x, y = px, py
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The pairs of equal lines that a diff of a and b keeps, in order: the shortest script's. Where that is too dear, the
    texts are cut at lines that are unique in both, and a stretch that is too dear even so keeps nothing."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    inner = shortest(x, y) if x and y else []
    if inner is None:
        inner, i, j = [], 0, 0
        for p, q in [*anchors(x, y), (len(x), len(y))]:
            inner += [(i + s, j + t) for s, t in shortest(x[i:p], y[j:q]) or []]
            if p < len(x):
                inner.append((p, q))
            i, j = p + 1, q + 1
    ends = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    return [(i, i) for i in range(head)] + [(head + p, head + q) for p, q in inner] + ends


def hunks(a: list[str], b: list[str], context: int) -> list[dict]:
    """Runs of changes, those within twice the context of each other in one: where they start (from 1) in either text, how
    many lines they span, and the lines, each led by a blank, - or +."""
    changes, i, j = [], 0, 0
    for p, q in [*common(a, b), (len(a), len(b))]:
        if p > i or q > j:
            changes.append((i, p, j, q))
        i, j = p + 1, q + 1
    out = []
    for n, (i, p, j, q) in enumerate(changes):
        near = out and i - changes[n - 1][1] <= 2 * context
        if near:
            lines = out[-1]["lines"]
            lines += [" " + x for x in a[changes[n - 1][1] : i]]
        else:
            before = max(0, i - context)
            lines = [" " + x for x in a[before:i]]
            out.append({"old_start": before + 1, "new_start": j - (i - before) + 1, "lines": lines})
        lines += ["-" + x for x in a[i:p]] + ["+" + x for x in b[j:q]]
        following = changes[n + 1][0] if n + 1 < len(changes) else None
        if following is None or following - p > 2 * context:
            lines += [" " + x for x in a[p : p + context]]
    for h in out:
        h["old_lines"], h["new_lines"] = (sum(x[0] in signs for x in h["lines"]) for signs in (" -", " +"))
    return out


def applied(a: list[str], patch: list[dict]) -> list[str] | None:
    """What a patch makes of a text's lines; null where its context or what it removes is not there."""
    out, at = [], 0
    for h in patch:
        start = h["old_start"] - 1
        old = [x[1:] for x in h["lines"] if x[0] != "+"]
        if start < at or a[start : start + len(old)] != old:
            return None
        out += a[at:start] + [x[1:] for x in h["lines"] if x[0] != "-"]
        at = start + len(old)
    return out + a[at:]


HUNK = "array<struct<old_start:int,old_lines:int,new_start:int,new_lines:int,lines:array<string>>>"
ARROW = pa.list_(pa.struct([("old_start", pa.int32()), ("old_lines", pa.int32()), ("new_start", pa.int32()), ("new_lines", pa.int32()), ("lines", pa.list_(pa.string()))]))


def line_diffs(before: DataFrame, after: DataFrame, key: str, text: str, context: int = 3) -> DataFrame:
    """(key, n_removed, n_added, hunks) of the keys whose text differs between two runs, or that only one of them has.

    The runs meet by key in Spark, equal texts go no further, and each changed pair is compared in its row of an Arrow
    batch. A text that a run does not have (or that is null) has no lines. Keys are unique in a run; null ones are equal.
    """
    own, other = before.select(F.struct(key).alias("__a"), F.col(text).alias("old")), after.select(F.struct(key).alias("__b"), F.col(text).alias("new"))
    both = own.join(other, F.col("__a") == F.col("__b"), "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    rows = both.select(F.coalesce(f"__a.{key}", f"__b.{key}").alias(key), "old", "new")

    def compare(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                few = batch.slice(at, 64)
                found = [hunks(lines_of(x), lines_of(y), context) for x, y in zip(few.column(1).to_pylist(), few.column(2).to_pylist())]
                counts = [[sum(x[0] == sign for h in own for x in h["lines"]) for own in found] for sign in "-+"]
                yield pa.RecordBatch.from_arrays([few.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(found, ARROW)], [key, "n_removed", "n_added", "hunks"])

    return rows.mapInArrow(compare, f"{key} {dict(before.dtypes)[key]}, n_removed bigint, n_added bigint, hunks {HUNK}")


def patched(texts: DataFrame, key: str, text: str, diffs: DataFrame) -> DataFrame:
    """texts with `patched`: the text after the diff of its key (as it is without one); null where the diff does not fit."""
    own = diffs.select(F.struct(key).alias("__d"), "hunks")
    rows = texts.select(key, text, F.struct(key).alias("__t")).join(own, F.col("__t") == F.col("__d"), "left").select(key, text, "hunks")

    def apply(batches):
        for batch in batches:
            done = []
            for old, patch in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = lines_of(old) if patch is None else applied(lines_of(old), patch)
                done.append(None if lines is None or (not lines and patch is not None) else old if patch is None else "\n".join(lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.string())], [key, text, "patched"])

    return rows.mapInArrow(apply, f"{key} {dict(texts.dtypes)[key]}, {text} string, patched string")


def unified(found: DataFrame) -> DataFrame:
    """found with `patch`: its hunks as text."""
    head = lambda h: F.format_string("@@ -%d,%d +%d,%d @@", h["old_start"], h["old_lines"], h["new_start"], h["new_lines"])
    return found.withColumn("patch", F.array_join(F.transform("hunks", lambda h: F.concat_ws("\n", head(h), F.array_join(h["lines"], "\n"))), "\n"))
