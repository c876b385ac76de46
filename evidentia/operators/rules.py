"""Rule packs over texts: ordered patterns, pairs, votes and decision lists.

A pack is data: a list of (category, [patterns]) in order. Packs of the registry are written for the provided tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Pack = list[tuple[str, list[str]]]


def checked(pack: Pack, categories: set[str] | None = None) -> Pack:
    """The pack without patterns that do not compile and without unknown categories."""

    def compiles(p: str) -> bool:
        try:
            re.compile(p)
        except re.error:
            return False
        return True

    return [(c, [p for p in ps if compiles(p)]) for c, ps in pack if categories is None or c in categories]


def laid_over(seed: Pack, own: Pack) -> Pack:
    """The seed's categories in its order, each replaced where own has it, then own's further ones."""
    new = dict(own)
    return [(c, new.pop(c, ps)) for c, ps in seed] + [(c, ps) for c, ps in own if c in new]


def first_match(text: Column, pack: Pack) -> Column:
    """(category, pattern, matched) of the first pattern in the pack's order that a text holds, or null.

    One alternation of all patterns goes first, so that most texts are scanned once.
    """
    flat = [(c, p) for c, ps in pack for p in ps]
    hit = F.lit(None).cast("struct<category:string,pattern:string,matched:string>")
    for c, p in reversed(flat):
        found = F.struct(F.lit(c).alias("category"), F.lit(p).alias("pattern"), F.regexp_extract(text, p, 0).alias("matched"))
        hit = F.when(text.rlike(p), found).otherwise(hit)
    return F.when(text.rlike("|".join(f"(?:{p})" for _, p in flat)), hit) if flat else hit


def any_of(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def urgent(text: Column, solo: list[str], pairs: list[tuple[str, str]]) -> Column:
    """Any solo pattern, or both sides of any pair."""
    out = any_of(text, solo)
    for a, b in pairs:
        out = out | (text.rlike(a) & text.rlike(b))
    return out


def votes(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns a text holds."""
    return sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))


def persona(text: Column, expert: list[str], lay: list[str]) -> Column:
    e, n = votes(text, expert), votes(text, lay)
    return F.when(e > n, "professional").when(n > 0, "lay").otherwise("unknown")


def decided(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The first rule that holds, in order."""
    out = F.lit(default).cast("string")
    for holds, says in reversed(rules):
        out = F.when(holds, says).otherwise(out)
    return out


def screened(text: Column, words: dict[str, list[str]]) -> Column:
    """The sorted kinds of which a text holds any word."""
    kinds = [F.when(F.greatest(*[F.contains(text, F.lit(w)).cast("int") for w in ws], F.lit(0)) > 0, F.lit(k)) for k, ws in sorted(words.items())]
    return F.array_compact(F.array(*kinds))


def coerced(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)
