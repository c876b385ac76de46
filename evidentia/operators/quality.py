"""Checks of drafts: defects by rule, gaps against the question, assertions of probes, and whether a revision stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# What a whole answer ends with, what may stand after its end, the signs that may repeat without being a
# defect, the signs of lines that only divide, and citations.
CLOSED = r"[.!?。\)\]]$|[다요음임함]$|[:：]$"
TRAILING = "[\\s*_`~\"'“”‘’]+$"
RUN = r"([^-=*_~#\s])\1{19,}"
RULE_LINE = r"^[\s>*_=~#-]+$"
CITATION = r"\[([0-9]{1,2})\]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def repeated_lines(texts: DataFrame, key: str, text: str, least_chars: int = 12, signs: str = RULE_LINE) -> DataFrame:
    """(key, most): how often the most frequent line of a text stands in it; lines of least_chars or fewer characters
    and lines of signs alone do not count. Lines are counted by their hash and partially aggregated."""
    lines = texts.select(key, F.explode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line")).select(key, stripped(F.col("line")).alias("line"))
    kept = lines.where((F.length("line") > least_chars) & ~F.col("line").rlike(signs))
    return kept.groupBy(key, F.md5("line").alias("line")).agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.max("n").alias("most"))


def most_repeated(text: Column, least_chars: int = 12, signs: str = RULE_LINE) -> Column:
    """As repeated_lines, for a draft of ordinary length, inside its row."""
    lines = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: (F.length(x) > least_chars) & ~x.rlike(signs))
    run = lambda s, x: F.when(x == s["line"], F.struct(x.alias("line"), (s["n"] + 1).alias("n"), F.greatest(s["most"], s["n"] + 1).alias("most"))).otherwise(F.struct(x.alias("line"), F.lit(1).alias("n"), F.greatest(s["most"], F.lit(1)).alias("most")))
    return F.aggregate(F.array_sort(lines), F.struct(F.lit("").alias("line"), F.lit(0).alias("n"), F.lit(0).alias("most")), run, lambda s: s["most"])


def cited_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda x: x.cast("int"))


def invented(text: Column, n_evidence: Column) -> Column:
    """The sorted different citation numbers of a text that no piece of evidence has."""
    return F.array_sort(F.array_distinct(F.filter(cited_numbers(text), lambda n: (n < 1) | (n > n_evidence))))


def defects(draft: Column, question: Column, n_evidence: Column, deflection: str, script: str = "[가-힣]", closed: str = CLOSED) -> Column:
    """The defects of a draft, in order: empty (alone), short, open, run, repeat, script, citation, deflect."""
    text = stripped(F.coalesce(draft, F.lit("")))
    bare = F.regexp_replace(text, TRAILING, "")
    asked = F.regexp_count(F.coalesce(question, F.lit("")), F.lit(script)) >= 3
    few = asked & (F.regexp_count(text, F.lit(script)) < F.greatest(F.lit(5), F.floor(F.length(text) / 20).cast("int")))
    flags = [
        F.when(F.length(text) < 40, "short"),
        F.when(~bare.rlike(closed), "open"),
        F.when(text.rlike(RUN), "run"),
        F.when(most_repeated(text) >= 3, "repeat"),
        F.when(few, "script"),
        F.when(F.size(invented(text, n_evidence)) > 0, "citation"),
        F.when(text.rlike(deflection) & (F.length(text) < 300) & (F.length(F.regexp_replace(text, deflection, "")) < 150), "deflect"),
    ]
    return F.when(text == "", F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*flags)))


def gaps(question: Column, answer: Column, asks: str = "[?？]") -> Column:
    """What an answer leaves open: `terms` (under half of the question's content words), `depth` (two questions or more,
    answered in under 250 characters each)."""
    q, a = X.review_tokens(question), X.review_tokens(answer)
    n = F.regexp_count(F.coalesce(question, F.lit("")), F.lit(asks))
    terms = F.when((F.size(q) > 0) & (F.size(F.array_intersect(q, a)) < 0.5 * F.size(q)), "terms")
    return F.array_compact(F.array(terms, F.when((n >= 2) & (F.length(F.coalesce(answer, F.lit(""))) < 250 * n), "depth")))


def missing_terms(question: Column, answer: Column) -> Column:
    return F.array_except(X.review_tokens(question), X.review_tokens(answer))


def probe(text: Column, kind: str, want) -> Column:
    """Whether a text passes a check of one of the nine kinds."""
    first = F.regexp_extract(text, r"(?s)^(.*?)(?:[.!?。]\s|\n|$)", 1)
    any_of = lambda c, ws: F.greatest(F.lit(False), *[F.contains(c, F.lit(w)) for w in ws])
    if kind.startswith("contains_any"):
        return any_of(text, want)
    if kind == "contains_all":
        return F.least(F.lit(True), *[F.contains(text, F.lit(w)) for w in want])
    if kind == "not_contains":
        return ~any_of(text, want)
    if kind == "not_match":
        return ~text.rlike(want)
    if kind == "first_sentence_contains":
        return any_of(first, want)
    if kind == "max_question_marks":
        return F.regexp_count(text, F.lit("[?？]")) <= want
    if kind == "max_script_chars":
        return F.regexp_count(text, F.lit("[가-힣]")) <= want
    if kind == "min_chars":
        return F.length(text) >= want
    if kind == "max_chars":
        return F.length(text) <= want
    raise ValueError(f"no check of kind {kind}")


def probed(texts: DataFrame, key: str, text: str, checks: list[tuple[str, object]]) -> DataFrame:
    """(key, passed, failed): whether a text passes every check, and the failed ones in order."""
    failed = F.array_compact(F.array(*[F.when(~probe(F.col(text), k, w), F.lit(k)) for k, w in checks]))
    return texts.select(key, failed.alias("failed")).select(key, (F.size("failed") == 0).alias("passed"), F.array_join("failed", ",").alias("failed"))


def decision(draft: Column, final: Column, verdict: Column, finish: Column, final_defects: Column, most: int = 12_000) -> Column:
    """(accepted, reason, text): a revision stands if it parses, is whole, says so, is not empty, has at least half of the
    draft's length and no defect; else the draft stays, cut safely. Tagged blocks of both go first."""
    old, new = X.without_blocks(draft), X.without_blocks(final)
    reason = (
        F.when(verdict.isNull(), "unparsed").when(finish == "length", "cut").when(verdict != "revise", "kept")
        .when(new == "", "empty").when(F.length(new) < F.floor(F.length(old) / 2), "short").when(F.size(final_defects) > 0, "defects")
    )
    return F.struct(reason.isNull().alias("accepted"), F.coalesce(reason, F.lit("revised")).alias("reason"), F.when(reason.isNull(), new).otherwise(X.safe_cut(old, most)).alias("text"))


def rewrites(items: Column, strict: list[str], least: float = 0.7) -> Column:
    """Whether a critique(item, confidence) array asks for a rewrite: a strict item, or any of enough confidence."""
    return F.exists(items, lambda x: x["item"].isin(*strict) | (x["confidence"] >= least))


def converged(rounds: DataFrame, key: str, order: str, count: str) -> DataFrame:
    """rounds with `stop`: no violations are left, or no fewer than the round before."""
    from pyspark.sql.window import Window

    before = F.lag(count).over(Window.partitionBy(key).orderBy(order))
    return rounds.withColumn("stop", (F.col(count) == 0) | F.coalesce(F.col(count) >= before, F.lit(False)))
