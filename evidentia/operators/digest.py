"""Digests of long texts: chunks are summarised by a provider and their notes merged in a tree, or read one after another."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.providers import Summariser, called
from ..sources.shared import stored
from .selection import pruned

#: What a provider says of a chunk that holds nothing of interest.
NOTHING = "NONE"


def cut_to(rows: DataFrame, ids: list[str], text: str, query: str, budget: int) -> DataFrame:
    """rows with a text of over `budget` characters pruned by the scores of its paragraphs."""
    if rows.where(F.length(text) > budget).isEmpty():
        return rows
    named = rows.withColumn("__id", F.to_json(F.struct(*ids)))
    short = pruned(named.where(F.length(text) > budget), "__id", text, query, budget).select(F.col("__id").alias("__of"), F.left("text", F.lit(budget)).alias("__short"))
    both = named.join(short, F.col("__id") == F.col("__of"), "left")
    return both.withColumn(text, F.coalesce("__short", text)).drop("__id", "__of", "__short")


def noted(rows: DataFrame, ids: list[str], text: str, asked: Column, summarise: Summariser, query: str, fill: int) -> DataFrame:
    """rows with `note` and `called`: what the provider makes of the texts that are asked for; empty where it finds nothing
    in them. A text for which it fails, and one that is not asked for, gives way to an extract of `fill` characters."""
    given = called(rows.where(asked), text, summarise, "note").withColumn("called", F.lit(1))
    rest = rows.where(~asked).withColumn("note", F.lit(None).cast("string")).withColumn("called", F.lit(0))
    both = stored(given.unionByName(rest).withColumn("note", F.trim("note")), "notes")
    fine = both.where("note is not null").withColumn("note", F.when(F.upper("note") == NOTHING, "").otherwise(F.col("note")))
    extract = cut_to(both.where("note is null").withColumn("note", F.col(text)), ids, "note", query, fill)
    return fine.unionByName(extract.select(*fine.columns))


def digested(items: DataFrame, key: str, text: str, query: str, summarise: Summariser, budget: int = 4000, size: int = 3500, most_chunks: int | None = 16, fan: int = 8, fill: int = 400, separator: str = "\n\n") -> DataFrame:
    """(key, text, n_chunks, n_called, n_merged): each item's text as notes of all its chunks, within the budget.

    Chunks, not items, are spread over the tasks. The provider is asked for the first most_chunks of an item (None: all);
    the others, and those for which it fails, are filled by an extract of their best paragraphs for the query. Notes meet
    in a tree of `fan` at a time: where what meets is over the budget, the provider makes one note of it, and where that
    fails or is still too long, it is pruned by its paragraphs' scores. So a task never holds more than `fan` budgets of
    an item, and what is left is within the budget. n_called counts the calls for chunks, n_merged those of the levels
    above. A null or empty text has no chunks and an empty digest.
    """
    parts = items.select(key, F.coalesce(F.col(query), F.lit("")).alias("query"), F.posexplode(X.chunks(text, size, separator)).alias("pos", "chunk"))
    asked = F.lit(True) if most_chunks is None else F.col("pos") < most_chunks
    rows = noted(parts, [key, "pos"], "chunk", asked, summarise, "query", fill)
    counts = [rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("called").cast("bigint").alias("n_called"))]
    rows = rows.select(key, "query", "pos", "note")
    merged = None
    while True:
        own = F.array_sort(F.collect_list(F.when(F.col("note") != "", F.struct("pos", "note"))))
        joined = rows.groupBy(key, F.expr(f"cast(pos div {fan} as int)").alias("at")).agg(F.first("query").alias("query"), own.alias("xs"))
        joined = joined.select(key, "query", F.col("at").alias("pos"), F.array_join(F.transform("xs", lambda x: x["note"]), "\n").alias("joined"))
        long = F.length("joined") > budget
        over = noted(joined.where(long), [key, "pos"], "joined", F.lit(True), summarise, "query", budget)
        over = cut_to(over, [key, "pos"], "note", "query", budget)
        rows = stored(over.select(key, "query", "pos", "note", "called").unionByName(joined.where(~long).select(key, "query", "pos", F.col("joined").alias("note"), F.lit(0).alias("called"))), "level")
        calls = rows.groupBy(key).agg(F.sum("called").alias("n"))
        merged = calls if merged is None else merged.unionByName(calls)
        if not rows.where("pos > 0").limit(1).count():
            break
    total = merged.groupBy(F.col(key).alias("__m")).agg(F.sum("n").cast("bigint").alias("n_merged"))
    last = rows.select(F.col(key).alias("__n"), "note")
    out = items.select(key).join(counts[0].withColumnRenamed(key, "__c"), F.col(key) == F.col("__c"), "left").join(total, F.col(key) == F.col("__m"), "left").join(last, F.col(key) == F.col("__n"), "left")
    none = F.lit(0).cast("bigint")
    return out.select(key, F.coalesce("note", F.lit("")).alias("text"), *[F.coalesce(c, none).alias(c) for c in ("n_chunks", "n_called", "n_merged")])


def refined(items: DataFrame, key: str, text: str, query: str, refine, budget: int = 4000, size: int = 3500, most_chunks: int | None = 16, separator: str = "\n\n") -> DataFrame:
    """(key, text): one note for each item, carried through its chunks in order by refine(note, chunk).

    A chunk in which it finds nothing leaves the note as it is; one for which it fails ends the reading. How many chunks
    were not read, of these and of more than most_chunks (None: no such bound), is added to the note; an item of which
    nothing was read gives way to an extract. Notes over the budget are pruned.
    """

    def fold(batches):
        for batch in batches:
            notes, missing = [], []
            for chunks in batch.column(1).to_pylist():
                note, read = "", 0
                for chunk in (chunks or [])[:most_chunks]:
                    try:
                        found = (refine(note, chunk) or "").strip()
                    except Exception:  # noqa: BLE001  whatever a provider raises: the notes so far stand
                        break
                    note = note if found.upper() in ("", NOTHING) else found
                    read += 1
                notes.append(note)
                missing.append(len(chunks or []) - read)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(notes, pa.string()), pa.array(missing, pa.int32())], [key, "note", "unread"])

    kind = dict(items.dtypes)[key]
    read = items.select(key, X.chunks(text, size, separator).alias("chunks")).mapInArrow(fold, f"{key} {kind}, note string, unread int")
    both = stored(read.join(items.select(F.col(key).alias("__key"), F.col(text).alias("__whole"), F.coalesce(F.col(query), F.lit("")).alias("query")), F.col(key) == F.col("__key")), "read")
    mark = F.when(F.col("unread") > 0, F.concat(F.lit("\n["), "unread", F.lit(" unread]"))).otherwise("")
    said = F.when(F.col("note") == "", F.coalesce("__whole", F.lit(""))).otherwise(F.concat("note", mark))
    return cut_to(both.select(key, "query", said.alias("text")), [key], "text", "query", budget).select(key, "text")
