"""Hosted models and remote tools as small interfaces, with offline stand-ins that are deterministic."""

from __future__ import annotations

import re
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import tokens
from .shared import stored


class Summariser(Protocol):
    def __call__(self, text: str) -> str | None: ...


class Judge(Protocol):
    def __call__(self, text: str) -> bool | None: ...


class DocSource(Protocol):
    def candidates(self, queries: DataFrame, k: int) -> DataFrame: ...


def called(rows: DataFrame, column: str, provider, name: str, kind: str = "string") -> DataFrame:
    """rows with `name`: provider(value of column), null where it fails. Rows go in Arrow batches; a failed call never
    fails the task."""
    at = rows.columns.index(column)
    arrow = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[kind]

    def asked(value):
        try:
            return provider(value)
        except Exception:  # noqa: BLE001  whatever a provider raises: the caller's fallback stands in
            return None

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(asked, batch.column(at).to_pylist()), arrow)], [*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, {"string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType()}[kind])]))


def first_sentence(text: str | None, most: int = 200) -> str:
    """An offline summariser."""
    return re.split(r"(?<=[.!?])\s", (text or "").strip(), maxsplit=1)[0][:most]


class ToolProvider(Protocol):
    def answers(self, calls: DataFrame) -> DataFrame: ...


class TableTools:
    """Recorded answers, (tool, key, payload, is_error), as a tool server."""

    def __init__(self, recorded: DataFrame):
        self.recorded = recorded

    def answers(self, calls: DataFrame) -> DataFrame:
        """calls(tool, key) with `payload`: the recorded answer; null where there is none or it is an error, which must
        never become evidence. Of several recordings of a call the least payload counts."""
        good = self.recorded.where(~F.coalesce("is_error", F.lit(False))).groupBy(F.col("tool").alias("__tool"), F.col("key").alias("__key")).agg(F.min("payload").alias("payload"))
        return calls.join(good, (F.col("tool") == F.col("__tool")) & (F.col("key") == F.col("__key")), "left").drop("__tool", "__key")


class TableSource:
    """Documents of a table, docs(title, text), as a search service."""

    def __init__(self, docs: DataFrame):
        self.docs = docs

    def candidates(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, place, title, text) of the k documents that share most scoring tokens with each query, ties by title.

        An inverted index with document frequencies: a query lists the documents of its rarest tokens only, twice as many
        tokens in each round, and counts for those documents how many of its tokens they share. A document that is not
        listed shares none of the r tokens listed so far, so at most all but r: as soon as k documents share more than
        that, the query is done. Words that nearly all documents hold are looked up in documents, and never list them.
        """
        titles = stored(self.docs.select("title", tokens("text").alias("own")), "titles")
        index = titles.select("title", F.explode("own").alias("w"))
        df = index.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
        asked = queries.select("query").distinct().select("query", F.xxhash64("query").alias("id"), tokens("query").alias("q"))
        terms = asked.select("id", F.explode("q").alias("w")).join(df, "w")
        # Tokens that no document holds list nothing and are shared by none.
        ranked = terms.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ws"))
        left = stored(ranked.select("id", F.transform("ws", lambda x: x["w"]).alias("ws")), "asked")
        index, done, rounds = stored(index, "index"), None, 1
        while True:
            listed = left.select("id", "ws", F.explode(F.slice("ws", 1, rounds)).alias("w"))
            pairs = listed.select("id", "w").join(index, "w").select("id", "title").distinct()
            shared = F.size(F.array_intersect("own", "ws")).alias("n")
            counted = pairs.join(titles, "title").join(left, "id").select("id", "title", shared)
            place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "title"))
            best = stored(counted.withColumn("place", place).where(F.col("place") <= k), "best")
            worst = best.groupBy("id").agg(F.count(F.lit(1)).alias("n_found"), F.min("n").alias("least"))
            state = left.join(worst, "id", "left")
            sure = (F.size("ws") <= rounds) | ((F.col("n_found") >= k) & (F.col("least") > F.size("ws") - rounds))
            state = stored(state.select("id", "ws", F.coalesce(sure, F.lit(False)).alias("sure")), "state")
            fine = best.join(state.where("sure").select("id"), "id", "left_semi")
            done = fine if done is None else done.unionByName(fine)
            left, rounds = state.where("not sure").select("id", "ws"), 2 * rounds
            if left.isEmpty():
                break
        named = asked.select("id", "query")
        return done.join(named, "id").join(self.docs.select("title", "text"), "title").select("query", "place", "title", "text")
