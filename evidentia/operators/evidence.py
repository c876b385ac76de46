"""Evidence in semi-structured payloads: finding cited objects at any depth, rendering fields, salvaging JSON from text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

# Names of fields in payloads.
BODY_KEYS = ("content", "text", "body", "row", "snippet")
PLUMBING = {
    "cite_uid", "source_id", "tool_result_type", "layer", "url", "source_url", "source_type", "title", "doc_title",
    "relevance_score", "row_key", "case_id", "node_id", "doc_id", "provider", "ancestors", "range", "specialty", "doc_url",
    "source_version", "match_type", "is_headword", "revision",
}
CITE = re.compile(r"cite-[0-9a-f]{6,32}")


def parsed(payload: str | None):
    """A payload's value; one that is no JSON, or is nested deeper than the parser goes, is none and gives no evidence."""
    try:
        return json.loads(payload or "")
    except (ValueError, RecursionError):
        return None


def objects(value, strings: bool = False) -> Iterator[dict]:
    """Every object in a parsed payload, parents before children; with strings, also those in strings that hold JSON."""
    open_ = [iter([value])]
    while open_:
        for x in open_[-1]:
            if isinstance(x, str) and strings and x.lstrip()[:1] in ("{", "["):
                x = parsed(x)
            if isinstance(x, dict):
                yield x
            if isinstance(x, (dict, list)):
                open_.append(iter(x.values() if isinstance(x, dict) else x))
                break
        else:
            open_.pop()


def said(v) -> str:
    """A value as text: nested ones as JSON."""
    return json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v)


def fields_of(x: dict, most: int = 600) -> str:
    """An object's fields as lines, without those of plumbing, empty ones and nested ones of over `most` characters."""
    lines = []
    for k, v in x.items():
        if k in PLUMBING or v is None or v in ("", [], {}):
            continue
        if isinstance(v, (dict, list)):
            v = json.dumps(v, ensure_ascii=False)
            if len(v) > most:
                continue
        lines.append(f"{k}: {v}")
    return "\n".join(lines)


def pages_of(x: dict, numbered: bool) -> str:
    """The texts of an object's pages, and the paths of the charts on them."""
    parts = []
    for i, page in enumerate(x["pages"], 1):
        if isinstance(page, dict):
            text = said(page.get("text") or "")
            parts.append(f"[p.{page.get('page', i)}] {text}" if numbered and text else text)
            charts = page.get("charts") if isinstance(page.get("charts"), list) else []
            parts += [f"[flowchart] {path}" for chart in charts if isinstance(chart, dict) for path in chart.get("paths") or []]
    return "\n".join(filter(None, parts))


def body_of(x: dict, numbered: bool = False) -> str:
    """The text of an object's pages (numbered, if asked), else its first text field, else its other fields."""
    if isinstance(x.get("pages"), list) and (text := pages_of(x, numbered)):
        return text
    for k in BODY_KEYS:
        if v := x.get(k):
            return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return fields_of(x)


def cited_v1(payload: str | None) -> list[tuple[str, str]]:
    return [(x["cite_uid"], body_of(x)) for x in objects(parsed(payload)) if isinstance(x.get("cite_uid"), str) and x["cite_uid"]]


def cited_v2(payload: str | None, most: int = 4000) -> list[tuple[str, str]]:
    """As cited_v1, with page numbers and a head of title and url, cut."""
    out = []
    for x in objects(parsed(payload)):
        if isinstance(x.get("cite_uid"), str) and x["cite_uid"]:
            head = " ".join(said(x[k]) for k in ("title", "url") if x.get(k))
            out.append((x["cite_uid"], "\n".join(filter(None, (head, body_of(x, numbered=True))))[:most]))
    return out


def cited_v3(payload: str | None) -> list[tuple[str, str]]:
    """As cited_v1, also in strings that hold JSON; a payload without objects gives the ids that its text holds."""
    found = [(x["cite_uid"], body_of(x)) for x in objects(parsed(payload), strings=True) if isinstance(x.get("cite_uid"), str) and x["cite_uid"]]
    return found or [(c, "") for c in dict.fromkeys(CITE.findall(payload or ""))]


def entries_of(raw: Column) -> Column:
    """The fields of an object, or the items of an array, in their order: (key, raw, kind). raw is a string's own text or the
    JSON of anything else, null for null; kind is the type that a variant of it has."""
    texts, kinds = F.from_json(raw, "map<string,string>"), F.from_json(raw, "map<string,variant>")
    items, item_kinds = F.from_json(raw, "array<string>"), F.from_json(raw, "array<variant>")
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    fields = F.arrays_zip(F.map_keys(texts).alias("key"), F.map_values(texts).alias("raw"), F.transform(F.map_values(kinds), kind).alias("kind"))
    parts = F.arrays_zip(F.transform(items, lambda x: F.lit(None).cast("string")).alias("key"), items.alias("raw"), F.transform(item_kinds, kind).alias("kind"))
    return F.when(F.ltrim(raw).startswith("{"), fields).otherwise(parts)


def holds(x: Column) -> Column:
    """Whether an entry counts as filled: not null, empty, zero or false."""
    return x["raw"].isNotNull() & (x["raw"] != "") & ((x["kind"] == "STRING") | ~(x["raw"].isin("false", "[]", "{}") | x["raw"].rlike(r"^-?0(\.0*)?(E0)?$")))


def spaced(raw: Column) -> Column:
    """Compact JSON with a blank after each comma and colon that stands outside strings."""
    parts = F.regexp_extract_all(raw, F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++'), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith('"'), x).otherwise(F.replace(F.replace(x, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": ")))), "")


def named(entries: Column, key: str) -> Column:
    return F.get(F.filter(entries, lambda x: x["key"] == key), F.lit(0))


def shown(x: Column) -> Column:
    """An entry's value as text."""
    return F.when(x["kind"] == "STRING", x["raw"]).when(x["kind"] == "BOOLEAN", F.initcap(x["raw"])).when(x["kind"].rlike("^(OBJECT|ARRAY)"), spaced(x["raw"])).otherwise(x["raw"])


def body_column(entries: Column, numbered: bool, most: int = 600) -> Column:
    """body_of for an object's entries, as an expression."""

    def page_lines(x, i):
        own = entries_of(x["raw"])
        text = named(own, "text")
        said = F.when(holds(text), shown(text)).otherwise("")
        if numbered:
            said = F.when(said != "", F.concat(F.lit("[p."), F.coalesce(named(own, "page")["raw"], (i + 1).cast("string")), F.lit("] "), said)).otherwise("")
        charts = F.filter(entries_of(F.when(named(own, "charts")["kind"].startswith("ARRAY"), named(own, "charts")["raw"])), lambda c: c["kind"].startswith("OBJECT"))
        paths = F.flatten(F.transform(charts, lambda c: F.coalesce(F.from_json(named(entries_of(c["raw"]), "paths")["raw"], "array<string>"), F.array().cast("array<string>"))))
        lines = F.concat(F.array(said), F.coalesce(F.transform(paths, lambda p: F.concat(F.lit("[flowchart] "), p)), F.array().cast("array<string>")))
        return F.when(x["kind"].startswith("OBJECT"), F.array_join(F.filter(lines, lambda t: t != ""), "\n")).otherwise("")

    pages = named(entries, "pages")
    listed = F.transform(entries_of(F.when(pages["kind"].startswith("ARRAY"), pages["raw"])), page_lines)
    paged = F.nullif(F.array_join(F.filter(listed, lambda t: t != ""), "\n"), F.lit(""))
    first = [F.when(holds(named(entries, k)), F.when(named(entries, k)["kind"] == "STRING", named(entries, k)["raw"]).otherwise(spaced(named(entries, k)["raw"]))) for k in BODY_KEYS]
    nested = lambda x: x["kind"].rlike("^(OBJECT|ARRAY)")
    kept = F.filter(entries, lambda x: ~x["key"].isin(*PLUMBING) & x["raw"].isNotNull() & (x["raw"] != "") & ~(nested(x) & (x["raw"].isin("[]", "{}") | (F.length(spaced(x["raw"])) > most))))
    fields = F.array_join(F.transform(kept, lambda x: F.concat(x["key"], F.lit(": "), shown(x))), "\n")
    return F.coalesce(paged, *first, fields)


def head_column(entries: Column) -> Column:
    found = [F.when(holds(named(entries, k)), shown(named(entries, k))) for k in ("title", "url")]
    return F.concat_ws(" ", *found)


class Harvest(NamedTuple):
    """How payloads are read: with page numbers and a head of title and url, cut; also within strings that hold JSON, with
    the ids of a payload's text where it has no objects. `plain` is the same for one payload that is too deep for columns."""

    plain: Callable[[str | None], list[tuple[str, str]]]
    numbered: bool = False
    most: int | None = None
    strings: bool = False


HOW = {"v1": Harvest(cited_v1), "v2": Harvest(cited_v2, numbered=True, most=4000), "v3": Harvest(cited_v3, strings=True)}


def cited_objects(payloads: DataFrame, key: str, payload: str, how: Harvest, deepest: int) -> DataFrame:
    """(__key, at, cite_uid, body) of every cited object; `at` is its path of places, parents before what they hold.

    One round for each level: what is left of a level are the objects and arrays that can hold a citation. A payload that
    is no JSON, or repeats a key, holds none.
    """
    path = F.array().cast("array<int>")
    own = F.when(F.ltrim(F.col(payload)).rlike(r"^[\[{]") & F.try_parse_json(payload).isNotNull(), F.col(payload))
    left = payloads.select(F.col(key).alias("__key"), path.alias("at"), own.alias("raw")).where("raw is not null")
    cited, deep = [], None
    for _ in range(deepest):
        left = stored(left, "level")
        if left.isEmpty():
            break
        rows = left.withColumn("entries", entries_of(F.col("raw")))
        uid = named(F.col("entries"), "cite_uid")
        cited.append(rows.where(F.ltrim("raw").startswith("{") & (uid["kind"] == "STRING") & (uid["raw"] != "")).select("__key", "at", uid["raw"].alias("cite_uid"), "raw"))
        inner = rows.select("__key", "at", F.posexplode("entries").alias("pos", "x")).select("__key", F.concat("at", F.array("pos")).alias("at"), "x.raw", "x.kind")
        nested = F.col("kind").rlike("^(OBJECT|ARRAY)")
        if how.strings:
            nested = nested | ((F.col("kind") == "STRING") & F.ltrim("raw").rlike(r"^[\[{]") & F.try_parse_json("raw").isNotNull())
        # A key may be spelled with an escape where the text has not been parsed yet.
        left = inner.where(nested & (F.contains("raw", F.lit("cite_uid")) | F.contains("raw", F.lit("\\u")))).select("__key", "at", "raw")
    else:
        left = stored(left, "level")
        if not left.isEmpty():
            deep = deeper(left, how)
    none = payloads.sparkSession.createDataFrame([], f"__key {dict(payloads.dtypes)[key]}, at array<int>, cite_uid string, raw string")
    # The bodies of all levels at once: they are the larger part of the work.
    objects = reduce(DataFrame.unionByName, cited, none).withColumn("entries", entries_of(F.col("raw")))
    body = body_column(F.col("entries"), how.numbered)
    if how.numbered:
        body = F.array_join(F.filter(F.array(head_column(F.col("entries")), body), lambda x: x != ""), "\n")
    found = objects.select("__key", "at", "cite_uid", (body if how.most is None else F.left(body, F.lit(how.most))).alias("body"))
    return found if deep is None else found.unionByName(deep)


def deeper(left: DataFrame, how: Harvest) -> DataFrame:
    """What is nested deeper than rounds go: read value by value."""

    def rows(batches):
        for batch in batches:
            places, paths, cites, bodies = [], [], [], []
            for i, (at, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for n, (cite, body) in enumerate(how.plain(raw)):
                    places.append(i)
                    paths.append([*at, n])
                    cites.append(cite)
                    bodies.append(body)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array(paths, pa.list_(pa.int32())), pa.array(cites, pa.string()), pa.array(bodies, pa.string())], ["__key", "at", "cite_uid", "body"])

    return left.mapInArrow(rows, f"__key {dict(left.dtypes)['__key']}, at array<int>, cite_uid string, body string")


def harvested(payloads: DataFrame, key: str, payload: str, how: str = "v1", first: bool = False, blank: bool = False, deepest: int = 64) -> DataFrame:
    """(key, cite_uid, body): of each id the longest body, of equal lengths the first; or, with first, the first. Evidence
    without a body is left out, unless `blank` asks for it.

    All of it is expressions, one round for each level of the payloads; only what is nested deeper than `deepest` levels
    is read value by value in Arrow batches.
    """
    found = cited_objects(payloads, key, payload, HOW[how], deepest)
    if HOW[how].strings:
        found = stored(found, "cited")
        ids = F.array_distinct(F.regexp_extract_all(F.coalesce(payload, F.lit("")), F.lit(CITE.pattern), F.lit(0)))
        bare = payloads.join(found.select("__key").distinct(), F.col(key) == F.col("__key"), "left_anti")
        said = bare.select(F.col(key).alias("__key"), F.posexplode(ids).alias("pos", "cite_uid"))
        found = found.unionByName(said.select("__key", F.array("pos").alias("at"), "cite_uid", F.lit("").alias("body")))
    rank = F.struct("at") if first else F.struct(-F.length("body"), "at")
    best = found.groupBy("__key", "cite_uid").agg(F.min_by("body", rank).alias("body")).withColumnRenamed("__key", key)
    return best if blank else best.where(F.col("body").rlike(r"\S"))


def rendered_fields(payload: Column, dropped: list[str], most: int = 600) -> Column:
    """The fields of a flat JSON object as lines, without the dropped, null and empty ones and overlong nested ones."""
    entries = F.map_entries(F.from_json(payload, "map<string,string>"))
    kept = F.filter(entries, lambda e: ~e["key"].isin(*dropped) & (F.coalesce(e["value"], F.lit("")) != "") & ~(e["value"].rlike(r"^[\[{]") & (F.length(e["value"]) > most)))
    return F.coalesce(F.array_join(F.transform(kept, lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n"), F.lit(""))


def usable(payload: Column, markers: list[str]) -> Column:
    """Whether a payload can be evidence: not empty, not an object with empty items, without marks of an error."""
    bare = F.regexp_replace(F.coalesce(payload, F.lit("")), r"\s+", "")
    marked = F.lower(F.coalesce(payload, F.lit(""))).rlike("|".join(markers))
    return ~bare.isin("", "null", '""', "{}", "[]") & ~bare.rlike(r'^\{(?:.*,)?"items":(?:\[\]|null)') & ~marked


def outer_json(text: Column) -> Column:
    """What stands from the first opening to the last closing brace, if it is one flat object that parses; else null.

    The parser reads a first value and no further, so that more braces need a scan of their own.
    """
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found.rlike(r"^\{[^{}]*\}$") & F.try_parse_json(found).isNotNull(), found)


def balanced(text: str | None) -> str | None:
    """The first balanced object of a text, with regard to strings; a fenced block counts before the rest."""
    text = text or ""
    if m := re.search(r"```(?:json)?\s*(.*?)```", text, re.S):
        if isinstance(parsed(m[1]), dict):
            return m[1].strip()
    depth, start, quote, skip = 0, -1, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quote:
            quote, skip = c != '"', c == "\\"
        elif c == '"' and depth:
            quote = True
        elif c == "{":
            start, depth = (i if not depth else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if not depth and isinstance(parsed(text[start : i + 1]), dict):
                return text[start : i + 1]
    return None


def salvaged(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, json): the object that a text holds: the one flat object that its braces enclose, else the first balanced one."""

    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([balanced(t) for t in batch.column(1).to_pylist()], pa.string())], [key, "json"])

    rows = texts.select(key, text, outer_json(F.col(text)).alias("__json"))
    rest = rows.where("__json is null").select(key, text).mapInArrow(scan, f"{key} {dict(texts.dtypes)[key]}, json string")
    return rows.where("__json is not null").select(key, F.col("__json").alias("json")).unionByName(rest)


def sse_frames(body: Column) -> Column:
    """The data of a body of server-sent events: one string for each block, its data lines joined."""
    blocks = F.split(F.regexp_replace(body, "\r\n", "\n"), "\n\n")
    data = lambda b: F.array_join(F.transform(F.filter(F.split(b, "\n"), lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, F.lit(6), F.length(x)))), "\n")
    return F.filter(F.transform(blocks, data), lambda x: x != "")


def sse_answer(body: Column, how: str = "last_result") -> Column:
    """A body's JSON: plain JSON as it is; of events the first that parses, the last with a result, or the last block."""
    good = F.filter(sse_frames(body), lambda x: F.try_parse_json(x).isNotNull())
    if how == "last_result":
        good = F.filter(good, lambda x: F.try_variant_get(F.try_parse_json(x), "$.result", "string").isNotNull())
    picked = F.try_element_at(good, F.lit(1 if how == "first" else -1))
    return F.when(F.ltrim(body).startswith("{"), body).otherwise(picked)


def call_arguments(call: Column) -> Column:
    """(name, arguments) of a call's JSON: its arguments stand there as an object or as a string that holds one; anything
    else gives way to an empty object."""
    raw = F.get_json_object(call, "$.function.arguments")
    whole = F.trim(raw).startswith("{") & F.try_parse_json(raw).isNotNull()
    name = F.coalesce(F.get_json_object(call, "$.function.name"), F.lit(""))
    return F.struct(name.alias("name"), F.when(whole, raw).otherwise("{}").alias("arguments"))
