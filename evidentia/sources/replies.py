"""Recorded replies of tool servers and search services: a Spark data source, and what a client makes of the replies.

A record is one attempt of a call: {"tool", "key", "attempt", "status", "seconds", "body"}, as JSON lines. `status` is that
of the HTTP reply (null: the connection broke), `seconds` how long it took and `body` plain JSON or server-sent events. A
client of a live server would write the same records; nothing here keeps addresses or credentials.
"""

from __future__ import annotations

import io
import json
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

FORMAT = "recorded_replies"
FIELDS = "tool string, key string, attempt int, status int, seconds double, body string"
#: Bytes of a file that one partition reads, rows of a batch.
SPLIT, ROWS = 32 << 20, 4096
# Which statuses are tried again, how often, the seconds of one attempt, and the first pause between two.
RETRY_STATUS, RETRIES, PER_TRY, PAUSE = (429, 500, 502, 503, 504), 3, 60.0, 1.5


class RepliesSource(DataSource):
    """spark.read.format("recorded_replies").load(path): records under a folder, also in folders tool=... (which a filter on
    the tool leaves unread). Options: splitBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> RepliesReader:
        return RepliesReader(self.options.get("path", ""), int(self.options.get("splitBytes", SPLIT)))


class Part(InputPartition):
    def __init__(self, path: str, tool: str | None, start: int, end: int):
        self.path, self.tool, self.start, self.end = path, tool, start, end


class RepliesReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split, self.tools, self.keys = path, split, None, None

    def pushFilters(self, filters):
        """Equality with tools and keys is the reader's; whatever else is asked for stays Spark's."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute not in (("tool",), ("key",)):
                yield f
            elif f.attribute == ("tool",):
                self.tools = wanted if self.tools is None else self.tools & wanted
            else:
                self.keys = wanted if self.keys is None else self.keys & wanted

    def files(self):
        """(file system, path, size, tool that its folder names) of each file of records."""
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        for x in sorted(store.get_file_info(fs.FileSelector(top, recursive=True)), key=lambda x: x.path):
            if x.type == fs.FileType.File and x.base_name[0] not in "._":
                named = [p.removeprefix("tool=") for p in x.path.split("/") if p.startswith("tool=")]
                yield store, x.path, x.size, unquote(named[-1]) if named else None

    def partitions(self) -> list[Part]:
        own = [(path, size, tool) for _, path, size, tool in self.files() if tool is None or self.tools is None or tool in self.tools]
        return [Part(path, tool, at, at + self.split) for path, size, tool in own for at in range(0, size, self.split)] or [Part("", None, 0, 0)]

    def read(self, part: Part):
        import pyarrow as pa
        from pyarrow import fs

        if not part.path:
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        names = [x.split()[0] for x in FIELDS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
        rows = []

        def batch():
            columns = zip(*rows) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        with store.open_input_file(part.path) as file:
            # A line belongs to the part in which it begins.
            at = max(0, part.start - 1)
            file.seek(at)
            lines = iter(io.BufferedReader(file, 1 << 20).readline, b"")
            if part.start:
                at += len(next(lines, b""))
            for line in lines:
                if at >= part.end:
                    break
                at += len(line)
                try:
                    x = json.loads(line)
                except ValueError:
                    continue  # a torn line of a log is no record
                tool = x.get("tool", part.tool)
                if (self.tools is not None and tool not in self.tools) or (self.keys is not None and x.get("key") not in self.keys):
                    continue
                rows.append((tool, x.get("key"), x.get("attempt", 0), x.get("status"), x.get("seconds", 0.0), x.get("body")))
                if len(rows) == ROWS:
                    yield batch()
                    rows.clear()
        yield batch()


def replies(spark: SparkSession, path: str, **options) -> DataFrame:
    """The attempts that are recorded under a path."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepliesSource)
    return spark.read.format(FORMAT).options(**options).load(path)


def recorded(attempts: DataFrame, path: str) -> None:
    """Attempts written as records, a folder for each tool."""
    attempts.select(*[x.split()[0] for x in FIELDS.split(", ")]).write.partitionBy("tool").json(path)


def first_json_line(body: Column) -> Column:
    """The first line of a body, without `data:`, that is a JSON object; null if there is none."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^data:", "")))
    return F.try_element_at(F.filter(lines, lambda x: x.startswith("{") & F.try_parse_json(x).isNotNull()), F.lit(1))


def whole_json(body: Column) -> Column:
    return F.when(F.try_parse_json(body).isNotNull(), body)


def has(value: Column, key: str) -> Column:
    """Whether an object has a key, also one that is null."""
    return F.coalesce(F.array_contains(F.json_object_keys(value), key), F.lit(False))


def answers(attempts: DataFrame, total: float = PER_TRY * RETRIES, per_try: float = PER_TRY, retries: int = RETRIES, retry_status: tuple[int, ...] = RETRY_STATUS, pause: float = PAUSE, wrapped: bool = True) -> DataFrame:
    """(tool, key, outcome, payload, tries, spent) for each call: what a client with these limits would have got.

    An attempt that breaks, takes longer than `per_try` or than what is left of `total`, or has a status to be tried again is
    followed by the next one after a pause that doubles, unless no more than the pause is left. Any other failure ends the
    call, as do a reply that holds no JSON and one with an error. outcome: answered, tool_error (a result that says it is
    one), error, unreadable, refused, and of a call whose attempts are used up broken, late or busy. payload is null unless
    answered: a failure is never evidence. It is the JSON of structuredContent.result if there is one, else the text of the
    first content, else the whole result. Replies that are not `wrapped` (a search service's) are payloads as they are.

    At most `retries` attempts of a call meet in one row; of repeated records of an attempt the first body in order counts.
    """
    own = attempts.where(F.col("attempt") < retries).groupBy("tool", "key", "attempt").agg(F.min(F.struct("status", "seconds", "body")).alias("x"))
    calls = own.groupBy("tool", "key").agg(F.array_sort(F.collect_list(F.struct("attempt", F.col("x.status").alias("status"), F.col("x.seconds").alias("seconds"), F.col("x.body").alias("body")))).alias("xs"))
    start = F.struct(F.lit(0.0).alias("spent"), F.lit(True).alias("open"), F.lit("late").alias("outcome"), F.lit(None).cast("string").alias("body"), F.lit(0).alias("tries"))

    def step(s, x):
        left = total - s["spent"]
        goes = s["open"] & (left > 0)
        wait = F.least(F.lit(per_try), left)
        late = x["seconds"] > wait
        spent = s["spent"] + F.least(x["seconds"], wait)
        done = ~late & (x["status"] == 200)
        again = late | x["status"].isNull() | x["status"].isin(*retry_status) | x["status"].between(201, 299)
        held = pause * F.pow(F.lit(2.0), s["tries"])
        more = again & (s["tries"] + 1 < retries) & (total - spent > held)
        outcome = F.when(late, "late").when(x["status"].isNull(), "broken").when(done, "answered").when(again, "busy").otherwise("refused")
        after = F.struct(F.when(more, spent + held).otherwise(spent).alias("spent"), more.alias("open"), outcome.alias("outcome"), F.when(done, x["body"]).alias("body"), (s["tries"] + 1).alias("tries"))
        return F.when(goes, after).otherwise(F.struct(s["spent"].alias("spent"), F.lit(False).alias("open"), s["outcome"].alias("outcome"), s["body"].alias("body"), s["tries"].alias("tries")))

    rows = calls.select("tool", "key", F.aggregate("xs", start, step).alias("s")).select("tool", "key", "s.outcome", "s.tries", F.round("s.spent", 6).alias("spent"), (first_json_line if wrapped else whole_json)(F.col("s.body")).alias("reply"))
    if not wrapped:
        said = F.when((F.col("outcome") == "answered") & F.col("reply").isNull(), "unreadable").otherwise(F.col("outcome"))
        return rows.select("tool", "key", said.alias("outcome"), F.col("reply").alias("payload"), "tries", "spent")
    result = F.coalesce(F.get_json_object("reply", "$.result"), F.lit("{}"))
    rows = rows.withColumn("result", result)
    outcome = (
        F.when(F.col("outcome") != "answered", F.col("outcome")).when(F.col("reply").isNull(), "unreadable").when(has(F.col("reply"), "error"), "error")
        .when(F.try_variant_get(F.try_parse_json("result"), "$.isError", "boolean") & (F.get_json_object("result", "$.isError") == "true"), "tool_error").otherwise("answered")
    )
    structured = F.get_json_object("result", "$.structuredContent")
    inner = F.when(has(structured, "result"), F.coalesce(F.get_json_object(structured, "$.result"), F.lit("null")))
    text = F.when(F.get_json_object("result", "$.content[0]").startswith("{"), F.coalesce(F.get_json_object("result", "$.content[0].text"), F.lit("")))
    rows = rows.withColumn("said", outcome)
    return rows.select("tool", "key", F.col("said").alias("outcome"), F.when(F.col("said") == "answered", F.coalesce(inner, text, "result")).alias("payload"), "tries", "spent")


def tool_list(answered: DataFrame, listing: str = "tools/list") -> DataFrame:
    """(name, description, schema) from the answer of a server's listing; none of it where the listing failed."""
    tools = F.explode(F.from_json(F.get_json_object("payload", "$.tools"), "array<string>"))
    rows = answered.where(F.col("tool") == listing).select(tools.alias("x"))
    return rows.select(F.get_json_object("x", "$.name").alias("name"), F.get_json_object("x", "$.description").alias("description"), F.get_json_object("x", "$.inputSchema").alias("schema"))


#: For each field of a document the names under which a service may give it, the first filled one counts; a name may be
#: followed by what is put before its value.
DOCUMENT = {"title": ["title"], "text": ["text", "content", "snippet"], "url": ["url"], "locator": ["section", "page"]}


def documents(answered: DataFrame, sources: dict[str, dict[str, list]], k: int | None = None, lists: tuple[str, ...] = ("results", "items", "data")) -> DataFrame:
    """(source, query, place, title, text, url, locator, score): the documents that search services answer with.

    `sources` names, for each service (the tool of its calls), where it differs from DOCUMENT. The first non-empty of
    `lists` holds the items. A call that failed, an answer that is no object, and one with a score that is no number
    give no documents: one service that is down leaves the others' answers alone.
    """
    known = {s: DOCUMENT | own for s, own in sources.items()}
    rows = answered.where(F.col("tool").isin(*known) & (F.col("outcome") == "answered"))
    held = [F.from_json(F.get_json_object("payload", f"$.{name}"), "array<string>") for name in lists]
    items = F.coalesce(*[F.when(F.size(x) > 0, x) for x in held])
    rows = rows.select(F.col("tool").alias("source"), F.col("key").alias("query"), items.alias("items"))
    score = lambda x: F.when(F.array_contains(F.json_object_keys(x), "score"), F.get_json_object(x, "$.score").try_cast("double")).otherwise(0.0)
    rows = rows.where(~F.exists("items", lambda x: score(x).isNull() | ~x.startswith("{")))
    rows = rows.select("source", "query", F.posexplode("items").alias("place", "x"))
    if k is not None:
        rows = rows.where(F.col("place") < k)

    def field(name: str) -> Column:
        out = F.lit(None).cast("string")
        for source, aliases in known.items():
            named = [a if isinstance(a, tuple) else (a, "") for a in aliases.get(name, [])]
            found = [F.concat(F.lit(before), F.nullif(F.get_json_object("x", f"$['{a}']"), F.lit(""))) for a, before in named]
            out = F.when(F.col("source") == source, F.coalesce(*found, F.lit(None).cast("string"))).otherwise(out)
        return out

    fields = [F.coalesce(field(n), F.lit("")).alias(n) if n in ("title", "text") else field(n).alias(n) for n in DOCUMENT]
    return rows.select("source", "query", (F.col("place") + 1).alias("place"), *fields, score(F.col("x")).alias("score"))


def top_text(queries: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """queries(query) with `text`: that of the source's first document, or empty."""
    first = found.where((F.col("source") == source) & (F.col("place") == 1)).select(F.col("query").alias("__query"), "text")
    return queries.join(first, F.col("query") == F.col("__query"), "left").withColumn("text", F.coalesce("text", F.lit(""))).drop("__query")

