"""Web archives: writing WARC records, reading them back, and merging capture indexes into capture histories."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, stored

#: Bytes of payload and records that an archive file holds at most (a larger record is a file), and index rows that a
#: merging task is meant to get.
FILE_BYTES, FILE_RECORDS, MERGE_ROWS = 1 << 27, 2048, 1 << 13
BREAK = "\r\n"
EPOCH = 1_700_000_000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column: five hex digits at a time are four base32 digits."""
    digest = F.sha1(payload)
    digits = []
    for at in range(0, 40, 5):
        value = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        for bits in (15, 10, 5, 0):
            digits.append(F.substring(F.lit(ALPHABET), F.shiftright(value, bits).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*digits)


def url_key(url: Column) -> Column:
    """A sortable key: the host's labels in reverse, then the path and the rest, without the scheme; lower case."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.substring(rest, F.length(host) + 1, F.length(rest)))


def decided(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages(page_id, url, ts, payload) with digest, size and refers_to: of the records with equal payloads of at least
    `least` bytes, that with the largest page_id is the response (refers_to null), and the others refer to it.

    Only digests and ids are grouped; the payloads are shuffled once, to the join with the digests that repeat. A
    payload that a large part of all pages share is split by the join.
    """
    rows = pages.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.octet_length("payload").cast("bigint"))
    shared = rows.where(F.col("size") >= least).groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(shared.drop("n"), "payloads").hint("shuffle_hash")  # whose size is not bounded: never broadcast
    rows = rows.join(shared, (F.col("digest") == F.col("d")) & (F.col("size") >= least), "left")
    return rows.withColumn("refers_to", F.when(F.col("page_id") != F.col("last"), F.col("last"))).drop("d", "last")


def record(run: str) -> Column:
    """A WARC/1.1 record without its closing two line breaks, as text."""
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit(f"<urn:evidentia:{run}:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    date = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = [
        F.lit("WARC/1.1"),
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), date),
        # A line break would end the field, so the few characters that are breaks or per cent signs are written as %XX.
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("size").cast("string"))),
    ]
    return F.concat(F.concat_ws(BREAK, *fields), F.lit(BREAK * 2), F.when(revisit, "").otherwise(F.col("payload").cast("string")))


def write_archives(pages: DataFrame, path: str, least: int = 0, file_records: int = FILE_RECORDS) -> None:
    """A WARC record for each row of pages(page_id, url, ts, payload), in gzipped archive files in folders of path.

    Spark's text writer ends each record with the two line breaks that the format asks for. One task reads a file as a
    whole, so files are bounded by bytes: records go to one of four folders by the size of their payload, and a file of a
    folder holds no more records than FILE_BYTES have room for.
    """
    records = decided(pages, least)
    name, over = uuid.uuid4().hex[:12], -1
    for i, n in enumerate((file_records, 128, 8, 1)):
        most = FILE_BYTES // n if n > 1 else 1 << 31
        own = records.where((F.col("size") > over) & (F.col("size") <= most)).select(record(name).alias("value"))
        own.write.option("lineSep", BREAK * 2).option("compression", "gzip").option("maxRecordsPerFile", n).text(f"{path}/{i}")
        over = most


def records_of(data: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """Offset, fields and payload of each record of an archive, found by their lengths alone."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(BREAK)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        yield at, fields, view[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A capture for each record: file, offset, page_id, url, ts, record_type, refers_to, payload_bytes, payload_digest.

    A response's size and digest are those of the payload that is read, a revisit's those that it states; a payload that
    does not fit its stated digest fails the task.
    """
    import zlib

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                data = zlib.decompress(content.as_buffer(), wbits=31)
                for at, f, payload in records_of(data):
                    digest, size = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"])
                    if f["WARC-Type"] == "response":
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if (found, len(payload)) != (digest, size):
                            raise ValueError(f"{name} at {at}: payload is damaged")
                    uri, to = f.get("WARC-Target-URI"), f.get("WARC-Refers-To")
                    uri = uri and uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    page = f.get("X-Page-ID")
                    rows.append((name, at, int(page) if page else None, uri, f["WARC-Date"], f["WARC-Type"], int(to[1:-1].rpartition(":")[2]) if to else None, size, digest))
                columns = list(zip(*rows)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(read, "file string, offset bigint, page_id bigint, url string, date string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string")


class LoserTree:
    """Merges k sorted iterators: each inner node keeps the loser of its match, the root's winner is the next item."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k - 1, -1, -1):
            self.replay(i)

    def before(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; an ended run comes last, and equal heads go by their runs' order."""
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and ((x, a) < (y, b))

    def replay(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:  # still being built: wait here for the other side
                self.losers[node] = winner
                return
            if self.before(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k and (item := self.heads[top := self.losers[0]]) is not None:
            yield item
            self.heads[top] = next(self.runs[top], None)
            self.replay(top)


def sorted_runs(captures: DataFrame) -> DataFrame:
    """The index of the captures as locally sorted runs, one for each task: run, key, date and the captures' columns."""
    index = captures.drop("key", "run").withColumn("key", url_key(F.col("url"))).withColumn("run", F.spark_partition_id())
    return stored(index.sortWithinPartitions("key", "date", "page_id", "file", "offset"), "runs")


def merged_histories(runs: DataFrame, rows: int = MERGE_ROWS) -> DataFrame:
    """The captures in global order by key, date, page_id, file and offset, with `range` and `place`, a row's order in it.

    Range partitioning cuts every run at the same keys (also inside the history of one url, which may be long). In each
    range, the stretches in which a run's rows arrive in order (its slice, or the blocks of it) are merged by a loser
    tree; nothing is sorted again.
    """
    order = ["key", "date", "page_id", "file", "offset"]
    parts = max(1, -(-runs.count() // rows))
    names = runs.columns
    at = [names.index(c) for c in order]
    run_at = names.index("run")

    def merge(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        whole = pa.Table.from_batches(tables)
        columns = [whole[c].to_pylist() for c in order]
        blank = lambda v: (v is not None, v if v is not None else 0)  # noqa: E731  nulls first, as Spark sorts them
        keys = list(zip(columns[0], columns[1], map(blank, columns[2]), columns[3], columns[4]))
        stretches: list[list[int]] = []
        open_: dict[int, list[int]] = {}  # of each run, the stretch that may go on
        for i, run in enumerate(whole[names[run_at]].to_pylist()):
            if run not in open_ or keys[open_[run][-1]] > keys[i]:
                stretches.append(own := [])
                open_[run] = own
            open_[run].append(i)
        tree = LoserTree([iter([(keys[i], i) for i in own]) for own in stretches])
        taken = pa.array([i for _, i in tree], pa.int64())
        out = whole.take(taken).append_column("place", pa.array(range(len(taken)), pa.int64()))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    dealt = runs.repartitionByRange(parts, *order)
    fields = ", ".join(f"{n} {t}" for n, t in runs.dtypes)
    return dealt.mapInArrow(merge, f"{fields}, place bigint").withColumn("range", F.spark_partition_id())


def histories(merged: DataFrame) -> DataFrame:
    """merged_histories' rows with `position`, the place in the global order, from 0, and `capture`, that in the history of
    the row's key, from 0. Ranges are counted, and one row of each gives where it starts."""
    by_key = Window.partitionBy("range", "key").orderBy("place")
    rows = stored(merged.withColumn("__k", F.row_number().over(by_key) - 1), "histories")
    ranges = rows.groupBy("range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each MERGE_ROWS rows
    starts = ranges.select(F.col("range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    # Only a history that reaches into a range from the one before goes on there: those are its first keys.
    parts = rows.groupBy("key", "range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("key").alias("__key"), F.col("range").alias("__p"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__held")).where("__held > 0")
    rows = rows.join(starts, F.col("range") == F.col("__r")).join(parts, (F.col("key") == F.col("__key")) & (F.col("range") == F.col("__p")), "left")
    placed = rows.withColumn("position", F.col("__start") + F.col("place")).withColumn("capture", F.col("__k") + F.coalesce("__held", F.lit(0)))
    return placed.drop("__k", "__r", "__start", "__key", "__p", "__held")


def archived(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """Writes pages(page_id, url, html and, if there, ts in seconds) to archives, reads them back and returns their
    merged capture histories.

    Payloads are the html in UTF-8 (null: empty); null urls have no Target-URI; repeated rows are records each, and only
    those whose page_id is not the largest of their payload's are revisits; rows with a null page_id are
    responses; an empty table gives no rows. Pages without ts are dated by
    their ids.
    """
    ts = F.col("ts") if "ts" in pages.columns else F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**8))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", ts.cast("bigint").alias("ts"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    path = path or new_path(pages.sparkSession, "archives")
    write_archives(rows, path, least)
    return histories(merged_histories(sorted_runs(read_archives(pages.sparkSession, path))))


def op2_warc_histories(spark, sf_dir: str) -> DataFrame:
    found = archived(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "key", "position", "capture")


def oracle() -> str:
    value = lambda k: f"CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT)"
    digits = " || ".join(f"substr('{ALPHABET}', ({value(k)} >> {bits}) % 32 + 1, 1)" for k in range(8) for bits in (15, 10, 5, 0))
    rest = r"regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://', '')"
    key = "array_to_string(list_reverse(string_split(regexp_extract(r, '^[^/?#]*'), '.')), ',') || ')' || substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1)"
    return (
        f"WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, {rest} AS r, coalesce(page_id, 0) % 100000000 AS ts FROM pages), "
        f"q AS (SELECT *, {key} AS key, max(page_id) OVER (PARTITION BY html) AS last FROM p) "
        f"SELECT page_id, strlen(html) AS payload_bytes, {digits} AS payload_digest, "
        "CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, "
        "key, row_number() OVER (ORDER BY key, ts, page_id) - 1 AS position, row_number() OVER (PARTITION BY key ORDER BY ts, page_id) - 1 AS capture FROM q"
    )
