import base64
import glob
import gzip
import hashlib
import random

from compare import duck, spark_rows
from conftest import DATA
from pyspark.sql import functions as F

from evidentia.llm.warc import LoserTree, archived, decided, histories, merged_histories, op2_warc_histories, oracle, read_archives, records_of, sorted_runs, write_archives


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(40))) for _ in range(k)]
        assert list(LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_whole_table(spark):
    assert spark_rows(op2_warc_histories(spark, DATA)) == duck(oracle(), DATA)


ROWS = [(1, "http://a.org/x", "same"), (2, "http://b.org/é\r\nX: y%", "same"), (3, None, "own\r\n\r\nWARC/1.1\r\nlines é"), (4, "http://a.org/x", None), (5, "http://a.org/x", ""), (None, "http://a.org/", "same"), (6, "u", "x" * 300_000), (6, "u", "x" * 300_000), (7, "v", "x" * 300_000)]


def test_awkward_pages(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").selectExpr("*", "1 as digest", "2 as size", "3 as refers_to", "4 as payload", "5 as key", "6 as run", "7 as d", "8 as last")
    out = archived(pages, path=str(tmp_path / "w")).collect()
    got = sorted((str(r["page_id"]), str(r["url"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in out)
    wanted = []
    for i, url, html in ROWS:
        data = (html or "").encode()
        last = max((j for j, _, h in ROWS if (h or "") == (html or "") and j is not None), default=None)
        other = i is not None and last is not None and i != last
        wanted.append((str(i), str(url), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if other else "response", str(last if other else None)))
    assert got == sorted(wanted)
    bodies = [bytes(p) for f in glob.glob(str(tmp_path / "w/*/part-*")) for _, h, p in records_of(gzip.open(f).read()) if h["WARC-Type"] == "response"]
    assert {b.decode() for b in bodies} == {h or "" for _, _, h in ROWS}
    assert archived(pages.limit(0)).count() == 0


def test_global_order(spark, tmp_path):
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 3, F.lit(".org/"), F.col("id") % 7).alias("url"), (F.col("id") * 37 % 1001).alias("ts"), F.lit(None).cast("string").alias("html")).repartition(4)
    archived(pages, path=str(tmp_path / "w"))
    runs = sorted_runs(read_archives(spark, str(tmp_path / "w")))
    rows = histories(merged_histories(runs, rows=300)).orderBy("range", "place").collect()
    assert len(rows) == 5000 and len({r["range"] for r in rows}) > 10
    keys = [(r["key"], r["date"], r["page_id"]) for r in rows]
    assert keys == sorted(keys) and [r["position"] for r in rows] == list(range(5000))
    seen = {}
    for r in rows:
        assert r["capture"] == seen.get(r["key"], 0)
        seen[r["key"]] = r["capture"] + 1


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    sizes = [10, 1 << 16, (1 << 16) + 1, 1 << 20, (1 << 20) + 1, 1 << 24, (1 << 24) + 1]
    pages = spark.createDataFrame([(i, f"u{i}", 0, n) for i, n in enumerate(sizes)], "page_id bigint, url string, ts bigint, n int").selectExpr("page_id", "url", "ts", "cast(repeat('x', n) as binary) as payload")
    write_archives(pages, str(tmp_path / "w"))
    found = {r["page_id"]: (r["file"].split("/")[-2], r["payload_bytes"]) for r in read_archives(spark, str(tmp_path / "w")).collect()}
    assert found == {i: (k, n) for i, (n, k) in enumerate(zip(sizes, "0011223"))}


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "u", 0, b"ab"), (2, "u", 0, b"ab"), (3, "u", 0, b"abcd"), (4, "u", 0, b"abcd")], "page_id bigint, url string, ts bigint, payload binary")
    assert sorted((r["page_id"], r["refers_to"]) for r in decided(pages, least=3).collect()) == [(1, None), (2, None), (3, 4), (4, None)]
