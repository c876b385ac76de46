"""URL filters: listed rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: (rule, verdict): a host suffix and the start of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
WEIGHTS, GRAMS = 1 << 13, (3, 4, 5)
#: The risk from which on the model blocks: of the labelled table's hosts, held out in turn, about one allowed in a hundred
#: lies above it.
RISK = 0.3
#: At most so many labelled rows, the first by a hash of the url, are fitted.
MOST_LABELLED = 100_000
#: A small labelled table. The words of its hosts stand for pages to block (1) or to allow (0), by topic; names without
#: meaning, made of open syllables, are to be allowed: an unknown host is no reason to block.
BLOCKED = (
    "gambling roulette blackjack baccarat bookmaker sportsbook wager betting jackpot slots poker bingo lottery craps punter "
    "porn xxx sexcam hentai escort erotic nude milf fetish camgirl hookup sexchat swinger stripper lingerie-cam "
    "viagra cialis levitra pharma steroid opioid xanax tramadol weightloss slimming botox "
    "malware phishing keygen warez crack torrent ransom botnet spyware trojan rootkit cheatcode "
    "scam ponzi payday loanshark quickcash getrich pyramid forex replica counterfeit knockoff clickbait "
    "adserver adclick banner popunder popup tracker beacon telemetry affiliate backlinks spammer bulkmail spamlist"
).split()
ALLOWED = (
    "library museum gallery school university college academy science biology physics chemistry history geography weather climate "
    "garden kitchen recipe cooking baking travel railway airport harbour cycling hiking football cricket tennis orchestra theatre "
    "cinema music guitar piano poetry novel literature dictionary grammar language translation newspaper journal magazine radio "
    "podcast archive government parliament council hospital clinic health dental nursing charity church parish village town county "
    "forest river mountain island beach bridge castle hotel restaurant bakery cafe market bookshop software developer database "
    "compiler linux forum wiki tutorial camera photo design architect furniture carpenter plumber solar battery insurance bank "
    "accounting law court engineer robotics astronomy telescope bird wildlife aquarium dairy vineyard"
).split()
NAMES = ["".join("bcdfgklmnprsvz"[(i // 5**j + 3 * i * j + 5 * j) % 14] + "aeiou"[(i // 7**j + j) % 5] for j in range(3 + i % 2)) for i in range(150)]
MORE = "online home daily world hub club zone today".split()  # what stands beside either
SHAPES = ("http://{0}-{1}.test/index.html", "https://www.{1}{0}.test/a/{2}", "https://{0}.{1}.test/{1}/{2}.html", "http://{1}-{0}.test/")


def labelled_urls(words: list[str], label: int) -> list[tuple[str, int]]:
    """Each word in each shape, twice beside another word of its label and twice beside a word that stands with either."""
    n = len(words)
    beside = lambda i, k: words[(i + 7 + 13 * k) % n] if k % 2 else MORE[(i + k) % len(MORE)]
    return [(s.format(w, beside(i, k), 10 * i + k), label) for i, w in enumerate(words) for k, s in enumerate(SHAPES)]


LABELLED = labelled_urls(BLOCKED, 1) + labelled_urls(ALLOWED, 0) + labelled_urls(NAMES, 0)


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; empty where there is no ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def after_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def ruled(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (of equal ones the first listed), and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in reversed(sorted(rules, key=lambda r: -len(r[0]))):
        suffix, _, start = text.partition("/")
        fits = ((host == suffix) | host.endswith(f".{suffix}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str, size: int = WEIGHTS) -> np.ndarray:
    """The different hashed n-grams of a host and of a path, each between marks of its ends."""
    out = set()
    for kind, part in (("h", host), ("p", path)):
        data = f"^{part}$".encode()
        for n in GRAMS:
            out.update(xxhash.xxh64_intdigest(data[i : i + n], ord(kind)) % size for i in range(len(data) - n + 1))
    return np.fromiter(out, np.int64, len(out))


def fit(rows: list[tuple[str, str, int]], size: int = WEIGHTS, steps: int = 1000, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on rows of (host, path, label), by gradient descent on unit-length features."""
    w, bias = np.zeros(size), 0.0
    if not rows:
        return w, bias
    grams = [features(h, p, size) for h, p, _ in rows]
    at, row = np.concatenate(grams), np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    value = np.concatenate([np.full(len(g), 1 / np.sqrt(max(len(g), 1))) for g in grams])
    y = np.array([label for *_, label in rows], float)
    for _ in range(steps):
        off = 1 / (1 + np.exp(-(np.bincount(row, value * w[at], len(rows)) + bias))) - y
        w -= 16.0 * (np.bincount(at, value * off[row], size) / len(rows) + decay * w / len(rows))
        bias -= 16.0 * off.mean()
    return w, bias


def filtered(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, least: float = RISK, size: int = WEIGHTS) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict and risk, the model's probability that a url is to block.

    verdict is that of the longest rule that fits, else block where risk is at least `least`. The model is fitted on
    labelled(url, label), 1 for block, or on the small table above; rows with nulls are left out. A null url, or one
    without ://, has an empty host and path; repeated rows are judged alike; an empty table gives no rows.
    """
    spark = pages.sparkSession
    labelled = spark.createDataFrame(LABELLED, "url string, label int") if labelled is None else labelled
    labelled = labelled.select("url", F.col("label").cast("int").alias("label")).dropna()
    rows = labelled.orderBy(F.xxhash64("url"), "url", "label").limit(MOST_LABELLED).select(host_of(F.col("url")), path_of(F.col("url")), "label").collect()
    weights, bias = fit([tuple(r) for r in rows], size)
    weights = weights.astype(np.float32)

    def judged(batches):
        for batch in batches:
            risks = []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at = features(host, path, size)
                risks.append(1 / (1 + np.exp(-(weights[at].sum() / np.sqrt(max(len(at), 1)) + bias))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(risks, pa.float64())], [*batch.schema.names, "risk"])

    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    risky = parts.mapInArrow(judged, f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, risk double")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    model = F.when(F.col("risk") >= least, "block").otherwise("allow")
    return risky.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, model).alias("verdict"), "risk")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("risk")
