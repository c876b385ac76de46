"""Files: JSON lines, CSV with a byte order mark, dictionaries and rule packs as sources; logs and reports as sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.overlay import first_filled

MARK = "﻿"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each line; blank lines are none, a line that does not parse gives nulls."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def variant_lines(spark: SparkSession, folder: str, variant: str, variants: dict[str, str], schema: str) -> DataFrame:
    """The rows of one of a collection's named variants: `variants` has the file of each. A name that it does not have is an
    error that says which there are; what a line holds beyond the schema is left out."""
    if variant not in variants:
        raise ValueError(f"no variant {variant!r}; there are {', '.join(sorted(variants))}")
    return json_lines(spark, f"{folder.rstrip('/')}/{variants[variant]}", schema)


def csv_rows(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """The logical columns of a CSV file with a header, each from the first of its names whose value is not blank."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip(MARK) for c in rows.columns])
    return rows.select(*[first_filled(rows, names).alias(k) for k, names in aliases.items()])


def text_of(spark: SparkSession, path: str) -> str | None:
    """A small file (a dictionary or a rule pack) through Spark's file systems; None where there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def dictionary(spark: SparkSession, path: str) -> dict:
    """A small JSON object; an absent file is an empty one."""
    text = text_of(spark, path)
    return json.loads(text) if text else {}


def rule_pack(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """A rule pack in the plain part of YAML: `category:` lines, each with `- pattern` lines below it, quoted or not."""
    pack: list[tuple[str, list[str]]] = []
    for line in (text_of(spark, path) or "").splitlines():
        bare = line.split(" #")[0].rstrip()
        if bare.endswith(":") and not bare.startswith((" ", "-", "#")):
            pack.append((bare[:-1].strip("\"' "), []))
        elif bare.lstrip().startswith("- ") and pack:
            value = bare.lstrip()[2:].strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1].replace("''", "'") if value[0] == "'" else json.loads(value)
            pack[-1][1].append(value)
    return pack


def pack_text(pack: list[tuple[str, list[str]]]) -> str:
    """A rule pack as text that rule_pack reads."""
    return "".join(f"{c}:\n" + "".join(f"  - '{p.replace(chr(39), 2 * chr(39))}'\n" for p in ps) for c, ps in pack)


def append_log(events: DataFrame, path: str) -> None:
    """Events as JSON lines, added to what is there."""
    events.write.mode("append").json(path)


def write_report(summary: DataFrame, results: DataFrame, path: str) -> None:
    """A run's summary and results, side by side under one path."""
    summary.write.mode("errorifexists").json(f"{path}/summary")
    results.write.mode("errorifexists").json(f"{path}/results")


def write_dictionary(pairs: DataFrame, path: str, key: str, members: str) -> None:
    """A dictionary as JSON lines, ordered by key."""
    pairs.select(key, members).orderBy(key).write.mode("errorifexists").json(path)
