"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust their score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import once

#: Lengths of account codes (IBAN) by country, as registered (fixed values).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def account_code(length: int, countries: str) -> str:
    """The pattern of one length's account codes, in groups of four with or without spaces."""
    fours, rest = divmod(length - 4, 4)
    last = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{fours}}}{last}"


#: Fixed patterns, plain.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": "|".join(account_code(n, c) for n, c in IBAN_LENGTHS.items()),
    "identity": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"[A-Za-z0-9_-]{20,}",
}
#: The same matches without rescans: a match starts where a run of the first class does, or where the last match ended,
#: and repeats are possessive, so that neither a long run nor a long repeat costs more than its length.
FAST = PLAIN | {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
KINDS = tuple(PLAIN)
BASE = KINDS[:4]
#: What a text must hold to hold a kind at all.
WORTH = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "identity": r"[0-9]{2}-[0-9]{4}", "secret": r"[A-Za-z0-9_-]{20}"}
#: Words whose presence near a span raises its score, and the score without them (fixed values).
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|credit|payment|account",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer|konto|compte|cuenta",
    "identity": "ssn|social security|identity|passport|tax id",
    "secret": "secret|token|password|passwd|api.?key|access.?key|private.?key|credential",
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "identity": 0.3, "secret": 0.3}
GAIN, LEAST, NEAR = 0.3, 0.5, 40
SPAN = "struct<kind:string,start:int,end:int,score:double>"
BLOCK = 256


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    padded = F.lpad(number, 20, "0")

    def add(total, i):
        d = F.substring(padded, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code without spaces leaves 1 when its rearranged number is divided by 97."""
    moved = F.concat(F.substring(code, F.lit(5), F.lit(40)), F.substring(code, F.lit(1), F.lit(4)))

    def add(rest, c):
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), add) == 1


def confirmed(kind: str, s: Column, before: Column, after: Column) -> Column:
    """The checks of one match; before and after are the texts beside it."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(s, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return once(digits(s), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(s)).between(9, 15)
    if kind == "iban":
        return once(F.replace(s, F.lit(" "), F.lit("")), mod97) & ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")
    if kind == "identity":
        return ~before.rlike("[0-9-]$")
    if kind == "secret":
        return s.rlike("[A-Za-z]") & s.rlike("[0-9].*[0-9].*[0-9].*[0-9]")
    return F.lit(True)


def running(a: Column) -> Column:
    """The sums of all elements before each element, in blocks so that long arrays cost little more than their length."""

    def sums(x, start):
        none = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, none, lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    def blocks(x):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda i: F.slice(x, i * BLOCK + 1, F.lit(BLOCK)))
        return once(parts, lambda b: F.flatten(F.zip_with(b, sums(F.transform(b, lambda y: F.aggregate(y, F.lit(0), lambda s, v: s + v)), F.lit(0)), sums)))

    return once(a, blocks)


def spans_of(text: Column, kind: str) -> Column:
    """The spans of a kind in a text, in order. Matches and the gaps between them come from one pattern and give the places.

    Context words are looked for in the text around a match's place, so that a match beside another one of its kind has the
    same context; for base kinds, which stay whatever their score, the gaps beside them do.
    """

    def near(gaps, i, start, end):
        if kind in BASE:
            return F.concat(F.right(F.get(gaps, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(NEAR)))
        first = F.greatest(start - NEAR, F.lit(0))
        return F.concat(F.substring(text, first + 1, start - first), F.lit(" "), F.substring(text, end + 1, F.lit(NEAR)))

    def made(hits, gaps, starts):
        def span(hit, i):
            start = F.get(starts, i)
            score = F.lit(SCORES[kind]) + F.when(F.lower(near(gaps, i, start, start + F.length(hit))).rlike(CONTEXT[kind]), GAIN).otherwise(0.0)
            ok = confirmed(kind, hit, F.get(gaps, i), F.get(gaps, i + 1))
            ok = ok if kind in BASE else ok & (score >= LEAST)
            return F.when(ok, F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), score.alias("score")))

        return F.filter(F.transform(hits, span), lambda x: x.isNotNull())

    def placed(hits):
        def with_gaps(gaps):
            steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), F.concat(F.array(F.lit("")), F.slice(hits, 1, F.size(hits) - 1)), lambda g, h: F.length(g) + F.length(h))
            ends = F.zip_with(running(steps), steps, lambda a, b: a + b)
            return once(ends, lambda starts: made(hits, gaps, starts))

        return F.when(F.size(hits) > 0, once(F.split(text, FAST[kind], -1), with_gaps))

    found = once(F.regexp_extract_all(text, F.lit(FAST[kind]), F.lit(0)), placed)
    return F.coalesce(F.when(text.rlike(WORTH[kind]), found), F.array()).cast(f"array<{SPAN}>")


def personal_data(documents: DataFrame) -> DataFrame:
    """A row for each document row: doc_id and spans, an array of (kind, start, end, score) by kind, then start.

    Places are code points of the whole text, ends exclusive. Base kinds (email, ip, card, phone) keep every confirmed
    match; the others (account codes by their country's length and mod-97, identity numbers and secrets by context) need a
    score of LEAST. A null or empty text
    has no spans; repeated rows have the same spans each; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", F.concat(*[spans_of(text, k) for k in KINDS]).alias("spans"))


def masked(documents: DataFrame) -> DataFrame:
    """documents with each span of whole texts replaced by [kind]; of spans that overlap, the one that starts first counts."""

    def cut(text, spans):
        order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

        def step(state, s):
            piece = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), s["kind"], F.lit("]"))
            return F.when(s["start"] >= state["at"], F.struct(piece.alias("out"), s["end"].alias("at"))).otherwise(state)

        return once(F.aggregate(order, begin, step), lambda e: F.concat(e["out"], F.substring(text, e["at"] + 1, F.length(text))))

    spans = F.concat(*[spans_of(F.coalesce(F.col("text"), F.lit("")), k) for k in KINDS])
    return documents.withColumn("text", once(spans, lambda s: F.when(F.size(s) > 0, cut(F.col("text"), s)).otherwise(F.col("text"))))


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def oracle() -> str:
    """DuckDB SQL for op5_personal_data, from the plain patterns."""
    digit = "regexp_replace({}, '[^0-9]', '', 'g')".format
    luhn_sql = "list_sum(list_transform(range(1, 21), lambda i: CASE WHEN i % 2 = 0 THEN substr(lpad({0}, 20, '0'), i, 1)::INT WHEN substr(lpad({0}, 20, '0'), i, 1)::INT > 4 THEN 2 * substr(lpad({0}, 20, '0'), i, 1)::INT - 9 ELSE 2 * substr(lpad({0}, 20, '0'), i, 1)::INT END)) % 10 = 0".format(digit("x.hit"))
    code = "replace(x.hit, ' ', '')"
    values = f"list_transform(string_split(substr({code}, 5) || substr({code}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
    ok = {
        "email": "true",
        "ip": "len(list_filter(string_split(x.hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0",
        "card": f"length({digit('x.hit')}) BETWEEN 13 AND 19 AND {luhn_sql}",
        "phone": f"length({digit('x.hit')}) BETWEEN 9 AND 15",
        "iban": f"list_reduce(list_concat([0], {values}), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1 AND NOT regexp_matches(x.gap, '[A-Za-z0-9]$') AND NOT regexp_matches(x.next, '^[A-Za-z0-9]')",
        "identity": "NOT regexp_matches(x.gap, '[0-9-]$')",
        "secret": "regexp_matches(x.hit, '[A-Za-z]') AND regexp_matches(x.hit, '[0-9].*[0-9].*[0-9].*[0-9]')",
    }
    parts = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        near = f"substr(t, greatest(x.at - {NEAR}, 0) + 1, least(x.at, {NEAR})) || ' ' || substr(t, x.at + length(x.hit) + 1, {NEAR})"
        score = f"{SCORES[kind]} + CASE WHEN regexp_matches(lower({near}), '{CONTEXT[kind]}') THEN {GAIN} ELSE 0 END >= {LEAST}"
        kept = ok[kind] if kind in BASE else f"({ok[kind]}) AND ({score})"
        parts.append(
            f"SELECT rid, {n} AS k, '{kind}' AS kind, x.at AS s, x.at + length(x.hit) AS e FROM (SELECT rid, t, unnest(list_transform(range(1, len(h) + 1), lambda i: {{'hit': h[i], 'gap': g[i], 'next': g[i + 1], 'at': list_sum(list_transform(g[1:i], lambda y: length(y)))::BIGINT + coalesce(list_sum(list_transform(h[1:i - 1], lambda y: length(y))), 0)::BIGINT}})) AS x "
            f"FROM (SELECT rid, t, regexp_extract_all(t, '{pattern}') AS h, string_split_regex(t, '{pattern}') AS g FROM d)) WHERE {kept}"
        )
    joined = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s){}, '')".format
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), "
        f"f AS ({' UNION ALL '.join(parts)}) "
        f"SELECT doc_id, {counts}, sha256({joined(' FILTER (WHERE k < 4)')}) AS base_sha256, {joined('')} AS spans FROM d LEFT JOIN f USING (rid) GROUP BY rid, doc_id"
    )
