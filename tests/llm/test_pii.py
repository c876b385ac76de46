import hashlib
import re

from brute import base_spans
from compare import duck, spark_rows
from conftest import DATA, ROWS
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from evidentia.llm.pii import masked, op5_personal_data, oracle, personal_data

SHAPES = "a.b@c.de|x@y|1.2.3.4|300.1.2.3|4111 1111 1111 1111|4111-1111-1111-1112|+49 30 1234567|+1|5500005555555559|DE89 3704 0044 0532 0130 00|078-05-1120|é|𝒳| |-|.|@|+|(|\n|card|iban|ssn|7".split("|")


def found(spark, texts):
    rows = personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    return [[(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in sorted(rows, key=lambda r: r["doc_id"])]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(SHAPES), max_size=14).map("".join), min_size=150, max_size=200))
def test_base_spans_of_anything(spark, texts):
    for text, spans in zip(texts, found(spark, texts)):
        assert [s for s in spans if s[0] in ("email", "ip", "card", "phone")] == base_spans(text), text


def test_context_by_place(spark):
    """A context word counts for a second match too that stands near it."""
    a, b = "Ab12Cd34Ef56Gh78Ij90", "Zy98Xw76Vu54Ts32Rq10"
    assert [s[0] for s in found(spark, [f"password: {a} {b}"])[0]] == ["secret"] * 2
    assert found(spark, [f"{a} {b} " + "x " * 60 + "password"])[0] == []


def test_checksums_and_context(spark):
    texts = ["my iban is DE89 3704 0044 0532 0130 00 thanks", "iban DE89 3704 0044 0532 0130 01", "ssn 078-05-1120", "part 078-05-1120"]
    kinds = [{s[0] for s in x} - {"card"} for x in found(spark, texts)]
    assert kinds == [{"iban"}, set(), {"identity"}, set()]


def test_account_codes_by_country(spark):
    """A capital word that follows is not part of the code; a code that goes on, or is of another length, is none."""
    texts = ["LT12 1000 0111 0100 1000 THE", "LT121000011101001000", "LT1210000111010010005", "NO93 8601 1117 947 X", "GB82 WEST 1234 5698 7654 32", "ZZ82 WEST 1234 5698 7654 32"]
    assert [[s for s in x if s[0] == "iban"] for x in found(spark, texts)] == [[("iban", 0, 24)], [("iban", 0, 20)], [], [("iban", 0, 18)], [("iban", 0, 27)], []]


def test_secrets_by_context(spark):
    key = "11acdfb36bb72224148e6160f674b4be45601bff"
    texts = [f'token = "{key}"', f"commit {key}", "password: correct-horse-battery-staple", f"the api key is {key[:20]}, keep it"]
    assert [[s for s in x if s[0] == "secret"] for x in found(spark, texts)] == [[("secret", 9, 49)], [], [], [("secret", 15, 35)]]


def test_whole_table(spark):
    assert spark_rows(op5_personal_data(spark, DATA)) == duck(oracle(), DATA)


def test_awkward_rows(spark, awkward, empty):
    rows = personal_data(awkward).collect()
    got = sorted((str(r["doc_id"]), [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in rows)
    assert got == sorted((str(i), base_spans(t)) for i, t, *_ in ROWS)
    assert personal_data(empty).count() == 0 and masked(empty).count() == 0


def test_long_repeats(spark):
    texts = ["1 " * 60_000, "1" * 60_000, "a.b@" + "c." * 40_000 + "d", "+1" + " (" * 60_000 + "2", "a" * 200_000, "1.1.1.1." * 9000, "A" * 5000 + "A1 " * 30_000]
    for text, spans in zip(texts, found(spark, texts)):
        assert [s for s in spans if s[0] in ("email", "ip", "card", "phone")] == base_spans(text)


def test_masked(spark):
    docs = spark.createDataFrame([(1, "write a@b.de or a@b.com now"), (2, "nothing"), (3, None)], "doc_id bigint, text string")
    assert [r["text"] for r in masked(docs).orderBy("doc_id").collect()] == ["write [email] or [email] now", "nothing", None]


def test_digest(spark):
    row = op5_personal_data(spark, DATA).where("n_email > 0").first()
    base = ",".join(x for x in row["spans"].split(",") if re.match("email|ip|card|phone", x))
    assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
