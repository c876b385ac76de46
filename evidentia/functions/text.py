"""Text functions as column expressions. Every function takes a string column (or its name) and handles null as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns, endings and stop words that define tokens and facts.
TOKEN_SCORING = r"[가-힣]{2,}|[A-Za-z][A-Za-z\-]{2,}|[0-9]+(?:[.,][0-9]+)?"
TOKEN_REVIEW = r"[가-힣]{2,}|[A-Za-z]{3,}|[0-9]+(?:\.[0-9]+)?"
KEYWORD = r"[가-힣]{2,}|[A-Za-z][A-Za-z\-]{2,}"
PARTICLES = "으로부터 에서는 에게서 이라는 라는 에서 에게 으로 까지 부터 이나 나요 까요 인가 는지 은지 하고 와의 과의 은 는 이 가 을 를 에 의 도 만 로 와 과 요".split()
PARTICLES_REVIEW = "으로부터 에서는 에게서 이라는 라는 에서 에게 으로 까지 부터 이나 나요 까요 인가 는지 은지 이랑 하고 와의 과의 은 는 이 가 을 를 에 의 도 만 로 와 과 요".split()
STOPWORDS = "그리고 그런데 하지만 무엇 어떻게 언제 어디 누구 얼마 정도 경우 때문 위해 대해 관련 가능 필요 생각 이런 저런 그런 있나 있을 하나 지금 오늘 제가 저는 제일 너무 조금 많이".split()
MEASURE = r"[0-9]+(?:[.,][0-9]+)?\s*(?:mg|g|kg|ml|mL|L|ng/mL|mg/dL|mmHg|mmol|mEq|IU|mcg|µg|%|개월|세|점|년|일|회|원|정)|[0-9]+\s*(?:ng|mcg)\s*/\s*(?:mL|dL)"
COMPARE = r"[<>≤≥]|이하|이상|미만|초과|이내|grade\s*[0-9]|stage\s*[0-9IV]|Gleason\s*[0-9]|ISUP\s*[0-9]|cT[0-9]|등급|기준|금기|제외"
DOSAGE_FORMS = "정|캡슐|캅셀|시럽|산|주|액|이알|서방정|연질캡슐|정제|현탁액"
DOSES = r"[0-9]+(\.[0-9]+)?\s*(mg|g|ml|mcg|μg|IU|단위)"
INTERROGATIVE = "하나요|되나요|인가요|입니까|알려줘|어떻게|무엇|왜"


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def find_all(c, pattern: str) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(pattern), F.lit(0))


def count_all(c, pattern: str) -> Column:
    return F.regexp_count(_text(c), F.lit(pattern))


def _tokens(c, pattern: str, particles: list[str], stop: list[str]) -> Column:
    ending = f"^(.{{2,}}?)({'|'.join(particles)})$"
    words = F.transform(find_all(c, pattern), lambda w: F.when(w.rlike("[가-힣]"), F.regexp_replace(w, ending, "$1")).otherwise(F.lower(w)))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(*stop))
    return F.array_sort(F.array_distinct(words))


def tokens(c) -> Column:
    """The sorted set of a text's scoring tokens: Hangul words without endings, Latin words, numbers."""
    return _tokens(c, TOKEN_SCORING, PARTICLES, [])


def review_tokens(c) -> Column:
    """The sorted set of a text's content words for reviews: without stop words, numbers without commas."""
    return _tokens(c, TOKEN_REVIEW, PARTICLES_REVIEW, STOPWORDS)


def fact_density(c, measure: str = MEASURE, compare: str = COMPARE) -> Column:
    """How dense measurements and conditions stand in a text, from 0 to 1."""
    n = count_all(c, f"(?iu){measure}") + 0.7 * count_all(c, f"(?iu){compare}")
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), n / F.greatest(F.lit(1.0), F.length(_text(c)) / 500.0) / 4.0))


def normal_key(c, suffixes: str = DOSAGE_FORMS) -> Column:
    """A name without case, spaces, middle dots and one ending of form."""
    bare = F.translate(F.lower(F.trim(_text(c))), " ·", "")
    return F.regexp_replace(bare, f"({suffixes})$", "")


def split_clean(c) -> Column:
    """The parts of a combined name, without parentheses and doses, of 2 to 40 characters."""
    parts = F.split(_text(c), r"[,/|;·]|\s{2,}")
    bare = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"\([^)]*\)", ""), f"(?iu){DOSES}", ""))
    bare = F.transform(bare, lambda p: F.regexp_replace(p, r"^[ .\-·]+|[ .\-·]+$", ""))
    return F.filter(bare, lambda p: F.length(p).between(2, 40))


def keywords(c, most: int = 3) -> Column:
    """A phrase as its longest different words, joined by commas; ties go by the word. A short list stays as it is."""
    phrase = F.trim(_text(c))
    words = F.array_distinct(find_all(phrase, KEYWORD))
    ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.when(F.contains(phrase, F.lit(",")) & (F.length(phrase) < 60), phrase).otherwise(F.array_join(F.transform(F.slice(ranked, 1, most), lambda x: x["w"]), ", "))


def is_sentence(c) -> Column:
    phrase = F.trim(_text(c))
    return (phrase != "") & (phrase.rlike("[?？]") | phrase.rlike(INTERROGATIVE) | (F.length(phrase) > 25))


def without_blocks(c, tag: str = "think") -> Column:
    """A text without its tagged blocks, an unclosed block to the end, and stray tags; trimmed."""
    bare = F.regexp_replace(_text(c), f"(?is)<{tag}>.*?</{tag}>", "")
    bare = F.regexp_replace(F.regexp_replace(bare, f"(?is)<{tag}>.*$", ""), f"(?i)</?{tag}>", "")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def last_place(c: Column, sign: str) -> Column:
    """The number of characters before the last place of sign, or -1."""
    turned = F.instr(F.reverse(c), sign[::-1])
    return F.when(turned > 0, F.length(c) - turned - len(sign) + 1).otherwise(-1)


def safe_cut(c, most: int, signs: tuple[str, ...] = ("다.", ".\n", "\n\n")) -> Column:
    """A text cut to `most` characters, at the last sentence end if that lies beyond the half; right-trimmed if cut."""
    text = _text(c)
    head = F.substring(text, 1, most)
    cut = F.greatest(*[last_place(head, s) for s in signs], F.lit(-1))
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(F.when(cut > most // 2, F.substring(head, F.lit(1), cut + 1)).otherwise(head), r"\s+$", ""))


def fingerprint(c) -> Column:
    """SHA-1 of a text's letters, digits and underscores alone; empty for a text without any."""
    bare = F.regexp_replace(_text(c), r"[^\p{L}\p{N}_]+", "")
    return F.when(bare == "", "").otherwise(F.sha1(bare.cast("binary")))


def paragraphs(c, separator: str = r"\n\s*\n", least: int = 30) -> Column:
    """A text's paragraphs, trimmed; one shorter than `least` is put to the one before, on a new line."""
    parts = F.filter(F.transform(F.split(_text(c), separator), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    last = lambda out: F.element_at(out, -1)
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, p: F.when((F.size(out) > 0) & (F.length(p) < least), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.concat_ws("\n", last(F.concat(F.array(F.lit("")), out)), p)))).otherwise(F.concat(out, F.array(p))),
    )


def chunks(c, size: int, separator: str = "\n\n") -> Column:
    """A text in chunks of about `size` characters that end at paragraphs; a paragraph that is longer stays whole."""
    text = F.regexp_replace(_text(c), r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(text, separator), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"), F.lit(0).alias("used"))

    def step(s, p):
        flush = (s["used"] > 0) & (s["used"] + F.length(p) > size)
        out = F.when(flush, F.concat(s["out"], F.array(s["open"]))).otherwise(s["out"])
        held = F.when(flush | (s["used"] == 0), p).otherwise(F.concat(s["open"], F.lit("\n\n"), p))
        return F.struct(out.alias("out"), held.alias("open"), (F.when(flush, 0).otherwise(s["used"]) + F.length(p) + 2).alias("used"))

    done = F.aggregate(parts, start, step, lambda s: F.when(s["used"] > 0, F.concat(s["out"], F.array(s["open"]))).otherwise(s["out"]))
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) <= size, F.array(text)).otherwise(done)


def language(c) -> Column:
    """The language that a text's script points to; the first script found in order counts."""
    text = _text(c)
    return (
        F.when(text.rlike("[가-힣]"), "ko").when(text.rlike("[\\u4E00-\\u9FFF]"), "zh").when(text.rlike("[\\u3040-\\u30FF]"), "ja")
        .when(text.rlike("[\\u0400-\\u04FF]"), "ru").when(text.rlike("[\\u0600-\\u06FF]"), "ar").otherwise("en")
    )


def first_match(c, pattern: str) -> Column:
    """The first match of a pattern, or null."""
    return F.nullif(F.regexp_extract(_text(c), pattern, 0), F.lit(""))


def cite_ids(c, pattern: str = r"cite-[0-9a-f]{6,32}") -> Column:
    """A text's citation ids, in order of their first place."""
    return F.array_distinct(find_all(c, pattern))


def squeezed(c, most: int) -> Column:
    """A text with runs of blanks and tabs as one blank, trimmed and cut."""
    return F.left(F.trim(F.regexp_replace(_text(c), r"[ \t]+", " ")), F.lit(most))


def compact(c, most: int, mark: str = "...") -> Column:
    """A value as compact JSON, cut with a mark."""
    text = F.to_json(c)
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def prefixed(c, category: Column, prefixes: dict[str, str], default: str, within: int = 250) -> Column:
    """A text after its category's prefix, unless that stands near its start already."""
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    prefix = F.coalesce(F.try_element_at(table, category), F.lit(default))
    return F.when(F.contains(F.left(_text(c), F.lit(within)), prefix), _text(c)).otherwise(F.concat(prefix, F.lit("\n\n"), _text(c)))


def decorated(c, mark: str, addition: str) -> Column:
    """A search phrase with an addition, unless it holds the mark already."""
    return F.when(F.contains(_text(c), F.lit(mark)), _text(c)).otherwise(F.concat_ws(" ", _text(c), F.lit(addition)))


def templated(parts: list[tuple[Column, str]]) -> Column:
    """The lines of those parts whose condition holds, in order."""
    return F.concat_ws("\n", *[F.when(holds, F.lit(line)) for holds, line in parts])


def names_product(c, suffixes: str = DOSAGE_FORMS) -> Column:
    """Whether a name looks like a product's: by its ending, or by any Latin letter."""
    return F.trim(_text(c)).rlike(f"(?:{suffixes})$|[A-Za-z]")
