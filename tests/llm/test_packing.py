import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA, ROWS
from tokenizers import Tokenizer

from evidentia.llm.packing import WordIds, best_two_fit, op10_best_two_fit, packed, pieces, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_are_the_tokenizers(tokenizer, texts):
    own = WordIds(PATH)
    strange = ["don't DON'T l'été", "a  b\t\tc\n\n d ", "x\u00a0y\u2003z", "naïve Éa ß ÿ × ÷", "𝒳y 漢字 한국어", "1234.5e-6 $%& a1b2", "\x00\x01 \x1c \x85", "A.B.C...", "", " ", "_a_b__", "ﬁ e\u0301", "<|endoftext|> <s>", "''s 'S 'll", "<|startoftext|>", "a<|endoftext|>b c", "one two <|startoftext|>three<|endoftext|>", "<|ENDOFTEXT|> <|end of text|>", "x <|endoftext|><|endoftext|>\n"]
    for text in [*strange, *(t for _, t in texts)]:
        assert list(np.frombuffer(own.ids(text or "") + b"\0\0\0\0", "<u4")) == ids_of(tokenizer, text), text[:200]


def test_special_tokens_are_the_tokenizers(spark, tokenizer):
    texts = ["<|endoftext|>", "before<|startoftext|> after", None, "word " * 3000 + "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    held(sequences(docs).collect(), list(enumerate(texts)), tokenizer)
    assert 49407 in ids_of(tokenizer, texts[0])


def test_other_tokenizer_files():
    """A file whose tokens keep blanks is asked for whole texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, other = WordIds(path), Tokenizer.from_file(path)
    assert not own.by_word
    for text in ("", " two  words\n", "A<|endoftext|>b"):
        assert list(np.frombuffer(own.ids(text), "<u4")) == other.encode(text, add_special_tokens=False).ids


def held(rows, docs, tokenizer, most=2048):
    """Pieces put end to end are their documents, and places in sequences are gapless."""
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= most
    wanted = {}
    for i, text in docs:
        ids = ids_of(tokenizer, text)
        cut = [ids[a : a + most] for a in range(0, len(ids), most)]
        wanted.setdefault(i, []).extend((n, n * most, len(c), zlib.crc32(struct.pack(f"<{len(c)}I", *c))) for n, c in enumerate(cut))
    assert {i: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own) for i, own in by.items()} == {i: sorted(w) for i, w in wanted.items()}
    return len(bins)


def test_whole_table(spark, texts, tokenizer):
    rows = op10_best_two_fit(spark, DATA).collect()
    n = held(rows, texts, tokenizer)
    assert n <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_awkward_rows(spark, awkward, empty, tokenizer):
    held(sequences(awkward).collect(), [(i, t) for i, t, *_ in ROWS], tokenizer)
    assert sequences(empty).count() == 0


def test_blocks(spark, documents):
    parts = pieces(documents)
    rows = packed(parts, block=32).collect()
    assert len(rows) == parts.count() and len({r["sequence_id"] >> 32 for r in rows}) > 3


def test_two_for_one():
    """60 leaves a gap of 40; greedy takes 30 and leaves 10; two pieces of 20 fill the place of the 30."""
    bins, offsets = best_two_fit(np.array([60, 30, 20, 20, 31]), 100)
    sums = np.bincount(bins, [60, 30, 20, 20, 31])
    assert sums.max() == 100 and len(sums) == 2


def test_bins_hold(tokenizer):
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2049, 3000), rng.integers(1, 60, 3000), np.full(500, 1025), np.full(100, 2048), np.array([1])):
        bins, offsets = best_two_fit(lengths, 2048)
        sums = np.bincount(bins, lengths)
        assert sums.max() <= 2048 and sums.min() > 0
        assert len(sums) <= max(-(-lengths.sum() // 2048) * 1.25 + 1, (lengths > 1024).sum() + 1)
