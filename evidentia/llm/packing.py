"""Packing token sequences by best-two-fit."""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_rows, kept_by_worker, stored

#: Pieces that are packed together; blocks grow in number with the pieces, not in size.
BLOCK = 8192
#: Words whose ids a worker keeps; beyond it, it starts anew.
KEPT_WORDS = 1 << 18
TOKENIZER = "word_bpe_49k.json"
#: A word of Latin letters between ASCII signs: each part is a token run of its own for the tokenizer.
PLAIN_WORD = re.compile(rb"([!-&(-/:-@\[-`{-~]*)([A-Za-z]+|(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


#: What a tokenizer's file says if its ids are those of its words: blanks part them and are dropped.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordIds:
    """Ids of whole texts by a tokenizer file, just as the tokenizer itself gives them.

    With a file as in BY_WORD, tokens never reach across white space: ids come word by word from a bounded store. Texts
    that hold the string of an added token, which counts before any word does, and all texts of other files go to the
    tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        self.by_word = all(stated.get(k) == v for k, v in BY_WORD.items()) and stated["model"].get("type") == "BPE"
        self.added = [t["content"] for t in stated.get("added_tokens", ())]
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {b"": b""}
        # The model's byte alphabet: visible Latin-1 characters stand for themselves, the rest follow from 256 on.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.alphabet = "".join(chr(b if b in seen else next(rest)) for b in range(256))

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def encoded_part(self, part: bytes) -> bytes:
        """As encoded(), for a part that is one lower-case token run: only the model itself is asked."""
        return np.array([t.id for t in self.model.tokenize(part.decode("latin-1").translate(self.alphabet))], "<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        if len(self.parts) + len(words) > KEPT_WORDS:
            self.parts = {b"": b""}
        plain, other = {}, []
        for w in words:
            if (m := PLAIN_WORD.fullmatch(w)) is None:
                other.append(w)
            else:
                plain[w] = (m[1], m[2].decode().lower().encode(), m[3])
        part = self.parts
        for p in {p for ps in plain.values() for p in ps if p not in part}:
            part[p] = self.encoded_part(p)
        self.words.update((w, part[a] + part[b] + part[c]) for w, (a, b, c) in plain.items())
        if other:
            self.words.update(zip(other, self.encoded(other)))

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if not self.by_word or any(t in text for t in self.added):
            return self.encoded([text.encode()])[0]
        words = text.encode().split()
        found = list(map(self.words.get, words))
        if None in found:
            new = {w for w, f in zip(words, found) if f is None}
            if len(self.words) + len(new) > KEPT_WORDS:
                self.words.clear()
                new = set(words)
            self.learn(new)
            found = list(map(self.words.__getitem__, words))
        return b"".join(found)


def word_ids(name: str) -> WordIds:
    """The worker's store for a tokenizer file, given by its path or its name among the public tokenizers."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    return kept_by_worker("words", name, lambda: WordIds(name))


def pieces(documents: DataFrame, most: int = 2048, tokenizer: str = TOKENIZER, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked, ids (little-endian bytes).

    A document is the ids of its whole text (null: none), as the unchanged tokenizer gives them (the string of a special
    token is that token), then end_id; only longer ones than `most` are cut.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def cut(batches):
        ids_of, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in few_rows(batches):
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = memoryview(ids_of.ids(text or "") + end)
                for piece, start in enumerate(range(0, len(ids) // 4, most)):
                    own = ids[4 * start : 4 * (start + most)]
                    at.append(i)
                    rows.append((piece, start, len(own) // 4, zlib.crc32(own), *[bytes(own)] * with_ids))
            columns = list(zip(*rows)) or [()] * (len(names) - 1)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def best_two_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each piece of 1 to `most` tokens.

    A bin takes the longest piece left, and then, again and again, the longest that fits. If room is left, its shortest
    piece gives way to the two pieces left that fill its place and the room best, if they leave less room than it did;
    this is repeated while it helps.
    """
    order = np.argsort(-lengths, kind="stable")
    ends = np.searchsorted(-lengths[order], -np.arange(most + 1), side="right")  # by length: where its pieces end in order
    left = np.bincount(lengths, minlength=most + 1)
    sizes = np.arange(most + 1)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fit = np.zeros(most + 1, np.int64)  # the longest length left up to each length; 0: none

    def refresh(n: int) -> None:
        if left[n] == 0 or left[n] == 1:  # only then can the table differ
            np.maximum.accumulate(np.where(left > 0, sizes, 0), out=fit)

    def take(n: int) -> None:
        left[n] -= 1
        if left[n] == 0:
            refresh(n)

    np.maximum.accumulate(np.where(left > 0, sizes, 0), out=fit)
    number = 0
    while fit[most]:
        own, room = [], most
        while room and (n := int(fit[room])):
            take(n)
            own.append(n)
            room -= n
        while room and fit[most]:
            small = own[-1]
            gap = room + small
            first = sizes[1:gap]
            second = fit[gap - first]
            # Two of one length need two of them left.
            good = (left[1:gap] > 0) & (second > 0) & ((second != first) | (left[1:gap] > 1))
            both = np.where(good, first + second, 0)
            k = int(both.argmax()) if len(both) else 0
            if not len(both) or both[k] <= small:
                break
            a, b = int(first[k]), int(second[k])
            own.pop()
            left[small] += 1
            refresh(small)
            take(a)
            take(b)
            own += sorted((a, b), reverse=True)
            own.sort(reverse=True)
            room = gap - a - b
        at = 0
        for n in own:
            ends[n] -= 1
            bins[order[ends[n]]], offsets[order[ends[n]]] = number, at
            at += n
        number += 1
    return bins, offsets


def packed(parts: DataFrame, most: int = 2048, block: int = BLOCK) -> DataFrame:
    """parts, as from `pieces`, with sequence_id and offset: blocks of about `block` pieces are packed side by side.

    The pieces are dealt over the blocks in turn, so that blocks are even whatever repeats; a block's last sequence may
    be left unfilled.
    """
    parts = stored(parts.withColumn("turn", F.monotonically_increasing_id()), "pieces")
    blocks = max(1, -(-parts.count() // block))
    fields = [f"{n} {t}" for n, t in parts.dtypes if n != "turn"]

    def pack(rows: pa.Table) -> pa.Table:
        bins, offsets = best_two_fit(rows["length"].to_numpy(), most)
        numbers = (rows["block"].to_numpy().astype(np.int64) << 32) + bins
        return rows.drop_columns(["turn", "block"]).append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(offsets))

    dealt = parts.withColumn("block", F.pmod(F.xxhash64("turn"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(pack, ", ".join([*fields, "sequence_id bigint", "offset bigint"]))


def sequences(documents: DataFrame, most: int = 2048, **options) -> DataFrame:
    """The packed pieces of whole documents: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null or empty text is end_id alone; repeated rows are documents each; a null doc_id is carried; an empty table
    gives no rows. Columns beside doc_id and text are not read.
    """
    return packed(pieces(documents, most, **options), most)


def op10_best_two_fit(spark, sf_dir: str) -> DataFrame:
    return sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
