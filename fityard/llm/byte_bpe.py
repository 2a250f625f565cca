"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

The vocabulary is a public tokenizer file, given by its path. A text is cut into words by the usual
byte-level pattern; words are merged one by one and remembered, so that a frequent word is merged once
per task. A word's parts are held as two parallel lists: part ids and the merge rank of every adjacent
pair. The smallest rank is found by scanning, its boundary is deleted, and only the two neighbouring
ranks are looked up again. Scanning is quadratic in the length of a word, so words beyond
``SHORT_WORD`` bytes take the same merges in the same order from a heap over linked parts.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

SHORT_WORD = 256
# Words remembered while a task runs; when full, the memory is emptied (results don't depend on it).
REMEMBERED = 250_000
NO_RANK = 1 << 60


def _char_class(kind: str) -> str:
    """Body of a character class with all code points of a general category (its first letter)."""
    spans, start = [], None
    for point in range(sys.maxunicode + 2):
        inside = point <= sys.maxunicode and unicodedata.category(chr(point))[0] == kind
        if inside and start is None:
            start = point
        elif not inside and start is not None:
            spans.append(f"\\U{start:08x}-\\U{point - 1:08x}")
            start = None
    return "".join(spans)


@lru_cache(maxsize=1)
def word_pattern() -> re.Pattern:
    """The byte-level pre-tokenizer's pattern, written for ``re``. Its white space is Unicode's
    White_Space property, which lacks the four separators U+001C to U+001F that ``\\s`` has here."""
    letter, number = _char_class("L"), _char_class("N")
    space = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
                      f"|[{space}]+(?![^{space}])|[{space}]+")


def _byte_chars() -> dict[str, int]:
    """Printable stand-in of each byte in a byte-level vocabulary: Latin-1's visible characters stand for
    themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of one byte-level BPE file (``tokenizers`` JSON: vocabulary, ordered merges,
    added tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, stand_in = spec["model"], _byte_chars()
        vocab = model["vocab"]
        bytes_of = {i: bytes(stand_in[c] for c in token) for token, i in vocab.items()}
        self.byte_id = [vocab[c] for c, _ in sorted(stand_in.items(), key=lambda x: x[1])]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []  # by rank
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            key = vocab[left] << 32 | vocab[right]
            self.ranks.setdefault(key, rank)
            self.merged.append(vocab[left + right])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        bytes_of.update({i: t.encode() for t, i in self.added.items()})
        tokens = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.token_size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge_short(self, parts: list[int]) -> list[int]:
        """Rank array: scan for the first smallest rank, delete that boundary, refresh its neighbours."""
        rank_of = self.ranks.get
        ranks = [rank_of(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = whole = self.merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(whole << 32 | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 32 | whole, NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges (smallest rank first, leftmost on ties) with a heap, n log n."""
        n, rank_of = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1)
                if (r := rank_of(parts[i] << 32 | parts[i + 1], NO_RANK)) < NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i] = whole = self.merged[rank]
            parts[j], after[i] = -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank_of(whole << 32 | parts[after[i]], NO_RANK)) < NO_RANK:
                    heapq.heappush(heap, (r, i, whole, parts[after[i]]))
            if (h := before[i]) >= 0 and (r := rank_of(parts[h] << 32 | whole, NO_RANK)) < NO_RANK:
                heapq.heappush(heap, (r, h, parts[h], whole))
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            parts = [*map(self.byte_id.__getitem__, word.encode())]
            parts = self.merge_short(parts) if len(parts) <= SHORT_WORD else self.merge_long(parts)
            ids = struct.pack(f"<{len(parts)}I", *parts)
            if len(word) <= 64:
                self.words[word] = ids
        return ids

    def forget(self) -> None:
        """Empty what is remembered: a worker outlives its task."""
        self.known.clear()
        self.words.clear()

    def _piece(self, piece: str) -> bytes:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        return b"".join(map(self._word, word_pattern().findall(piece)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.split_added is None:
            return self._encode_plain(text)
        parts = self.split_added.split(text) if any(t in text for t in self.added) else [text]
        return b"".join(self.added[p].to_bytes(4, "little") if i % 2 else self._encode_plain(p)
                        for i, p in enumerate(parts))

    def _encode_plain(self, text: str) -> bytes:
        # A word never runs over a space that touches a visible character on its left or on its right, so
        # pieces between such spaces can be encoded on their own, and remembered.
        if LONE_SPACES.search(text):
            return self._piece(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        first, *pieces = text.split(" ")
        out = [*map(known.get, pieces)]
        for i, ids in enumerate(out):
            if ids is None:
                piece = pieces[i]
                out[i] = ids = self._piece(" " + piece)
                if len(piece) <= 64:
                    known[piece] = ids
        return self._piece(first) + b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that aren't UTF-8 become U+FFFD."""
        size = self.token_size[ids]
        at = np.repeat(self.token_start[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.token_bytes[at].tobytes().decode("utf-8", "replace")


# White space, a space, and again white space or the end: such a run is cut by the pattern itself.
LONE_SPACES = re.compile(r"\s \s|\s \Z")


@lru_cache(maxsize=2)
def _loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``(id_col, ids binary, decoded string)`` for every row: token ids as little-endian unsigned 32-bit
    integers, and the text that they decode to.

    No row needs another, so nothing is shuffled, and a lost task is simply run again. The vocabulary is
    one file of a few MB, sent to the executors with the job. A null text counts as empty (no ids, empty
    text); null ids, repeated rows and other columns don't matter; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocab_path)
    name = vocab_path.rstrip("/").rsplit("/", 1)[-1]
    kind = docs.schema[id_col].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(SparkFiles.get(name))
        try:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):  # ids and texts of a few rows at a time
                    rows = batch.slice(a, 256)
                    ids = [bpe.encode(t or "") for t in rows.column(1).to_pylist()]
                    texts = [bpe.decode(np.frombuffer(x, dtype="<u4")) for x in ids]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())],
                        names=["id", "ids", "decoded"])
        finally:
            bpe.forget()

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = rows.mapInArrow(encode, f"id {kind.simpleString()}, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)
