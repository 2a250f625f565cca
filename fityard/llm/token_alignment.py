"""Alignment of the tokens that two tokenizers make of the same texts, and what it says about pairs of their ids.

Side A is a byte-level BPE file (``tokenizers``), fed a space and the text; side B is a ``sentencepiece`` model, fed the text, to
which it adds the space itself. Tokens of both sides tile the same bytes. Per slab of texts, both sides are tables of (document,
start, end, id), and ``merge_asof``, keyed by document, finds for every token start the token of the other side that
covers it. The union of both directions is all overlaps; overlaps that end together are links, and their ends cut the
document into groups.

If two tokens end together, the bytes of one are the end of the other's. So the pairs of ids that can ever be linked
are known from the two vocabularies alone, some hundred thousand, and a corpus-wide count of links is one array of
that length: added up in every task, then summed, then sent to all tasks. No link is shuffled.

A text is cut into pieces before single spaces between visible characters. No token of either side crosses such a cut (it is
checked for the files given; otherwise a text is one piece), so equal pieces of a slab are encoded once, and a
long text is worked through in slabs with only its running totals held.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fityard.llm.byte_bpe import _byte_chars
from fityard.runtime import written

SLAB = 1 << 20  # characters that are aligned together, about; one longer piece is a slab of its own
CUT = re.compile(r"(?<=\S) (?=\S)")
JOINED = 64     # pieces that side B encodes in one go
# Fixed value: the byte-level pre-tokenizer's pattern.
WORDS = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


class Tokenizers:
    """Both tokenizers, the bytes of their ids, and the pairs of ids that can end together."""

    def __init__(self, bpe_path: str, piece_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.a = Tokenizer.from_file(bpe_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_path)
        byte_of = _byte_chars()
        vocab = self.a.get_vocab(with_added_tokens=False)
        a_bytes = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        b_bytes = {i: (bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
                   for i, p in enumerate(pieces) if not self.b.is_control(i) and not self.b.is_unknown(i)}
        added = self.a.get_added_tokens_decoder().values()
        self.ranked = _ranked(bpe_path, vocab, a_bytes, {t.content for t in added})
        self.cuts = (not any(re.search("[^▁]▁", p) for i, p in enumerate(pieces) if i in b_bytes and not self.b.is_byte(i))
                     and isinstance(self.a.pre_tokenizer, pre_tokenizers.ByteLevel) and self.a.normalizer is None
                     and all(t.special for t in added))
        self.a_size, self.a_bytes = _table(a_bytes)
        self.b_size, self.b_bytes = _table(b_bytes)
        self.a_start, self.b_start = (np.cumsum(s) - s for s in (self.a_size, self.b_size))
        self.keys = ending_together(a_bytes, b_bytes)
        self.texts_of = [[np.array([f"{i}{end}" for i in range(len(size))], dtype=object) for end in (",", sign)]
                         for size, sign in ((self.a_size, "|"), (self.b_size, ";"))]

    def _encoded_a(self, text: str) -> np.ndarray:
        if self.ranked is not None:
            return self.ranked.encode_to_numpy(text).astype(np.int64)
        return np.array(self.a.encode(text, add_special_tokens=False).ids, dtype=np.int64)

    def encode(self, pieces: list[str]) -> tuple[list, np.ndarray, np.ndarray]:
        """Of both sides the ids of all pieces, where each piece's begin, and its bytes; which pieces are given back by
        both sides; and how many bytes each has, with the space before it."""
        plain = [i for i, p in enumerate(pieces) if " " not in p and "▁" not in p and p == p.strip()] if self.cuts else []
        odd = np.setdiff1d(np.arange(len(pieces)), plain).tolist()
        texts = [pieces[i] for i in plain]
        together = self._joined(texts)
        if together is None:  # some normalisation: each on its own
            plain, odd, together = [], list(range(len(pieces))), self._joined([])
        (a, a_at), (b, b_at), size = together
        own_a = [self._encoded_a(" " + pieces[i]) for i in odd]
        own_b = [np.array(x, dtype=np.int64) for x in self.b.encode([pieces[i] for i in odd], num_threads=1)] if odd else []
        a, a_at = _extended(a, a_at, own_a)
        b, b_at = _extended(b, b_at, own_b)
        place = np.empty(len(pieces), dtype=np.int64)
        place[[*plain, *odd]] = np.arange(len(pieces))
        fine = np.ones(len(pieces), dtype=bool)
        sizes = np.concatenate([size, [len(pieces[i].encode()) + 1 for i in odd]]).astype(np.int64)[place]
        for i in odd:
            k, wanted = place[i], (" " + pieces[i]).encode()
            fine[i] = all(self._bytes(side, ids[at[k]:at[k + 1]]) == wanted for side, ids, at in ((0, a, a_at), (1, b, b_at)))
        return [(a, a_at[:-1][place], np.diff(a_at)[place]), (b, b_at[:-1][place], np.diff(b_at)[place])], fine, sizes

    def _joined(self, pieces: list[str]):
        """Both sides of pieces without spaces, encoded next to each other; nothing if their bytes don't come back."""
        if not pieces:
            return (np.zeros(0, np.int64), np.zeros(1, np.int64)), (np.zeros(0, np.int64), np.zeros(1, np.int64)), np.zeros(0)
        text = " " + " ".join(pieces)
        wanted = np.frombuffer(text.encode(), dtype=np.uint8)
        begin = np.append(np.flatnonzero(wanted == 0x20), len(wanted))
        a = self._encoded_a(text)
        b = self.b.encode([" ".join(pieces[i:i + JOINED]) for i in range(0, len(pieces), JOINED)], num_threads=1)
        b = np.fromiter(chain.from_iterable(b), np.int64)
        out = []
        for side, ids in enumerate((a, b)):
            if not np.array_equal(np.frombuffer(self._bytes(side, ids), np.uint8), wanted):
                return None
            ends = np.cumsum((self.a_size, self.b_size)[side][ids])
            out.append((ids, np.concatenate([[0], np.searchsorted(ends, begin[1:]) + 1])))
        return *out, np.diff(begin)

    def _bytes(self, side: int, ids: np.ndarray) -> bytes:
        size, start, data = ((self.a_size, self.a_start, self.a_bytes), (self.b_size, self.b_start, self.b_bytes))[side]
        known = ids[ids < len(size)]
        return b"" if len(known) < len(ids) else _gather(data, start[ids], size[ids]).tobytes()


def _ranked(path: str, vocab: dict[str, int], bytes_of: dict[int, bytes], added: set[str]):
    """The same vocabulary as merge ranks for a faster encoder, if merges rank as their results' ids do; else nothing."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    merged = [vocab["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in spec["model"]["merges"]]
    kind = spec["pre_tokenizer"] or {}
    plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
    if merged != sorted(merged) or not plain or spec["normalizer"] or spec["model"].get("ignore_merges"):
        return None
    ranks = {bytes_of[i]: i for token, i in vocab.items() if token not in added}
    return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def _extended(ids: np.ndarray, at: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([ids, *more]), np.concatenate([at, at[-1] + np.cumsum([len(x) for x in more]).astype(np.int64)])


def _table(bytes_of: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    tokens = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
    return np.array([len(t) for t in tokens], dtype=np.int64), np.frombuffer(b"".join(tokens), dtype=np.uint8)


def ending_together(a_bytes: dict[int, bytes], b_bytes: dict[int, bytes]) -> np.ndarray:
    """Ascending keys (a << 32 | b) of all pairs of which one's bytes are the end of the other's."""
    def by_bytes(tokens: dict[int, bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        for i, t in tokens.items():
            if t:
                out.setdefault(t, []).append(i)
        return out

    of_a, of_b, keys = by_bytes(a_bytes), by_bytes(b_bytes), []
    for t, ids in of_a.items():
        for k in range(len(t)):
            keys.extend(a << 32 | b for b in of_b.get(t[k:], ()) for a in ids)
    for t, ids in of_b.items():
        for k in range(1, len(t)):
            keys.extend(a << 32 | b for a in of_a.get(t[k:], ()) for b in ids)
    return np.unique(np.array(keys, dtype=np.int64))


@lru_cache(maxsize=1)
def _loaded(bpe_path: str, piece_path: str) -> Tokenizers:
    return Tokenizers(bpe_path, piece_path)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """``(doc, a, b, ends)`` of all pairs of overlapping tokens, ``a`` and ``b`` their row numbers and ``ends`` whether they end
    together. Both tables have doc, start, end, ascending, and tile the same bytes of each document."""
    keys = [t[["doc", "start"]].assign(other=np.arange(len(t))) for t in (a, b)]
    covering_b = pd.merge_asof(keys[0][["doc", "start"]], keys[1], on="start", by="doc")["other"].to_numpy()
    covering_a = pd.merge_asof(keys[1][["doc", "start"]], keys[0], on="start", by="doc")["other"].to_numpy()
    # Tokens that start together have found each other in both directions.
    later = np.flatnonzero(a["start"].to_numpy()[covering_a] != b["start"].to_numpy())
    at_a = np.concatenate([np.arange(len(a)), covering_a[later]])
    at_b = np.concatenate([covering_b, later])
    return pd.DataFrame({"doc": a["doc"].to_numpy()[at_a], "a": at_a, "b": at_b,
                         "ends": a["end"].to_numpy()[at_a] == b["end"].to_numpy()[at_b]})


@dataclass
class _Totals:
    """What is held of a document while its slabs come by."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_overlaps: int = 0
    same: bool = True
    groups: list[str] = field(default_factory=list)
    digest: object = field(default_factory=hashlib.sha256)
    links: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add_links(self, at: np.ndarray) -> None:
        at, many = np.unique(np.concatenate([np.repeat(*self.links), at]) if len(self.links[0]) else at, return_counts=True)
        self.links = at, many


def _gather(flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    return flat[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())]


def _slab(both: Tokenizers, doc: np.ndarray, pieces: list[str], totals: dict[int, _Totals], keep_groups: bool) -> None:
    """Align the pieces (each with the number of its document, ascending) and add to the documents' totals."""
    unique = list(dict.fromkeys(pieces))
    number = dict(zip(unique, range(len(unique))))
    code = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
    sides, fine, _ = both.encode(unique)
    if not fine.all():
        bad = np.unique(doc[~fine[code]])
        for d in bad:
            totals[d].same = False
        kept = ~np.isin(doc, bad)
        doc, code = doc[kept], code[kept]
        if not len(doc):
            return
    # Pieces of a document stand next to each other, a piece's bytes being a space and its own.
    tables = []
    for (ids, at, many), size in zip(sides, (both.a_size, both.b_size)):
        own = _gather(ids, at[code], many[code])
        end = np.cumsum(size[own])
        tables.append(pd.DataFrame({"doc": np.repeat(doc, many[code]), "start": end - size[own], "end": end, "id": own}))
    a, b = tables
    over = overlaps(a, b)
    ends = over["ends"].to_numpy()
    la, lb = np.sort(over["a"].to_numpy()[ends]), np.sort(over["b"].to_numpy()[ends])  # both ascend with the end
    a_id, b_id, a_doc, b_doc = a["id"].to_numpy(), b["id"].to_numpy(), a["doc"].to_numpy(), b["doc"].to_numpy()
    at = np.searchsorted(both.keys, a_id[la] << 32 | b_id[lb])
    # Of every token its place in the written groups: its own number and the other side's tokens of all groups before,
    # or up to its own group.
    a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
    a_last[la], b_last[lb] = True, True
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    words = np.empty(len(a) + len(b), dtype=object)
    before_b, upto_a = np.concatenate([[0], lb + 1])[a_group], (la + 1)[b_group]
    for ids, last, place, (comma, sign) in ((a_id, a_last, np.arange(len(a)) + before_b, both.texts_of[0]),
                                            (b_id, b_last, np.arange(len(b)) + upto_a, both.texts_of[1])):
        words[place] = np.where(last, sign[ids], comma[ids])
    here, first = np.unique(doc, return_index=True)
    edges = [np.append(np.searchsorted(x, here), len(x)) for x in (a_doc, b_doc, a_doc[la])]
    many = np.bincount(np.searchsorted(here, over["doc"].to_numpy()), minlength=len(here))
    for i, d in enumerate(here):
        t = totals[d]
        (a0, a1), (b0, b1), (g0, g1) = ((int(e[i]), int(e[i + 1])) for e in edges)
        text = "".join(words[a0 + b0:a1 + b1].tolist())[:-1]
        if t.n_groups:
            text = ";" + text
        t.digest.update(text.encode())
        if keep_groups:
            t.groups.append(text)
        t.n_a, t.n_b, t.n_groups, t.n_overlaps = t.n_a + a1 - a0, t.n_b + b1 - b0, t.n_groups + g1 - g0, t.n_overlaps + int(many[i])
        t.add_links(at[g0:g1])


def _pieces(texts: list[str | None], cuts: bool) -> Iterator[tuple[np.ndarray, list[str], list[int]]]:
    """Slabs: document numbers and pieces, and the documents that end with the slab."""
    doc, many, pieces, done, size = [], [], [], [], 0
    for d, text in enumerate(texts):
        parts = (CUT.split(text) if cuts else [text]) if text else []
        at = 0
        while at < len(parts):
            if len(text) <= SLAB:
                to = len(parts)
            else:  # as many pieces as the slab still takes, one at least
                ends = np.cumsum(np.fromiter(map(len, parts[at:at + SLAB]), np.int64) + 1)
                to = at + max(1, int(np.searchsorted(ends, max(SLAB - size, 1))))
            doc.append(d)
            many.append(to - at)
            pieces.extend(parts[at:to])
            size += len(text) if to - at == len(parts) else sum(map(len, parts[at:to]))
            at = to
            if size >= SLAB:
                if at == len(parts):
                    done.append(d)
                yield np.repeat(doc, many), pieces, done
                doc, many, pieces, done, size = [], [], [], [], 0
                if at == len(parts):
                    break
        else:
            done.append(d)
    yield np.repeat(np.array(doc, dtype=np.int64), many), pieces, done


def align_documents(docs: DataFrame, bpe_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
                    keep_groups: bool = True) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_overlaps, groups_sha256, groups, link_at, link_n)`` for every row, whole texts.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of both sides, group by group (null unless ``keep_groups``), its digest is
    lowercase hex. ``link_at`` and ``link_n`` are binary 32-bit integers: which pairs of ids are linked, as positions in
    ``Tokenizers.keys``, and how often. Null and empty texts, and texts whose tokens don't give back their bytes on
    both sides, have no tokens: zeros, an empty digest, no links. Special tokens' strings are plain text. Null ids,
    repeated rows and other columns don't matter; an empty table gives an empty table. Nothing is shuffled.
    """
    names = _sent(docs, bpe_path, piece_path)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _loaded(*map(SparkFiles.get, names))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                texts = rows.column(1).to_pylist()
                totals: dict[int, _Totals] = {}
                out = []
                for doc, pieces, done in _pieces(texts, both.cuts):
                    for d in [*dict.fromkeys(doc.tolist()), *done]:
                        totals.setdefault(d, _Totals())
                    lost = [d for d in dict.fromkeys(doc.tolist()) if not totals[d].same]
                    if lost:
                        alive = ~np.isin(doc, lost)
                        doc, pieces = doc[alive], [p for p, f in zip(pieces, alive) if f]
                    if pieces:
                        _slab(both, doc, pieces, totals, keep_groups)
                    out.extend(_result(totals.pop(d), keep_groups) for d in done)
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *(pa.array(columns[i], pa.int64()) for i in range(4)),
                     *(pa.array(columns[i], pa.string()) for i in (4, 5)), *(pa.array(columns[i], pa.binary()) for i in (6, 7))],
                    names=["id", "n_a", "n_b", "n_groups", "n_overlaps", "groups_sha256", "groups", "link_at", "link_n"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(align, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_overlaps bigint, "
                                  "groups_sha256 string, groups string, link_at binary, link_n binary")


def _result(t: _Totals, keep_groups: bool) -> tuple:
    if not t.same or not t.n_a:
        return 0, 0, 0, 0, "", "" if keep_groups else None, b"", b""
    return (t.n_a, t.n_b, t.n_groups, t.n_overlaps, t.digest.hexdigest(), "".join(t.groups) if keep_groups else None,
            t.links[0].astype("<i4").tobytes(), t.links[1].astype("<i4").tobytes())


def _sent(docs: DataFrame, *paths: str) -> list[str]:
    for path in paths:
        docs.sparkSession.sparkContext.addFile(path)
    return [p.rstrip("/").rsplit("/", 1)[-1] for p in paths]


def link_counts(aligned: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links each of the ``n_pairs`` possible pairs of ids has over all rows of an ``align_documents`` table. Every task
    adds up its own rows; what comes to the driver has at most a row per pair, which the vocabularies bound."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, dtype=np.int64)
        for batch in batches:
            at, many = (np.frombuffer(b"".join(c.to_pylist()), "<i4") for c in batch.columns)
            np.add.at(total, at, many.astype(np.int64))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["at", "n"])

    found = (aligned.select("link_at", "link_n").mapInArrow(add, "at bigint, n bigint")
             .groupBy("at").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(n_pairs, dtype=np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def highest_of_b(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair has the highest count of all pairs of its B id, ties included."""
    b = keys & 0xFFFFFFFF
    top = np.zeros(int(b.max()) + 1 if len(b) else 0, dtype=np.int64)
    np.maximum.at(top, b, counts)
    return counts == top[b]


def id_pairs(aligned: DataFrame, bpe_path: str, piece_path: str) -> DataFrame:
    """``(a, b, n, best)``: linked pairs of ids, their corpus-wide links, and whether none of the B id's pairs has more."""
    keys = _loaded(bpe_path, piece_path).keys
    counts = link_counts(aligned, len(keys))
    some = np.flatnonzero(counts)
    return aligned.sparkSession.createDataFrame(pd.DataFrame({
        "a": keys[some] >> 32, "b": keys[some] & 0xFFFFFFFF, "n": counts[some], "best": highest_of_b(keys, counts)[some]}))


def aligned_documents(docs: DataFrame, bpe_path: str, piece_path: str, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, n_overlaps, groups_sha256)`` for every row.

    A pair's count is the number of its links over all rows. ``n_best``: links whose count is the highest of their B id, ties
    included; ``count_sum``: the sum of the counts of all links of the row. Nulls, empty texts and so on as in
    ``align_documents``, which runs once: its rows are written, without the groups, and read for the counts and again
    for the sums. The counts, some MB whatever the input is, are sent to all tasks.
    """
    aligned = written(align_documents(docs, bpe_path, piece_path, id_col, text_col, keep_groups=False), "aligned")
    keys = _loaded(bpe_path, piece_path).keys
    counts = link_counts(aligned, len(keys))
    sent = docs.sparkSession.sparkContext.broadcast((counts, highest_of_b(keys, counts)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = sent.value
        for batch in batches:
            links, n_best, total = [], [], []
            for at, many in zip(*(batch.column(c).to_pylist() for c in ("link_at", "link_n"))):
                at, many = np.frombuffer(at, "<i4"), np.frombuffer(many, "<i4").astype(np.int64)
                links.append(int(many.sum()))
                n_best.append(int(many[best[at]].sum()))
                total.append(int((count[at] * many).sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], *(pa.array(x, pa.int64()) for x in (links, n_best, total))],
                names=["id", "n_a", "n_b", "n_groups", "n_overlaps", "groups_sha256", "n_links", "n_best", "count_sum"])

    kind = aligned.schema["id"].dataType.simpleString()
    out = (aligned.select("id", "n_a", "n_b", "n_groups", "n_overlaps", "groups_sha256", "link_at", "link_n")
           .mapInArrow(add, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_overlaps bigint, groups_sha256 string, "
                            "n_links bigint, n_best bigint, count_sum bigint"))
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      "n_overlaps", "groups_sha256")
