"""Language identification as inference in a mixture of languages.

Every word is a draw from one of the document's languages, with a likelihood from smoothed counts of its
letter trigrams (spaces at both ends) in that language's training texts. Expectation-maximisation estimates the
document's proportions. The set of languages is chosen by penalised likelihood: the languages enter in the
order of their proportions as long as log-likelihood minus ``(size of the set / 2) log(words)`` rises.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fityard.llm.textcols import U64, mix

LOG_GRAMS = 16        # trigrams are counted in 2^LOG_GRAMS buckets
SMOOTHING = 0.5
FULL_STEPS = 8
SET_STEPS = 6
PIECE_CHARS = 1 << 20


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """For every code point its lower case if it is a letter, else 0."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def _code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around every letter and after each word's last, where words begin in them, and where
    each text's words begin."""
    points = _code_points(texts)
    low = _letter_table()[points]
    # Around a letter: the one before, itself, the one after; what isn't a letter is 0, a word's end.
    before, after = np.concatenate([[0], low[:-1]]).astype(np.uint32), np.concatenate([low[1:], [0]]).astype(np.uint32)
    here = np.flatnonzero(low)
    first = before[here] == 0
    key = (before[here].astype(U64) << U64(42)) | (low[here].astype(U64) << U64(21)) | after[here].astype(U64)
    bucket = (mix(key) >> U64(64 - LOG_GRAMS)).astype(np.int64)
    words = np.flatnonzero(first)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], ends])
    return bucket, words, np.searchsorted(here[words], starts)


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE_CHARS:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def is_held_out(column: str) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(column).cast("string")) % 4 == 2


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and log-probability of every trigram bucket (column) in each (row), from all given rows.

    Rows with a null text or language count for nothing. Each task sends at most one row for each language and
    bucket that it has seen."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                sums = total.setdefault(lang, np.zeros(1 << LOG_GRAMS, dtype=np.int64))
                for a, b in _runs(own):
                    bucket, _, _ = grams(own[a:b])
                    sums += np.bincount(bucket, minlength=1 << LOG_GRAMS)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            if not len(at):
                at = np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at])],
                names=["lang", "bucket", "n"])

    known = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    counts = (known.filter("text is not null and lang is not null")
              .mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    by_lang: dict[str, np.ndarray] = {}
    for row in counts.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).toLocalIterator():
        table = np.zeros(1 << LOG_GRAMS)
        table[row["b"]] = row["n"]
        by_lang[row["lang"]] = table
    langs = sorted(by_lang)
    if not langs:
        return [], np.zeros((0, 1 << LOG_GRAMS), np.float32)
    table = np.array([by_lang[x] for x in langs]) + SMOOTHING
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _em(like: np.ndarray, at: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text and its log-likelihood. ``like``: words by languages, scaled by word; ``at``: where
    the words of each text begin (no text is empty); ``start``: first proportions, 0 for languages left out."""
    size = np.diff(np.concatenate([at, [len(like)]]))
    share = start
    for _ in range(steps):
        joint = like * np.repeat(share, size, axis=0)
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, at, axis=0) / size[:, None]
    total = (like * np.repeat(share, size, axis=0)).sum(axis=1)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-300)), at)


def proportions(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Language proportions (columns) of every text; all 0 for a text without letters."""
    out = np.zeros((len(texts), len(table)))
    for a, b in _runs(texts):
        bucket, words, text_at = grams(texts[a:b])
        some = np.flatnonzero(np.diff(text_at) > 0)
        if not len(some):
            continue
        log = np.add.reduceat(table[:, bucket], words, axis=1).T.astype(np.float64)
        like = np.exp(np.maximum(log - log.max(axis=1, keepdims=True), -60))
        at = text_at[some]
        size = np.diff(np.concatenate([at, [len(like)]]))
        k = like.shape[1]
        full, _ = _em(like, at, np.full((len(some), k), 1 / k), FULL_STEPS)
        order = np.argsort(-full, axis=1, kind="stable")
        best, best_score = np.zeros_like(full), np.full(len(some), -np.inf)
        open_ = np.arange(len(some))
        for m in range(1, k + 1):  # texts whose score still rises
            mask = np.zeros((len(open_), k))
            np.put_along_axis(mask, order[open_, :m], 1.0, axis=1)
            start = np.maximum(full[open_], 1e-6) * mask
            rows = np.repeat(np.isin(np.arange(len(some)), open_), size)
            sub_at = np.concatenate([[0], np.cumsum(size[open_])[:-1]])
            share, loglike = _em(like[rows], sub_at, start / start.sum(axis=1, keepdims=True), SET_STEPS if m > 1 else 0)
            score = loglike - m / 2 * np.log(size[open_])
            up = score > best_score[open_]
            best[open_[up]], best_score[open_[up]] = share[up], score[up]
            open_ = open_[up]
            if not len(open_):
                break
        out[a + some] = best
    return out


def identify(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """``(id_col, lang_pred, score, languages)`` for every row of ``docs``; learned from ``training`` alone.

    ``languages`` maps each language of the chosen set to its proportion; ``lang_pred`` is the one with the largest
    (the first by name on ties), ``score`` its proportion. A null text, one without letters, and any text if
    nothing was learned: ``und``, 0 and an empty map. Repeated rows and null ids are judged like others.
    """
    langs, table = fit(training, text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                rows = batch.slice(a, 1024)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                p = proportions(texts, sent.value) if langs else np.zeros((len(texts), 0))
                known = p.sum(axis=1) > 0
                at = p.argmax(axis=1) if langs else np.zeros(len(texts), int)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([langs[j] if ok else "und" for j, ok in zip(at, known)], pa.string()),
                     pa.array(np.minimum(p[np.arange(len(p)), at], 1.0) if langs else np.zeros(len(p))),
                     pa.array([[(langs[j], float(x)) for j, x in enumerate(row) if x > 0] for row in p],
                              pa.map_(pa.string(), pa.float64()))],
                    names=["id", "lang_pred", "score", "languages"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = rows.mapInArrow(predict, f"id {kind}, lang_pred string, score double, languages map<string,double>")
    return out.withColumnRenamed("id", id_col)
