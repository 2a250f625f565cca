"""Importance resampling of documents towards a target text distribution, on hashed word features.

Texts are lower-cased in ASCII and cut by an untrained Split pre-tokenizer on a pattern, which returns words with offsets. The
words of a piece are put next to each other, one space between them; a feature of n words is then the window from the start of one
offset pair to the end of the n-1 next, so no feature is ever built as a string of its own. Features are counted in
``n_buckets`` buckets by CRC-32, over all documents and over all target texts; a bucket's gain is the logarithm of its
smoothed share in the target over that in the documents, in thousandths, rounded down. A document's weight is the mean
gain of its features. Gumbel noise, a function of seed and id alone, turns the highest scores into a draw without
replacement.

Each text is cut once: what a document needs later, its buckets and how often they occur, is written to the shared
folder and read for the counts and for the weights.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from fityard.functions import row_index
from fityard.runtime import written

# Fixed value: what a word is, in texts whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N_BUCKETS = 10_000
# Texts are cut in pieces of about so many bytes, at a byte that is in no word.
PIECE = 1 << 16
_BREAK = bytes(b for b in range(128) if not (48 <= b < 58 or 97 <= b < 123))


@lru_cache(maxsize=4)
def _splitter(pattern: str) -> Split:
    return Split(Regex(pattern), behavior="removed", invert=True)


def _pieces(text: bytes, limit: int = PIECE) -> Iterator[bytes]:
    """The text in pieces that no word crosses; a longer run without a break is a piece of its own."""
    at = 0
    while len(text) - at > limit:
        to = at + limit
        while to < len(text) and text[to] not in _BREAK:
            to += 1
        yield text[at:to]
        at = to
    yield text[at:]


def words_of(text: str | None, pattern: str = WORD) -> Iterator[list[tuple[str, tuple[int, int]]]]:
    """Words of each piece of a text, with their offsets in it; A-Z are lower-cased."""
    for piece in _pieces((text or "").encode().lower()):
        yield _splitter(pattern).pre_tokenize_str(piece.decode())


def text_buckets(text: str | None, n_words: int = 1, n_buckets: int = N_BUCKETS) -> tuple[int, Counter]:
    """Number of words, and how often each bucket occurs among the runs of 1 to ``n_words`` words."""
    total, buckets = 0, Counter()
    crc = zlib.crc32
    before: list[bytes] = []  # last words of what came before, for runs over a cut
    for found in words_of(text):
        words = [*before, *(w.encode() for w, _ in found)]
        joined = memoryview(b" ".join(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start, end = (end - size).tolist(), end.tolist()
        old = len(before)
        for n in range(1, n_words + 1):
            # Runs that end in a word of this piece.
            first = max(old - n + 1, 0)
            buckets.update(crc(joined[a:b]) % n_buckets for a, b in zip(start[first:], islice(end, first + n - 1, None)))
        total += len(found)
        before = words[max(len(words) - n_words + 1, 0):] if n_words > 1 else []
    return total, buckets


def bucket_table(texts: DataFrame, n_words: int = 1, n_buckets: int = N_BUCKETS) -> DataFrame:
    """``(row, n_words, n_features, buckets, counts)`` of ``texts`` (row, text); the last two are arrays of unsigned 32-bit
    integers as binary, buckets ascending. Null texts have no words."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                made = []
                for text in part.column(1):
                    n, found = text_buckets(text.as_py(), n_words, n_buckets)
                    at = np.array(sorted(found), dtype="<u4")
                    many = np.array([found[b] for b in at.tolist()], dtype="<u4")
                    made.append((n, int(many.sum()), at.tobytes(), many.tobytes()))
                n, m, at, many = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(at, pa.binary()),
                     pa.array(many, pa.binary())], names=["row", "n_words", "n_features", "buckets", "counts"])

    kind = texts.schema["row"].dataType.simpleString()
    return texts.select("row", F.col("text").cast("string").alias("text")).mapInArrow(
        cut, f"row {kind}, n_words bigint, n_features bigint, buckets binary, counts binary")


def _of_batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each entry, bucket and count, of a batch with columns ``buckets`` and ``counts``."""
    at = np.array([len(b) // 4 for b in batch.column("buckets").to_pylist()], dtype=np.int64)
    both = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").astype(np.int64) for c in ("buckets", "counts")]
    return np.repeat(np.arange(batch.num_rows), at), *both


def histogram(table: DataFrame, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of a ``bucket_table``. Tasks add up their own rows first; what is
    collected has at most a row per bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            _, at, many = _of_batch(batch)
            np.add.at(total, at, many)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(n_buckets, dtype=np.int64)
    for row in (table.select("buckets", "counts").mapInArrow(count, "bucket bigint, n bigint")
                .groupBy("bucket").agg(F.sum("n").alias("n")).collect()):
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t + 1)(S + n) / ((s + 1)(T + n))))`` of every bucket, in doubles."""
    n = len(source)
    whole_s, whole_t = float(int(source.sum()) + n), float(int(target.sum()) + n)
    return np.array([floor(1000 * log((t + 1.0) * whole_s / ((s + 1.0) * whole_t)))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def with_weight(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(row, n_words, n_features, weight)``: the mean gain of a row's features, rounded down; 0 without any."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, many = _of_batch(batch)
            total = np.zeros(batch.num_rows, dtype=np.int64)
            np.add.at(total, row, gain[at] * many)
            n = np.asarray(batch.column("n_features"))
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())],
                                             names=["row", "n_words", "n_features", "weight"])

    kind = table.schema["row"].dataType.simpleString()
    return table.mapInArrow(add, f"row {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", seed: int = 2024, percent: int = 10, least_words: int = 20,
             n_words: int = 1, n_buckets: int = N_BUCKETS) -> DataFrame:
    """``(id_col, n_features, weight, score, rank)`` for every row of ``docs``, whole texts; all long.

    Drawn are the ``floor(percent * N / 100)`` highest scores of the N rows with at least ``least_words`` words, ranked
    from 1, ties to the smaller id; ``rank`` is null for all others. Null and empty texts have no features and weight 0.
    A null id has the noise of an empty one and comes last on ties. Rows that repeat an id have the same
    noise and are ranked one by one, ties to fewer features. Other columns aren't read. With an empty table there are
    no rows; with an empty target all its counts are 0.

    Only rows whose score can be drawn are brought into order, and they are dealt by ranges of score and id, so that many
    equal scores don't meet in one task. How many rows have a score is counted first, in a table with a row for
    each score: scores are whole thousandths of a logarithm, fewer than 100,000 of them.
    """
    rows = docs.select(docs[id_col].cast("bigint").alias("row"), docs[text_col].alias("text"))
    table = written(bucket_table(rows, n_words, n_buckets), "buckets")
    wanted = bucket_table(target.select(F.lit(0).alias("row"), target[target_text_col].alias("text")), n_words, n_buckets)
    gain = gains(histogram(table, n_buckets), histogram(wanted, n_buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("bigint")
    scored = written(with_weight(table, gain).withColumn("score", F.col("weight") + noise), "scored")
    fit = scored.filter(F.col("n_words") >= least_words)
    counts = fit.groupBy("score").agg(F.count("*").alias("n")).toPandas().sort_values("score", ascending=False)
    drawn = percent * int(counts["n"].sum()) // 100
    out = [F.col("row").alias(id_col), "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*out, F.lit(None).cast("bigint").alias("rank"))
    reached = counts["n"].cumsum().to_numpy() >= drawn
    lowest = int(counts["score"].to_numpy()[reached.argmax()])
    inside = (F.col("n_words") >= least_words) & (F.col("score") >= lowest)
    order = scored.filter(inside).withColumn("down", -F.col("score")).withColumn("last", F.col("row").isNull())
    placed = row_index(order, ["down", "last", "row", "n_features", "weight"], out="place")
    place = F.col("place") + 1
    return (placed.select(*out, F.when(place <= drawn, place).cast("bigint").alias("rank"))
            .unionByName(scored.filter(~inside).select(*out, F.lit(None).cast("bigint").alias("rank"))))
