"""Quality scores by Bradley-Terry ranking of document pairs.

A preference is a pair of labelled documents, one of label 1 and one of label 0; the first is to beat the second with
probability ``sigmoid(utility difference)``. A utility is linear in the features of one text: what share of its bytes,
words and lines is of which kind, cut at ascending limits, and which words of a bounded vocabulary it has. Only
differences are fitted, so a utility has no natural zero. The threshold is a quantile of the utilities of
all documents; its level is where the learned rows are told apart best, and within the sampling error of that level
it moves to the widest gap that the documents leave.

Labelled rows are dealt into blocks by a hash of their ids; a block is one row of a written table and pairs
its own documents, in several rounds of shifted partners. So an evaluation of loss and gradient is one Spark job without a
shuffle, and a lost task makes the same pairs again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fityard.llm import text_classifier
from fityard.llm.text_classifier import text_words
from fityard.llm.textcols import SPACE, U64, buffers, pieces, word_hashes
from fityard.runtime import written

MAX_LABELLED = 20_000   # labelled rows used by a fit, about; chosen by a hash of the id
MAX_BLOCK = 2_500       # labelled rows in a block, about
ROUNDS = 4              # partners of every document of a block's larger class
STEPS = 60
KEEP_SCORE = 0.7        # score of a document whose utility is the threshold
# Utilities are counted on a grid of 1 / GRID between -LIMIT and LIMIT: at most 200,001 numbers whatever the input is.
GRID, LIMIT = 1_000, 100

# Kinds of bytes, and the limits at which a share or a size becomes a feature of its own.
_KINDS = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": (0x20, 0x09),
    "line": (0x0A, 0x0D), "stop": map(ord, ".,;:?!'\"()-"), "bang": (0x21,), "mark": map(ord, "#$%&*+/<=>@[\\]^_`{|}~"),
    "bar": (0x7C,), "control": [*range(9), 11, 12, *range(14, 32), 127], "high": range(128, 256),
}
KINDS = np.zeros((len(_KINDS), 256), dtype=bool)
for _row, _bytes in enumerate(_KINDS.values()):
    KINDS[_row, list(_bytes)] = True
_ENDS = KINDS[[list(_KINDS).index("mark"), list(_KINDS).index("bang")]].any(axis=0)
SHARE_LIMITS = np.array([1e-9, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.16, 0.24, 0.32, 0.5, 0.7, 0.9, 0.97])
SIZE_LIMITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, 128, 256, 512, 1024, 4096, 16384], dtype=float)
N_SHARES, N_SIZES = len(_KINDS) + 3, 3
N_STYLE = N_SHARES * len(SHARE_LIMITS) + N_SIZES * len(SIZE_LIMITS)


def is_held_out(id_col: str | Column) -> Column:
    """crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % 4 == 2


def style_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Boolean (texts, ``N_STYLE``): which limits the shares and sizes of each text reach."""
    def of_texts(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    n = np.diff(offsets)
    some = np.maximum(n, 1)
    words, at = word_hashes(data, offsets)
    counts = np.diff(at)
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(at[:-1], at[1:])], dtype=np.int64)
    inside = ~SPACE[data]
    last = inside.copy()
    if len(data):
        last[:-1] &= ~inside[1:]
        ends = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))] - 1
        last[ends] = inside[ends]
    marked = of_texts(last & _ENDS[data])
    solid = of_texts(inside)
    shares = [of_texts(kind[data]) / some for kind in KINDS]
    shares.append(np.where(counts > 0, 1 - distinct / np.maximum(counts, 1), 0.0))  # words that were there before
    shares.append(marked / np.maximum(counts, 1))                                   # words that end in a mark
    lower, upper = (of_texts(KINDS[k][data]) for k in (0, 1))
    shares.append(upper / np.maximum(lower + upper, 1))
    lines = of_texts(data == 0x0A) + 1
    sizes = [counts, solid / np.maximum(counts, 1), counts / lines]
    return np.concatenate([(np.stack(shares, axis=1)[:, :, None] >= SHARE_LIMITS).reshape(len(n), -1),
                           (np.stack(sizes, axis=1)[:, :, None] >= SIZE_LIMITS).reshape(len(n), -1)], axis=1)


def text_features(column: pa.Array, vocabulary: np.ndarray) -> Iterator[np.ndarray]:
    """Ascending feature numbers of each text: style features first, then the vocabulary's words."""
    data, offsets = buffers(column)
    for a, b in pieces(offsets):
        part, cut = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        style = style_features(part, cut)
        for first, words, at in text_words(column.slice(a, b - a)):
            pos = np.searchsorted(vocabulary, words)
            ok = vocabulary[np.minimum(pos, len(vocabulary) - 1)] == words if len(vocabulary) else np.zeros(len(words), bool)
            where, found = np.flatnonzero(ok), pos[ok]
            of_text = np.searchsorted(where, at)
            for i in range(len(at) - 1):
                own = np.unique(found[of_text[i]:of_text[i + 1]])
                yield np.concatenate([np.flatnonzero(style[first + i]), N_STYLE + own])


@dataclass
class Ranking:
    """``vocabulary`` ascending word hashes; ``weights`` by feature number; ``level``: share of the learned rows whose
    utility is below the best cut; ``error``: the sampling error of that share; ``prior``: smoothed share of label 1;
    ``fitted``: whether there was a pair to learn from."""

    vocabulary: np.ndarray
    weights: np.ndarray
    level: float
    error: float
    prior: float
    fitted: bool

    def utilities(self, column: pa.Array) -> np.ndarray:
        return np.array([utility(f, self.weights) for f in text_features(column, self.vocabulary)])


def utility(features: np.ndarray, weights: np.ndarray) -> float:
    """Style weights in full; word weights over the root of how many words count, so that length is no merit."""
    cut = np.searchsorted(features, N_STYLE)
    return weights[features[:cut]].sum() + weights[features[cut:]].sum() / np.sqrt(max(len(features) - cut, 1))


def _partners(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Preference pairs (winner, loser) of one block: each row of the larger class with ``ROUNDS`` rows of the other."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    n, rounds = max(len(good), len(bad)), min(ROUNDS, min(len(good), len(bad)))
    step = np.arange(n)
    shift = np.arange(rounds) * max(min(len(good), len(bad)) // rounds, 1)
    if len(good) >= len(bad):
        return np.tile(good, rounds), bad[(step[None] + shift[:, None]) % len(bad)].reshape(-1)
    return good[(step[None] + shift[:, None]) % len(good)].reshape(-1), np.tile(bad, rounds)


def _blocks(texts: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """One row per block: labels, where each row's features begin, and the features."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.astype(np.int32).tobytes() for f in text_features(batch.column(3), vocabulary)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())],
                                             names=["block", "place", "label", "features"])

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table["place"].combine_chunks()), kind="stable")
        label = np.asarray(table["label"].combine_chunks())[order].astype(np.int32)
        features = table["features"].to_pylist()
        features = [features[i] for i in order]
        at = np.concatenate([[0], np.cumsum([len(f) // 4 for f in features])]).astype(np.int64)
        return pa.table({"label": pa.array([label.tobytes()], pa.binary()), "at": pa.array([at.tobytes()], pa.binary()),
                         "features": pa.array([b"".join(features)], pa.binary())})

    coded = texts.select("block", "place", "label", "text").mapInArrow(
        encode, "block int, place bigint, label int, features binary")
    return coded.groupBy("block").applyInArrow(pack, "label binary, at binary, features binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        for label, at, features in zip(*(batch.column(i).to_pylist() for i in range(3))):
            at, features = np.frombuffer(at, np.int64), np.frombuffer(features, np.int32)
            yield np.frombuffer(label, np.int32), [features[a:b] for a, b in zip(at[:-1], at[1:])]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_labelled: int = MAX_LABELLED, ridge: float = 1e-4, steps: int = STEPS) -> Ranking:
    """Learn from the labelled rows that aren't held out; about ``max_labelled`` of them, by a hash of the id.

    Null ids, null labels and labels other than 0 and 1 are left out; of several labels of one id the larger counts, of
    several texts of one id the one that sorts first, so a repeated id is no more than one row.
    """
    known = (labels.select(labels[id_col].cast("bigint").alias("id"), labels[label_col].cast("int").alias("label"))
             .filter("id is not null and label in (0, 1)").filter(~is_held_out("id"))
             .groupBy("id").agg(F.max("label").alias("label")))
    sample = written(text_classifier.bounded_sample(known, "id", max_labelled), "preferred")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_blocks = max(1, round(sum(sizes.values()) / MAX_BLOCK))
    own = docs.select(docs[id_col].cast("bigint").alias("id"),
                      F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    # The sample is bounded by max_labelled rows of two numbers.
    texts = written(own.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
                    .select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"),
                            F.xxhash64("id", F.lit(1)).alias("place"), "label", "text"), "labelled")
    sizes = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    n = sum(sizes.values())
    prior = (sizes.get(1, 0) + 1) / (n + 2)
    none = Ranking(np.zeros(0, U64), np.zeros(N_STYLE), 0.0, 0.0, prior, False)
    if len(sizes) < 2:
        return none
    vocabulary = text_classifier._vocabulary(texts, 2, np.zeros(0, U64))[0]
    blocks = written(_blocks(texts, vocabulary), "blocks")
    spark, size = docs.sparkSession, N_STYLE + len(vocabulary)

    def evaluate(weights: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast(weights)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = sent.value
            for label, features in _unpacked(batches):
                u = np.array([utility(f, w) for f in features])
                win, lose = _partners(label)
                gap = u[win] - u[lose]
                loss = np.logaddexp(0.0, -gap).sum()
                miss = -1 / (1 + np.exp(np.clip(gap, -500, 500)))
                by_row = np.bincount(win, miss, len(u)) - np.bincount(lose, miss, len(u))
                grad = np.zeros(size)
                for f, g in zip(features, by_row):
                    cut = np.searchsorted(f, N_STYLE)
                    grad[f[:cut]] += g
                    grad[f[cut:]] += g / np.sqrt(max(len(f) - cut, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([float(loss)]), pa.array([len(win)], pa.int64()), pa.array([grad.tobytes()], pa.binary())],
                    names=["loss", "pairs", "grad"])

        loss, pairs, grad = 0.0, 0, np.zeros(size)
        for row in blocks.mapInArrow(part, "loss double, pairs bigint, grad binary").collect():  # a row per block
            loss, pairs, grad = loss + row["loss"], pairs + row["pairs"], grad + np.frombuffer(row["grad"])
        sent.destroy()
        pairs = max(pairs, 1)
        return loss / pairs + ridge * (weights ** 2).sum(), grad / pairs + 2 * ridge * weights

    if not np.abs(evaluate(np.zeros(size))[1]).any():  # no block has both labels, or no feature tells them apart
        return none
    weights = text_classifier._lbfgs(evaluate, np.zeros(size), steps)
    sent = spark.sparkContext.broadcast(weights)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, features in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array(label), pa.array([utility(f, sent.value) for f in features])],
                                             names=["label", "utility"])

    # Two numbers of at most about max_labelled rows.
    rated = blocks.mapInArrow(rate, "label int, utility double").toPandas().sort_values("utility")
    label = rated["label"].to_numpy()
    # Errors of a cut before each row: good ones below it, bad ones from it on, both weighted by their class.
    share = max(label.mean(), 1 / n), max(1 - label.mean(), 1 / n)
    wrong = (np.concatenate([[0], np.cumsum(label == 1)]) / share[0]
             + np.concatenate([np.cumsum((label == 0)[::-1])[::-1], [0]]) / share[1])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    level = float(best[len(best) // 2]) / n
    return Ranking(vocabulary, weights, level, float(np.sqrt(max(level * (1 - level), 1 / n) / n)), prior, True)


def with_utility(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, utility)`` of every row, whole texts; null texts count as empty. Nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(ranking)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                u = np.clip(sent.value.utilities(part.column(1)), -LIMIT, LIMIT)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(u, pa.float64())], names=["id", "utility"])

    kind = docs.schema[id_col].dataType
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return (rows.mapInArrow(rate, StructType([StructField("id", kind), StructField("utility", DoubleType())]))
            .withColumnRenamed("id", id_col))


def quantile_threshold(utilities: DataFrame, level: float, error: float = 0.0) -> float:
    """Utility below which ``level`` of the rows of ``utilities`` lie, to 1 / ``GRID``; with ``error`` the middle of the
    widest gap between utilities whose levels are within two errors of it. All rows count; the table that is
    collected has a row per used step of the grid. Without rows it is 0."""
    counted = (utilities.groupBy(F.round(F.col("utility") * GRID).cast("int").alias("step"))
               .agg(F.count("*").alias("n")).toPandas().sort_values("step"))
    if not len(counted):
        return 0.0
    step, below = counted["step"].to_numpy() / GRID, counted["n"].to_numpy().cumsum()
    below, n = below - counted["n"].to_numpy(), below[-1]
    # A cut before step i has below[i] rows under it; beyond both ends there is room without end.
    cuts = np.concatenate([[step[0] - 0.5], (step[1:] + step[:-1]) / 2, [step[-1] + 0.5]])
    width = np.concatenate([[1.0], np.diff(step), [1.0]])
    levels = np.concatenate([below, [n]]) / n
    near = np.flatnonzero(np.abs(levels - level) <= 2 * error)
    if not len(near):
        near = np.flatnonzero(np.abs(levels - level) <= np.abs(levels - level).min() + 1e-12)
    return float(cuts[near[np.argmax(width[near])]])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(id_col, held_out, score, predicted, utility)`` for every row of ``docs``, whole texts.

    ``score`` is the probability that the document beats one at the threshold, moved so that the threshold itself gets
    ``KEEP_SCORE``; ``predicted`` whether it is at least that. Only the text is an input; null and empty texts are rated
    as texts without bytes, equal texts get equal scores. Repeated rows are rated one by one, other columns aren't
    read, an empty table gives an empty table. Without labels of both kinds the score is the smoothed
    share of label 1 for all. ``held_out`` is null for a null id.
    """
    ranking = fit(docs, labels, id_col, text_col, label_col, max_labelled)
    rated = written(with_utility(docs, ranking, id_col, text_col), "utilities")
    cut = quantile_threshold(rated, ranking.level, ranking.error) if ranking.fitted else 0.0
    shift = float(np.log(KEEP_SCORE / (1 - KEEP_SCORE)))
    beats = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("utility") - F.lit(cut) + F.lit(shift))))
    # At the threshold itself rounding must not decide.
    own = (F.when(F.col("utility") >= cut, F.greatest(beats, F.lit(KEEP_SCORE))).otherwise(beats)
           if ranking.fitted else F.lit(ranking.prior))
    return rated.select(id_col, is_held_out(id_col).alias("held_out"), own.alias("score"),
                        (own >= KEEP_SCORE).cast("int").alias("predicted"), "utility")


def best_documents(docs: DataFrame, labels: DataFrame, share: float, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose utility is at or above the quantile that leaves about
    ``share`` of all rows; rows of equal utility stay or go together."""
    ranking = fit(docs, labels, id_col, text_col, label_col, max_labelled)
    cut = quantile_threshold(written(with_utility(docs, ranking, id_col, text_col), "utilities"), 1 - share)
    rows = text_classifier.carried(docs, text_col)
    rated = with_utility(rows, ranking, "row", "text")
    return rated.filter(F.col("utility") >= cut).select("row.*")
