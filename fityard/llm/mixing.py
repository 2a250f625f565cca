"""Mixing documents to target domain weights with soft membership.

A classifier fitted on the labelled table gives every document its posterior of each domain. A document's
rate is how often it enters the mixture on average; the rates are nonnegative and, in the least squares
sense, make the expected tokens of every domain (sum of rate x tokens x posterior) equal its target.

The rates start at 1 and move by projected gradient steps. The gradient of document d is its tokens times its posteriors
times the same few numbers, the current shortfalls of all domains; a step moves its rate by its posteriors times a
direction that follows from those, and cuts it at 0. So the rates never have to be stored between steps: a document's
rate is the replay of shortfalls and directions, and a step costs two aggregations of one row per task.
Documents that stand at 0 and would be pushed below stay where they are; the direction is the shortfalls through the
inverse Gram matrix of all others, or the plain gradient, in several lengths: what brings the targets nearest of all is
taken, and the plain gradient over the largest eigenvalue always helps. The end is where such a step would move next to nothing.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from fityard.llm import text_classifier
from fityard.llm.textcols import released, texts_words
from fityard.runtime import written

DOMAINS = ["good", "poor", "toxic"]
TARGETS = {"good": 0.85, "poor": 0.10, "toxic": 0.05}
MAX_STEPS = 100
TOLERANCE = 1e-6  # of all tokens


def labelled_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, label)``: toxic = 1 is domain 2, else quality 1 is domain 0 and quality 0 domain 1. Rows with
    a null id or without what decides are left out; of several rows of one id the largest domain counts."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)
    return (labels.select(labels[id_col].cast("bigint").alias("id"), domain.alias("label"))
            .filter("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label")))


def moved(rate: np.ndarray, posteriors: np.ndarray, gap: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """Rates after a step; those at 0 whose gradient points below stay."""
    held = (rate <= 0) & (posteriors @ gap <= 0)
    return np.where(held, rate, np.maximum(0.0, rate + posteriors @ direction))


def replay(posteriors: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    rate = np.ones(len(posteriors))
    for gap, direction in steps:
        rate = moved(rate, posteriors, gap, direction)
    return rate


def fit_rates(members: DataFrame, targets: np.ndarray, max_steps: int = MAX_STEPS,
              tolerance: float = TOLERANCE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Steps whose replay gives the rates. ``members``: n_tokens, posteriors. ``targets``: wanted tokens of each
    domain, NaN where any number will do. A fit that hasn't come to its end after ``max_steps`` steps is warned about."""
    k, spark = len(targets), members.sparkSession
    total = np.nansum(targets)
    if not total > 0:
        return []

    def summed(work, size: int, *sent_: object) -> np.ndarray:
        sent = spark.sparkContext.broadcast(sent_)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size)
            for batch in batches:
                tokens = np.asarray(batch.column(0)).astype(float)
                p = np.asarray(batch.column(1).flatten()).reshape(-1, k)
                sums += work(tokens, p, *sent.value)
            yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()])], names=["sums"])

        one = members.select("n_tokens", "posteriors").mapInArrow(released(part), "sums array<double>")
        row = one.agg(*(F.sum(F.col("sums")[i]) for i in range(size))).first()
        sent.destroy()
        return np.array([v or 0.0 for v in row], dtype=float)

    def tokens_at(steps: list, gap: np.ndarray, directions: list[np.ndarray]) -> np.ndarray:
        """Expected tokens of every domain after one more step, for each of the directions."""
        def work(tokens, p, s, g, ds):
            rate = replay(p, s)
            return np.concatenate([(moved(rate, p, g, d) * tokens) @ p for d in ds])

        return summed(work, k * len(directions), steps, gap, directions).reshape(-1, k)

    def slopes_at(steps: list, gap: np.ndarray, scale: float) -> tuple[np.ndarray, float]:
        """Gram matrix of the documents that can move, and how many tokens a plain step would move."""
        def work(tokens, p, s, g):
            rate, push = replay(p, s), p @ g
            free = (rate > 0) | (push > 0)
            far = np.abs(rate - np.maximum(0.0, rate + push / scale)) @ tokens
            return np.append(((p * (tokens * free)[:, None]).T @ p).reshape(-1), far)

        sums = summed(work, k * k + 1, steps, gap)
        return sums[:-1].reshape(k, k), float(sums[-1])

    def shortfall(tokens: np.ndarray) -> np.ndarray:
        return np.nan_to_num(targets - tokens)

    steps: list[tuple[np.ndarray, np.ndarray]] = []
    gap = shortfall(tokens_at(steps, np.zeros(k), [np.zeros(k)])[0])
    used = ~np.isnan(targets)
    whole = summed(lambda tokens, p: ((p * tokens[:, None]).T @ p).reshape(-1), k * k).reshape(k, k)
    largest = float(np.linalg.eigvalsh(whole * np.outer(used, used))[-1])
    if not largest > 0:
        return []
    while len(steps) < max_steps:
        gram, far = slopes_at(steps, gap, largest)
        if far <= tolerance * total or np.abs(gap).max() <= tolerance * total:
            return steps
        gram = gram * np.outer(used, used)
        newton = np.linalg.solve(gram + (1e-9 * np.trace(gram) + 1e-12 * largest) * np.eye(k), gap)
        # Both kinds of direction in several lengths, tried in one pass; the plain gradient's first one always helps.
        directions = [newton / 2 ** i for i in range(6)] + [gap / largest * 2 ** i for i in range(10)]
        size = [np.linalg.norm(shortfall(t)) for t in tokens_at(steps, gap, directions)]
        best = int(np.argmin(size))
        if size[best] >= np.linalg.norm(gap) * (1 - 1e-13):
            return steps  # as near as doubles can tell
        steps = [*steps, (gap, directions[best])]
        gap = shortfall(tokens_at(steps, gap, [np.zeros(k)])[0])
    warnings.warn(f"rates have not converged after {max_steps} steps; {far / total:.1e} of all tokens would still move")
    return steps


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labelled: int):
    sample = text_classifier.bounded_sample(labelled_domains(labels, id_col), "id", max_labelled)
    texts = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    # The sample is bounded by max_labelled rows of two numbers.
    return text_classifier.fit(texts.join(F.broadcast(sample), "id").select("text", "label"), DOMAINS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (row, text, posteriors) with the number of words instead of the text."""
    for batch in batches:
        n = [c for _, _, _, at in texts_words(batch.column(1)) for c in np.diff(at).tolist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2)],
                                         names=["row", "n_tokens", "posteriors"])


def _rate(batches: Iterator[pa.RecordBatch], steps: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = np.asarray(batch.column(2).flatten()).reshape(-1, len(DOMAINS))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replay(p, steps))],
                                         names=["row", "n_tokens", "posteriors", "rate"])


def _classified(rows: DataFrame, model: text_classifier.Model, steps: list | None = None) -> DataFrame:
    """``(row, n_tokens, posteriors)`` of ``rows`` (row, text), and the rate if steps are given: all in one Python worker a task."""
    score = text_classifier.scoring(rows.sparkSession.sparkContext.broadcast(model), len(model.classes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _count(score(batches))
        return counted if steps is None else _rate(counted, steps)

    fields = [rows.schema["row"], StructField("n_tokens", LongType()), text_classifier.POSTERIORS]
    rate = [] if steps is None else [StructField("rate", DoubleType())]
    return rows.select("row", "text").mapInArrow(released(work), StructType([*fields, *rate]))


def _steps(members: DataFrame, targets: dict[str, float], budget: float) -> list[tuple[np.ndarray, np.ndarray]]:
    total = float(members.agg(F.sum("n_tokens")).first()[0] or 0) * budget
    shares = np.array([targets.get(d, np.nan) for d in DOMAINS])
    return fit_rates(members, total * shares / max(np.nansum(shares), 1e-300))


def _with_copies(rated: DataFrame, id_: Column) -> DataFrame:
    """``rated`` (row, n_tokens, posteriors, rate) and the copies; ``id_`` is the document's id, found in ``row``."""
    chance = F.pmod(F.xxhash64(id_, "n_tokens"), F.lit(1 << 40)) / float(1 << 40)
    return rated.withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        targets: dict[str, float] = TARGETS, budget: float = 1.0,
        max_labelled: int = text_classifier.MAX_LABELLED) -> DataFrame:
    """``(id_col, n_tokens, p_good, p_poor, p_toxic, rate, copies)`` for every row.

    ``targets``: wanted share of all tokens by domain (a domain that isn't named is left as it falls), of
    ``budget`` times the tokens there are; tokens are words without white space. ``copies`` is the rate rounded up or
    down by a hash of the id and the number of tokens, up with the probability that makes its mean the rate.
    Null and empty texts have no tokens and the posteriors of a text without known words; they move no total, and their
    rate follows from the posteriors as for all others. Rows that repeat an id are separate members. With
    an empty table nothing is fitted. Without labels all posteriors are equal, and so are all rates.
    """
    model = _fitted(docs, labels, id_col, text_col, max_labelled)
    rows = docs.select(docs[id_col].alias("row"), docs[text_col].cast("string").alias("text"))
    members = written(_classified(rows, model), "members")
    steps = _steps(members, targets, budget)
    rated = _with_copies(members.mapInArrow(released(lambda batches: _rate(batches, steps)), StructType(
        [*members.schema.fields, StructField("rate", DoubleType())])), F.col("row"))
    return rated.select(F.col("row").alias(id_col), "n_tokens",
                        *(F.col("posteriors")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate", "copies")


def mixed_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    targets: dict[str, float] = TARGETS, budget: float = 1.0,
                    max_labelled: int = text_classifier.MAX_LABELLED) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as ``mix`` says (copies may be 0). Texts are
    classified a second time instead of being joined to their rates, so no text is shuffled.

    Null ids, null and empty texts, repeated rows and an empty table are treated as in ``mix``; columns may have any
    names, as they travel as one."""
    model = _fitted(docs, labels, id_col, text_col, max_labelled)
    ids = docs.select(docs[id_col].alias("row"), docs[text_col].cast("string").alias("text"))
    steps = _steps(written(_classified(ids, model), "members"), targets, budget)
    rated = _with_copies(_classified(text_classifier.carried(docs, text_col), model, steps),
                         F.col("row").getField(id_col)).filter("copies > 0")
    return rated.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
