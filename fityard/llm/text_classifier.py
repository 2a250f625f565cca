"""Logistic regression on the words of whole texts, with a penalty on counterfactual score changes.

A text is the set of its words (ASCII letters and digits and all bytes beyond ASCII; A-Z lower-cased) and
of their beginnings of ``BEGINNING`` bytes, as far as they are in the vocabulary: at most ``MAX_WORDS``
of them, chosen on the labelled rows. Each class has a weight
per word, which is a learned factor times the word's log odds in that class, so that words which don't
tell classes apart can hardly contribute. The loss is the mean log loss, a ridge on the factors, and for
every labelled text whose identity terms can be swapped, the squared change that the swap makes in
the class scores. The fit is full-batch L-BFGS; each evaluation is one Spark job over the written features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from fityard.llm.textcols import U64, buffers, pieces, released, word_hashes
from fityard.runtime import written

MAX_LABELLED = 20_000  # labelled rows used by a fit, about; chosen by a hash of the id
MAX_WORDS = 1 << 15
MIN_TEXTS = 4          # labelled texts that a word must be in
BEGINNING = 6
STEPS = 40

SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def text_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text of each piece of a column, its word hashes, and where each text's begin."""
    data, offsets = buffers(column)
    for a, b in pieces(offsets):
        words, at = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], True, SEPARATOR,
                                 BEGINNING)
        yield a, words, at


def hash_terms(terms: list[str]) -> np.ndarray:
    """Of each term the hash of the word and that of its beginning."""
    words, at = zip(*[(w, a) for _, w, a in text_words(pa.array(terms, pa.string()))]) if terms else ((), ())
    out = np.concatenate(words) if words else np.zeros(0, U64)
    if len(out) != 2 * len(terms):
        raise ValueError("a term must be one word")
    return out


@dataclass
class Model:
    """``vocabulary`` ascending; ``weights`` (words, classes); ``bias`` (classes); ``classes`` their labels."""

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    classes: list
    seen: np.ndarray = field(init=False)

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.vocabulary >> U64(44)).astype(np.int64)] = True

    def presence(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ascending vocabulary positions of each text's words."""
        for _, words, at in text_words(column):
            near = np.flatnonzero(self.seen[(words >> U64(44)).astype(np.int64)])
            pos = np.searchsorted(self.vocabulary, words[near])
            ok = self.vocabulary[np.minimum(pos, len(self.vocabulary) - 1)] == words[near] if len(
                self.vocabulary) else np.zeros(len(near), bool)
            near, pos = near[ok], pos[ok]
            cut = np.searchsorted(near, at)
            for i in range(len(at) - 1):
                yield np.unique(pos[cut[i]:cut[i + 1]])

    def posteriors(self, column: pa.Array) -> np.ndarray:
        scores = np.array([self.bias + self.weights[p].sum(axis=0) for p in self.presence(column)])
        return softmax(scores.reshape(-1, len(self.classes)))


def softmax(scores: np.ndarray) -> np.ndarray:
    if not len(scores):
        return scores
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bounded_sample(labels: DataFrame, key: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows, or all if there are fewer, by a hash of the key."""
    n = labels.count()
    if n <= max_rows:
        return labels
    return labels.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))


def _vocabulary(texts: DataFrame, n_classes: int, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and in how many labelled texts of each class they are; the most telling ones if too many."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column(1))
            found = [(np.unique(words[at[i]:at[i + 1]]), label[a + i])
                     for a, words, at in text_words(batch.column(0)) for i in range(len(at) - 1)]
            if not found:
                continue
            words, inverse = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
            table = np.zeros((len(words), n_classes), dtype=np.int64)
            np.add.at(table, (inverse, np.repeat([y for _, y in found], [len(w) for w, _ in found])), 1)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)),
                                              *(pa.array(table[:, k]) for k in range(n_classes))],
                                             names=["word", *(f"c{k}" for k in range(n_classes))])

    counts = [f"c{k}" for k in range(n_classes)]
    table = texts.select("text", "label").mapInArrow(count, "word bigint, " + ", ".join(f"{c} bigint" for c in counts))
    table = table.groupBy("word").agg(*(F.sum(c).alias(c) for c in counts))
    total = sum((F.col(c) for c in counts), F.lit(0))
    sizes = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    n = sum(sizes.values())
    # Chi-squared of the word's counts against the class sizes.
    spread = sum((F.pow(F.col(c) - total * (sizes.get(k, 0) / n), 2) / (total * max(sizes.get(k, 0), 1) / n)
                  for k, c in enumerate(counts)), F.lit(0.0))
    top = (table.filter(total >= MIN_TEXTS).orderBy(spread.desc(), "word").limit(MAX_WORDS).toPandas())
    words = top["word"].to_numpy(np.int64).view(U64)
    table_ = top[counts].to_numpy(np.float64)
    extra = np.setdiff1d(fixed, words)
    words = np.concatenate([words, extra])
    table_ = np.concatenate([table_, np.zeros((len(extra), n_classes))])
    order = np.argsort(words)
    return words[order], table_[order]


def _lbfgs(evaluate, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Minimise; ``evaluate`` gives value and gradient."""
    value, grad = evaluate(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction = -grad
        kept = []
        for s, y in reversed(past):
            a = s @ direction / (s @ y)
            direction = direction - a * y
            kept.append(a)
        if past:
            s, y = past[-1]
            direction = direction * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept)):
            direction = direction + s * (a - y @ direction / (s @ y))
        slope, size = grad @ direction, 1.0 if past else 1.0 / max(np.linalg.norm(grad), 1.0)
        for _ in range(12):
            new = x + size * direction
            new_value, new_grad = evaluate(new)
            if new_value <= value + 1e-4 * size * slope:
                break
            size *= 0.4
        else:
            return x
        if (new - x) @ (new_grad - grad) > 1e-12:
            past = [*past, (new - x, new_grad - grad)][-memory:]
        done = value - new_value <= 1e-5 * max(abs(value), 1e-3)
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x


def fit(texts: DataFrame, classes: list, swaps: list[tuple[str, str]] = (), swap_weight: float = 1.0,
        ridge: float = 1e-3, steps: int = STEPS) -> Model:
    """Fit on ``(text, label int)``, label being a position in ``classes``; bounded by its caller.

    Without rows all classes are equally likely; if one class has all rows, texts get its smoothed share.
    ``swaps``: pairs of identity terms; a counterfactual text has every first term replaced by the second.
    """
    k = len(classes)
    texts = written(texts.select(F.coalesce("text", F.lit("")).alias("text"), "label"), "labelled")
    sizes = np.zeros(k)
    for row in texts.groupBy("label").count().collect():
        sizes[row["label"]] = row["count"]
    prior = np.log((sizes + 1) / (sizes.sum() + k))
    if (sizes > 0).sum() < 2:
        return Model(np.zeros(0, U64), np.zeros((0, k)), prior, classes)
    from_, to = hash_terms([a for a, _ in swaps]), hash_terms([b for _, b in swaps])
    words, counts = _vocabulary(texts, k, np.unique(np.concatenate([from_, to])))
    inside = (counts + 0.5) / (sizes + 1)
    outside = (counts.sum(axis=1, keepdims=True) - counts + 0.5) / (sizes.sum() - sizes + 1)
    odds = np.log(inside) - np.log(outside)
    model = Model(words, np.zeros((len(words), k)), prior, classes)
    swap_of = dict(zip(np.searchsorted(words, from_).tolist(), np.searchsorted(words, to).tolist()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = [p.astype(np.int32) for p in model.presence(batch.column(0))]
            there = [np.unique([swap_of.get(j, j) for j in p.tolist()]).astype(np.int32)
                     if any(j in swap_of for j in p.tolist()) else p[:0] for p in here]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([x.tobytes() for x in here], pa.binary()),
                 pa.array([x.tobytes() for x in there], pa.binary())], names=["label", "here", "there"])

    spark = texts.sparkSession
    rows = written(texts.mapInArrow(encode, "label int, here binary, there binary")
                   .repartition(8), "features")
    shape, n = odds.shape, sizes.sum()
    share = np.maximum(sizes / n, 1 / n)
    weight = np.sqrt(1 / (k * share))  # rare classes count more, but not in full inverse proportion
    weight = weight * n / (weight * sizes).sum()

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        factor, bias = x[:-k].reshape(shape), x[-k:]
        sent = spark.sparkContext.broadcast((factor * odds, bias))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b = sent.value
            loss, grad, grad_b = 0.0, np.zeros_like(w), np.zeros_like(b)
            for batch in batches:
                label = np.asarray(batch.column(0))
                here = [np.frombuffer(v, np.int32) for v in batch.column(1).to_pylist()]
                there = [np.frombuffer(v, np.int32) for v in batch.column(2).to_pylist()]
                p = softmax(np.array([b + w[j].sum(axis=0) for j in here]).reshape(-1, k))
                own = weight[label]
                loss -= (own * np.log(np.maximum(p[np.arange(len(p)), label], 1e-300))).sum()
                error = p.copy()
                error[np.arange(len(p)), label] -= 1
                error *= own[:, None]
                grad_b += error.sum(axis=0)
                for j, e in zip(here, error):
                    grad[j] += e
                for j, s in zip(here, there):
                    if len(s):
                        gap = w[s].sum(axis=0) - w[j].sum(axis=0)
                        loss += swap_weight * (gap @ gap)
                        grad[s] += 2 * swap_weight * gap
                        grad[j] -= 2 * swap_weight * gap
            at = np.flatnonzero(grad.any(axis=1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([loss]), pa.array([at.tobytes()], pa.binary()),
                 pa.array([grad[at].tobytes()], pa.binary()), pa.array([grad_b.tobytes()], pa.binary())],
                names=["loss", "at", "grad", "bias"])

        loss, grad, grad_b = 0.0, np.zeros(shape), np.zeros(k)
        for row in rows.mapInArrow(part, "loss double, at binary, grad binary, bias binary").collect():
            loss += row["loss"]
            grad[np.frombuffer(row["at"], np.int32)] += np.frombuffer(row["grad"]).reshape(-1, k)
            grad_b += np.frombuffer(row["bias"])
        sent.destroy()
        return (loss / n + ridge * (factor ** 2).sum(),
                np.concatenate([(grad * odds / n + 2 * ridge * factor).reshape(-1), grad_b / n]))

    best = _lbfgs(evaluate, np.concatenate([np.zeros(odds.size), prior]), steps)
    return Model(words, best[:-k].reshape(shape) * odds, best[-k:], classes)


def scoring(sent: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function for ``mapInArrow`` that adds the posteriors of the ``k`` classes of a sent model to batches (row, text)."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):  # a few rows at a time, so that little waits to be sent back
                batch = whole.slice(a, 512)
                p = sent.value.posteriors(batch.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * k, pa.int32()),
                                                 pa.array(p.reshape(-1), pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["row", "text", "posteriors"])

    return score


POSTERIORS = StructField("posteriors", ArrayType(DoubleType()))


def with_posteriors(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (row, text) and the posteriors of each text (array of doubles, in the order of the model's classes). A
    text without a word of the vocabulary, empty or null, gets the bias alone. Nothing is shuffled."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = StructType([rows.schema["row"], rows.schema["text"], POSTERIORS])
    return rows.select("row", "text").mapInArrow(released(scoring(sent, len(model.classes))), schema)


def carried(docs: DataFrame, text_col: str) -> DataFrame:
    """``(row, text)``: all columns as one, whatever their names, and the text."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
                       docs[f"`{text_col}`"].cast("string").alias("text"))
