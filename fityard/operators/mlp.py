"""Multilayer perceptron: fitting, and scoring with given weights in either activation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fityard.functions.vectors import dot
from fityard.operators import moments
from fityard.runtime import written

# Sizes of the hidden layers; the defaults of ten iterations and a step of 0.005 below are fixed as well.
HIDDEN = (10, 10)


def fit_mlp(train: DataFrame, n_features: int, hidden: Sequence[int] = HIDDEN, n_classes: int = 2,
            max_iter: int = 10, step_size: float = 0.005, solver: str = "gd", seed: int = 123,
            features_col: str = "features", label_col: str = "label", start: Sequence[Layer] | None = None,
            **params) -> MultilayerPerceptronClassificationModel:
    """Network ``[n_features, *hidden, n_classes]`` with sigmoid hidden layers and softmax output, from random weights or
    from ``start``, which then also sets the sizes of the layers."""
    layers = [n_features, *hidden, n_classes]
    if start is not None:
        layers = [len(start[0].weights[0]), *(len(layer.bias) for layer in start)]
        params["initialWeights"] = Vectors.dense(flat_weights(start))
    return MultilayerPerceptronClassifier(
        featuresCol=features_col, labelCol=label_col, layers=layers,
        maxIter=max_iter, stepSize=step_size, solver=solver, seed=seed, **params).fit(train)


@dataclass(frozen=True)
class Layer:
    """Affine layer: ``weights[out][in]`` and ``bias[out]``."""

    weights: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...]


def layers_of(model: MultilayerPerceptronClassificationModel) -> list[Layer]:
    """Split the flat weight vector: per layer a column-major matrix, then the bias."""
    sizes, flat, at, layers = list(model.getLayers()), model.weights.toArray(), 0, []
    for n_in, n_out in zip(sizes, sizes[1:]):
        w = flat[at:at + n_in * n_out].reshape((n_out, n_in), order="F")
        at += n_in * n_out
        layers.append(Layer(tuple(map(tuple, w.tolist())), tuple(flat[at:at + n_out].tolist())))
        at += n_out
    return layers


def flat_weights(layers: Sequence[Layer]) -> list[float]:
    """The library's flat weight vector of given layers, as :func:`layers_of` reads it."""
    return [v for layer in layers
            for v in (*np.array(layer.weights).reshape(-1, order="F").tolist(), *layer.bias)]


def weight_table(spark: SparkSession, layers: Sequence[Layer]) -> DataFrame:
    """``(layer, unit, input, value)``; input -1 is the bias."""
    rows = [(d, j, i, float(v)) for d, layer in enumerate(layers)
            for j, (w, b) in enumerate(zip(layer.weights, layer.bias)) for i, v in ((-1, b), *enumerate(w))]
    return spark.createDataFrame(rows, "layer int, unit int, input int, value double")


def random_layers(sizes: Sequence[int], seed: int) -> list[Layer]:
    """Uniform weights whose spread keeps the scale of what goes through a tanh layer; zero biases."""
    rng = np.random.default_rng(seed)
    return [Layer(tuple(map(tuple, rng.uniform(-1, 1, (n_out, n_in)) * np.sqrt(6 / (n_in + n_out)))), (0.0,) * n_out)
            for n_in, n_out in zip(sizes, sizes[1:])]


def _gradient(x: np.ndarray, y: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray]:
    """Summed log loss of a tanh network with softmax output, and its gradient as one flat vector (layer by layer: weights
    by unit, then biases)."""
    values = [x]
    for w, b in layers[:-1]:
        values.append(np.tanh(values[-1] @ w.T + b))
    z = values[-1] @ layers[-1][0].T + layers[-1][1]
    z -= z.max(axis=1, keepdims=True)
    log_sum = np.log(np.exp(z).sum(axis=1))
    label = y.astype(np.int64)
    at = np.arange(len(y))
    error = np.exp(z - log_sum[:, None])
    error[at, label] -= 1
    parts = []
    for depth in range(len(layers) - 1, -1, -1):
        parts = [(error.T @ values[depth]).reshape(-1), error.sum(axis=0), *parts]
        if depth:
            error = (error @ layers[depth][0]) * (1 - np.square(values[depth]))
    return float((log_sum - z[at, label]).sum()), np.concatenate(parts)


def fit_mlp_tanh(train: DataFrame, features: str | Sequence[str], hidden: Sequence[int] = HIDDEN, n_classes: int = 2,
                 max_iter: int = 10, step_size: float = 0.5, seed: int = 123, start: Sequence[Layer] | None = None,
                 tol: float = 0.0, label_col: str = "label") -> tuple[list[Layer], list[float]]:
    """Fit a network with tanh hidden layers and softmax output by back-propagation over all rows.

    Returns the layers and the mean loss before every step and after the last one. A step is one pass: the weights are sent
    to all tasks, each gives the gradient of its rows, Spark adds them up. Labels are 0 to ``n_classes - 1``.
    Starts from random weights of ``seed``, or from ``start``. Ends after ``max_iter`` steps, or when one
    lowers the loss by ``tol`` at most (0: only ``max_iter`` ends it).
    """
    rows = train.select("*", F.col(label_col).cast("double").alias("_label"))
    x = written(moments.arrays(rows, features, "_label"), "network-rows")
    width = moments.width_of(x)
    layers = list(start) if start is not None else random_layers([width, *hidden, n_classes], seed)
    current = [(np.array(layer.weights, dtype=float), np.array(layer.bias, dtype=float)) for layer in layers]
    n_weights = sum(w.size + b.size for w, b in current)

    def evaluate() -> tuple[float, np.ndarray]:
        sent = train.sparkSession.sparkContext.broadcast(current)

        def work(batches):
            total, loss, count = np.zeros(n_weights), 0.0, 0
            for batch in batches:
                part = _gradient(moments.rows_of(batch.column(0), width), np.asarray(batch.column(1), dtype=float), sent.value)
                loss, total, count = loss + part[0], total + part[1], count + batch.num_rows
            return total[:, None], [loss, count]

        total, (loss, count) = moments.collected(moments.summed(x, work), (n_weights, 1))
        sent.destroy()
        if not np.isfinite(total).all():
            raise ValueError("features or labels have missing or infinite values")
        return loss / count, total[:, 0] / count

    losses = []
    for step in range(max_iter + 1):
        loss, gradient = evaluate()
        losses.append(float(loss))
        if step == max_iter or (tol > 0 and step and losses[-2] - loss <= tol):
            break
        moved, at = [], 0
        for w, b in current:
            dw, db = gradient[at:at + w.size].reshape(w.shape), gradient[at + w.size:at + w.size + b.size]
            moved.append((w - step_size * dw, b - step_size * db))
            at += w.size + b.size
        current = moved
    return [Layer(tuple(map(tuple, w.tolist())), tuple(b.tolist())) for w, b in current], losses


def to_tanh(layers: Sequence[Layer]) -> list[Layer]:
    """The same function as a sigmoid network, with tanh hidden layers.

    sigmoid(z) = (1 + tanh(z / 2)) / 2: halve what goes into a hidden layer, and halve the weights
    of the layer it feeds while moving half their sum into the bias.
    """
    out = []
    for i, layer in enumerate(layers):
        w, b = np.array(layer.weights), np.array(layer.bias)
        if i > 0:
            b = b + w.sum(axis=1) / 2
            w = w / 2
        if i < len(layers) - 1:
            w, b = w / 2, b / 2
        out.append(Layer(tuple(map(tuple, w.tolist())), tuple(b.tolist())))
    return out


def _activate(z: Column, activation: str) -> Column:
    if activation == "sigmoid":
        return 1 / (1 + F.exp(-z))
    if activation == "tanh":
        return F.tanh(z)
    raise ValueError(f"unknown activation {activation!r}")


def score_network(df: DataFrame, feature_cols: Sequence[str], layers: Sequence[Layer],
                  activation: str = "sigmoid") -> DataFrame:
    """Add ``margin`` (log-odds of class 1) and ``prediction`` of a two-class network.

    Every layer is one projection of plain arithmetic, so the whole network stays in codegen.
    """
    if len(layers[-1].bias) != 2:
        raise ValueError("score_network needs a two-class output layer")
    cols, scored = list(feature_cols), df
    for depth, layer in enumerate(layers):
        last = depth == len(layers) - 1
        units = {}
        for j, (w, b) in enumerate(zip(layer.weights, layer.bias, strict=True)):
            z = dot(w, cols, b)
            units[f"_l{depth}_{j}"] = z if last else _activate(z, activation)
        scored = scored.select("*", *[c.alias(name) for name, c in units.items()])
        cols = list(units)
    margin = F.col(cols[1]) - F.col(cols[0])
    return (scored.select(*[F.col(f"`{c}`") for c in df.columns], margin.alias("margin"))
            .withColumn("prediction", (F.col("margin") > 0).cast("double")))
