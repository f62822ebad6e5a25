"""The fit of Spark's multilayer perceptron with its sums of gradients made by matrix products.

The objective, the first weights and the steps are those of Spark's own fit, and the result is its model. Rows are packed into
matrices once and dealt over as many tasks as there are rows for; only the weights and one sum of gradients travel per step.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame

from custlens.operators.splits import FIT_PARTITIONS

BLOCK = 64          # the objective is the mean over blocks of so many rows of a partition, the last one shorter
BLOCKS_AT_ONCE = 16  # blocks in one matrix
CACHED_ROWS = 256   # rows that pass all layers at once
TASK_ROWS = 1 << 15
DIRECT_TASKS = 64   # sums of more tasks meet in other tasks before they reach the driver
CORRECTIONS = 10
TOLERANCE = 1e-6


def packed(train: DataFrame, width: int, classes: int) -> DataFrame:
    """Matrices of rows (features, labels) with the share of one row in its block."""
    at_once = BLOCK * BLOCKS_AT_ONCE

    def pack(batches):
        x, y = np.empty((0, width)), np.empty(0)

        def piece(a, b, share):
            return pa.RecordBatch.from_pydict({
                "x": pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()), "y": pa.array([b.tobytes()], pa.binary()),
                "share": pa.array([share], pa.float64())})

        for batch in batches:
            some = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            labels = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(some).all() or not np.isin(labels, np.arange(classes)).all():
                raise ValueError("features must be finite and labels a class from 0")
            x, y = np.vstack([x, some]), np.concatenate([y, labels])
            whole = len(y) // at_once * at_once
            for i in range(0, whole, at_once):
                yield piece(x[i:i + at_once], y[i:i + at_once], 1.0 / BLOCK)
            x, y = x[whole:], y[whole:]
        whole = len(y) // BLOCK * BLOCK
        if whole:
            yield piece(x[:whole], y[:whole], 1.0 / BLOCK)
        if len(y) > whole:
            yield piece(x[whole:], y[whole:], 1.0 / (len(y) - whole))

    rows = train.select(vector_to_array("features").alias("x"), train["label"].cast("double").alias("y"))
    return rows.mapInArrow(pack, "x binary, y binary, share double")


def layer_weights(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(inputs x outputs, bias) of every layer, views of the flat weights."""
    found, at = [], 0
    for a, b in zip(layers, layers[1:]):
        found.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]))
        at += a * b + b
    return found


def block_sums(weights: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Gradient, loss and number of blocks of one matrix of rows, in one array: sigmoids, softmax and cross entropy."""
    steps = layer_weights(weights, layers)
    sums = np.zeros(len(weights) + 2)
    parts = layer_weights(sums[:-2], layers)
    for at in range(0, len(y), CACHED_ROWS):
        outputs, labels = [x[at:at + CACHED_ROWS]], y[at:at + CACHED_ROWS]
        for w, b in steps[:-1]:
            h = outputs[-1] @ w
            h += b
            np.negative(h, out=h)
            with np.errstate(over="ignore"):  # a sigmoid of 0
                np.exp(h, out=h)
            h += 1.0
            outputs.append(np.reciprocal(h, out=h))
        w, b = steps[-1]
        z = outputs[-1] @ w + b
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        rows = np.arange(len(labels))
        sums[-2] -= z[rows, labels].sum() * share
        delta = np.exp(z)
        delta[rows, labels] -= 1.0
        delta *= share
        for i in range(len(steps) - 1, -1, -1):
            parts[i][0][:] += outputs[i].T @ delta
            parts[i][1][:] += delta.sum(axis=0)
            if i:
                delta = delta @ steps[i][0].T
                delta *= outputs[i]
                delta *= np.subtract(1.0, outputs[i], out=outputs[i])
    sums[-1] = len(y) * share
    return sums


class NoStep(Exception):
    """No step along a direction lowers the objective enough."""


def _between(left: tuple, right: tuple) -> float:
    """The minimum of the cubic through two points (place, value, slope), kept off both ends."""
    (t0, v0, s0), (t1, v1, s1) = sorted((left, right))
    d1 = s0 + s1 - 3.0 * (v0 - v1) / (t0 - t1)
    inner = d1 * d1 - s0 * s1
    d2 = math.sqrt(inner) if inner >= 0 else math.nan
    below = s1 - s0 + 2.0 * d2
    t = t1 - (t1 - t0) * (s1 + d2 - d1) / below if below else math.nan
    return t if math.isnan(t) else min(max(t, t0 + 0.1 * (t1 - t0)), t0 + 0.9 * (t1 - t0))


def line_search(phi: Callable[[float], tuple[float, float]], start: tuple[float, float], first: float) -> float:
    """A step that meets the strong Wolfe conditions; ``phi`` gives value and slope, last called with the step returned."""
    value, slope = start
    if slope > 0:
        raise NoStep
    low, t = (0.0, value, slope), first
    for i in range(10):
        c = (t, *phi(t))
        if not math.isfinite(c[1]):
            t /= 2.0
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            return _zoom(phi, low, c, value, slope)
        if abs(c[2]) <= 0.9 * abs(slope):
            return t
        if c[2] >= 0:
            return _zoom(phi, c, low, value, slope)
        low, t = c, t * 1.5
    raise NoStep


def _zoom(phi, low: tuple, high: tuple, value: float, slope: float) -> float:
    for _ in range(10):
        t = _between(low, high)
        c = (t, *phi(t))
        if c[1] > value + 1e-4 * t * slope or c[1] >= low[1]:
            high = c
        else:
            if abs(c[2]) <= 0.9 * abs(slope):
                return t
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
    raise NoStep


def _direction(grad: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton direction from the last steps and changes of the gradient, newest first."""
    out, factors, scale = grad.copy(), [], 1.0
    if history:
        step, change = history[0]
        if not step @ change >= 0:
            raise NoStep
        scale = (step @ change) / (change @ change)
    for step, change in history:
        factors.append((step @ out) / (step @ change))
        if math.isnan(factors[-1]):
            raise NoStep
        out -= factors[-1] * change
    out *= scale
    for (step, change), factor in zip(reversed(history), reversed(factors)):
        out += (factor - (change @ out) / (step @ change)) * step
    return -out


def minimised(
    objective: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tolerance: float = TOLERANCE,
) -> np.ndarray:
    """Limited-memory BFGS as Spark's fits use it: stops after ``max_iter`` steps, or by value or gradient."""
    value, grad = objective(x)
    first_value, values, history, failed, steps = value, [math.inf], [], False, 0
    while steps < max_iter:
        if np.linalg.norm(grad) <= max(tolerance * abs(value), 1e-8):
            break
        if len(values) >= 2 and abs(value - max(values)) <= tolerance * abs(first_value):
            break
        last = {}

        def phi(t):
            last["x"] = x + t * way
            last["value"], last["grad"] = objective(last["x"])
            return last["value"], float(last["grad"] @ way)

        try:
            way = _direction(grad, history)
            t = line_search(phi, (value, float(grad @ way)), 1.0 / np.linalg.norm(way) if steps == 0 else 1.0)
            if t * np.linalg.norm(grad) < 1e-10:
                raise NoStep
        except NoStep:
            if failed:
                break
            history, failed = [], True
            continue
        failed = False
        history = [(last["x"] - x, last["grad"] - grad), *history][:CORRECTIONS]
        x, value, grad, steps = last["x"], last["value"], last["grad"], steps + 1
        values = [*values, value][-20:]
    return x


def fit_perceptron(train: DataFrame, hidden: list[int], max_iter: int, seed: int) -> MultilayerPerceptronClassificationModel:
    """A perceptron for two classes on ``train`` (features, label), as Spark's own fit gives it."""
    spark, context = train.sparkSession, train.sparkSession.sparkContext
    first = train.select("features", "label").first()
    layers = [len(first["features"]), *hidden, 2]
    one = spark.createDataFrame([(first["features"], float(first["label"]))], ["features", "label"])
    estimator = MultilayerPerceptronClassifier(layers=layers, maxIter=0, seed=seed, blockSize=BLOCK)
    start = estimator.fit(one).weights.toArray()  # no step is taken: the weights that the seed gives

    tasks = max(FIT_PARTITIONS, math.ceil(train.count() / TASK_ROWS))
    matrices = packed(train, layers[0], layers[-1]).repartition(tasks).rdd.map(lambda r: (
        np.frombuffer(r["x"]).reshape(-1, layers[0]), np.frombuffer(r["y"]).astype(np.int64), r["share"]))
    matrices.persist(StorageLevel.MEMORY_AND_DISK)

    def objective(weights: np.ndarray) -> tuple[float, np.ndarray]:
        sent = context.broadcast(weights)
        sums = matrices.treeAggregate(
            np.zeros(len(weights) + 2), lambda acc, m: acc + block_sums(sent.value, layers, *m), lambda a, b: a + b,
            depth=1 if tasks <= DIRECT_TASKS else 2)
        sent.destroy()
        return float(sums[-2] / sums[-1]), sums[:-2] / sums[-1]

    try:
        weights = minimised(objective, start, max_iter)
    finally:
        matrices.unpersist()
    model = estimator.copy({estimator.initialWeights: Vectors.dense(weights)}).fit(one)
    model.clear(model.initialWeights)
    return model._set(maxIter=max_iter)
