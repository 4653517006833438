"""Models trained by distributed gradients (J1-J5): a network with class weights, a projection on cosine loss.

The parameters (a bounded number, set by the model's shape) go to the tasks;
each task returns the sum of its rows' losses and gradients, and a second
stage of few tasks adds these up, so that neither rows nor one sum per task
reach the driver.  L-BFGS on the driver then moves the parameters.  The loss is a sum
over all rows, so how they are dealt to tasks shows in the last digits only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .sampling import class_weights

# Steps that L-BFGS remembers, halvings of a step, and the decrease a step must bring.
MEMORY, HALVINGS, DECREASE = 10, 30, 1e-4
# Sums that reach the driver.
MOST_SUMS = 32

RowLoss = Callable[[np.ndarray, pd.DataFrame], tuple[float, np.ndarray]]


def summed_loss(rows: DataFrame, loss: RowLoss, parameters: np.ndarray) -> tuple[float, np.ndarray]:
    """The loss of all ``rows`` and its gradient, as sums of what ``loss`` says of each batch of them."""
    shared = rows.sparkSession.sparkContext.broadcast(parameters)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, gradient = 0.0, np.zeros(len(shared.value))
        for pdf in batches:
            if len(pdf):
                part, g = loss(shared.value, pdf)
                total, gradient = total + part, gradient + g
        yield pd.DataFrame({"part": [np.r_[total, gradient].tolist()]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(shared.value) + 1)
        for pdf in batches:
            for x in pdf["part"]:
                total = total + np.asarray(x)
        yield pd.DataFrame({"part": [total.tolist()]})

    tasks = max(1, min(MOST_SUMS, int(float(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5)))
    parts = rows.mapInPandas(partial, "part array<double>").repartition(tasks).mapInPandas(added, "part array<double>")
    total = np.zeros(len(parameters) + 1)
    for r in parts.collect():  # at most MOST_SUMS sums
        total = total + np.asarray(r["part"])
    shared.destroy()
    return float(total[0]), total[1:]


def minimise(function: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 100,
             tolerance: float = 1e-7) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with step halving: the parameters and the loss after each round.

    Ends when a round brings a smaller share of the loss than ``tolerance``,
    or no step along the direction helps.
    """
    x, (value, gradient) = start, function(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    losses = [value]
    for _ in range(rounds):
        # the inverse curvature from the last moves, applied to the gradient
        direction, used = gradient.copy(), []
        for s, y in reversed(moves):
            a = (s @ direction) / (s @ y)
            direction -= a * y
            used.append(a)
        if moves:
            s, y = moves[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y), a in zip(moves, reversed(used)):
            direction += (a - (y @ direction) / (s @ y)) * s
        slope = gradient @ direction
        if slope <= 0:
            direction, slope, moves = gradient, gradient @ gradient, []
        step = 1.0 if moves else min(1.0, 1.0 / max(np.abs(gradient).sum(), 1e-12))
        for _ in range(HALVINGS):
            new_value, new_gradient = function(x - step * direction)
            if new_value <= value - DECREASE * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * direction, new_gradient - gradient
        if s @ y > 1e-12 * (y @ y):
            moves = [*moves, (s, y)][-MEMORY:]
        x, gained = x + s, value - new_value
        value, gradient = new_value, new_gradient
        losses.append(value)
        if gained <= tolerance * max(abs(value), 1e-12):
            break
    return x, losses


# ------------------------------------------------------------------ J1-J3
@dataclass
class Network:
    """A layer of ``hidden`` tanh units between a vector and the classes; ``parameters`` in one row."""
    classes: list
    dims: int
    hidden: int
    mean: np.ndarray
    scale: np.ndarray
    parameters: np.ndarray

    def shapes(self) -> list[tuple[int, int]]:
        k = len(self.classes)
        return [(self.dims, self.hidden), (1, self.hidden), (self.hidden, k), (1, k)]

    def split(self, row: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for a, b in self.shapes():
            out.append(row[at:at + a * b].reshape(a, b))
            at += a * b
        return out

    def scores(self, x: np.ndarray, row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Standardised vectors, hidden units and log-probabilities."""
        w1, b1, w2, b2 = self.split(self.parameters if row is None else row)
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ w1 + b1)
        s = h @ w2 + b2
        s = s - s.max(1, keepdims=True)
        return z, h, s - np.log(np.exp(s).sum(1, keepdims=True))


def _moments(train: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Dimension, mean and deviation (1 where there is none) of a vector column."""
    at = train.select(F.posexplode(F.transform(vec, lambda v: v.cast("double"))).alias("i", "x"))
    rows = at.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()  # one row a dimension
    s = np.array([r["s"] for r in rows])
    return len(rows), np.array([r["m"] for r in rows]), np.where(s > 1e-12, s, 1.0)


def train_network(train: DataFrame, vec: str, label: str, hidden: int = 32, mode: str = "inverse", l2: float = 1e-4,
                  rounds: int = 100, seed: int = 42) -> Network:
    """A classifier with one hidden layer; rows weigh as their class does (``sampling.class_weights``).

    Rows without a vector or label take no part; no row at all is an error.
    ``l2`` is the weight of the squared parameters beside the mean loss.
    """
    t = train.where(F.col(vec).isNotNull() & F.col(label).isNotNull())
    weights = {r["position"]: float(r["weight"]) for r in class_weights(t, label, mode=mode).collect() if r["weight"]}
    classes = sorted(r[0] for r in t.select(F.col(label).cast("int")).distinct().collect())  # one row a class
    if not classes:
        raise ValueError("no row has both a vector and a label")
    t = written(t.select(F.transform(vec, lambda v: v.cast("double")).alias("v"), F.col(label).cast("int").alias("c")), "network-rows")
    dims, mean, scale = _moments(t, "v")
    net = Network(classes, dims, hidden, mean, scale, np.zeros(0))
    rng = np.random.default_rng(seed)
    net.parameters = np.concatenate([(rng.standard_normal(s) / np.sqrt(s[0]) if s[0] > 1 else np.zeros(s)).ravel() for s in net.shapes()])
    place = {c: i for i, c in enumerate(classes)}
    of_class = np.array([weights.get(c, 1.0) for c in classes])
    total = sum(of_class[place[r["c"]]] * r["n"] for r in t.groupBy("c").agg(F.count("*").alias("n")).collect())

    def loss(row: np.ndarray, pdf: pd.DataFrame) -> tuple[float, np.ndarray]:
        x = np.array(pdf["v"].tolist())
        y = pdf["c"].map(place).to_numpy()
        w = of_class[y] / total
        z, h, logs = net.scores(x, row)
        _, _, w2, _ = net.split(row)
        d = np.exp(logs)
        d[np.arange(len(y)), y] -= 1
        d *= w[:, None]
        e = (d @ w2.T) * (1 - h * h)
        parts = (z.T @ e, e.sum(0), h.T @ d, d.sum(0))
        return float(-(w * logs[np.arange(len(y)), y]).sum()), np.concatenate([p.ravel() for p in parts])

    def function(row: np.ndarray) -> tuple[float, np.ndarray]:
        value, gradient = summed_loss(t, loss, row)
        return value + l2 / 2 * (row @ row), gradient + l2 * row

    net.parameters, _ = minimise(function, net.parameters, rounds)
    return net


def predict_network(net: Network, df: DataFrame, vec: str, out: str = "prediction") -> DataFrame:
    """``df`` with the likeliest class; null without a vector."""
    @F.pandas_udf("int")
    def best(v: pd.Series) -> pd.Series:
        known = v.notna()
        result = pd.Series(pd.array([None] * len(v), dtype="Int32"), index=v.index)
        if known.any():
            logs = net.scores(np.array(v[known].tolist(), float))[2]
            result[known] = np.array(net.classes)[logs.argmax(1)]
        return result
    return df.withColumn(out, best(F.transform(vec, lambda x: x.cast("double"))))


# ------------------------------------------------------------------ J4-J5
def train_cosine_projection(train: DataFrame, x: str, y: str, l2: float = 1e-4, rounds: int = 100,
                            start: np.ndarray | None = None) -> np.ndarray:
    """The matrix (one row a dimension of ``x`` and one for the constant) whose products have the greatest mean cosine with ``y``.

    ``start``: where to begin, such as the ridge solution; else small random
    numbers.  Rows with a null vector, or a ``y`` of zeros, take no part.
    """
    double = lambda c: F.transform(c, lambda v: v.cast("double"))
    t = train.where(F.col(x).isNotNull() & F.exists(F.coalesce(F.col(y), F.array()), lambda v: v != 0))
    t = written(t.select(double(x).alias("x"), double(y).alias("y")), "projection-rows")
    first = t.agg(F.max(F.size("x")).alias("d"), F.max(F.size("y")).alias("k"), F.count("*").alias("n")).first()
    if not first["n"]:
        raise ValueError("no row has both vectors")
    shape = first["d"] + 1, first["k"]
    row = (np.random.default_rng(0).standard_normal(shape) / np.sqrt(shape[0]) if start is None else start).ravel()

    def loss(row: np.ndarray, pdf: pd.DataFrame) -> tuple[float, np.ndarray]:
        a = np.array(pdf["x"].tolist())
        a = np.c_[a, np.ones(len(a))]
        b = np.array(pdf["y"].tolist())
        b = b / np.linalg.norm(b, axis=1, keepdims=True)
        p = a @ row.reshape(shape)
        size = np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
        u = p / size
        cosine = (u * b).sum(1, keepdims=True)
        return float((1 - cosine).sum() / first["n"]), (a.T @ ((cosine * u - b) / size) / first["n"]).ravel()

    def function(row: np.ndarray) -> tuple[float, np.ndarray]:
        value, gradient = summed_loss(t, loss, row)
        return value + l2 / 2 * (row @ row), gradient + l2 * row

    return minimise(function, row, rounds)[0].reshape(shape)
