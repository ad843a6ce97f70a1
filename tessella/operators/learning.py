"""Online linear learning: steps, dual weights, and models kept up with added, removed and relabelled examples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import rows_of, ship

#: Classes times features of a model that is sent to each worker.
MOST_WEIGHTS = 20_000_000


def gradient_step(samples: DataFrame, weights: DataFrame, regulariser: float, step: int) -> DataFrame:
    """(index, value) of the weights after one subgradient step over all samples: w (1 - 1/t) + mean of violated differences / (lambda t).

    ``samples``: example, index, value: the feature difference of truth and
    most violated label, where there is one; ``weights``: index, value.
    """
    count = samples.agg(F.countDistinct("example").alias("n"))
    moved = samples.groupBy("index").agg(F.sum("value").alias("g")).join(F.broadcast(count)).select("index", (F.col("g") / F.col("n") / (regulariser * step)).alias("value"))
    kept = weights.select("index", (F.col("value") * (1 - 1 / step)).alias("value"))
    return kept.unionByName(moved).groupBy("index").agg(F.sum("value").alias("value"))


def dual_step(samples: DataFrame, regulariser: float, n: int) -> DataFrame:
    """The closed-form step of each example's dual weight, kept within 0 and 1.

    ``samples``: example, alpha, slack (score - true score + loss), sqr (squared
    length of the feature difference).  Returns the new alpha and the change.
    """
    ideal = F.when(F.col("sqr") > 0, F.col("alpha") + F.col("slack") * F.lit(regulariser * n) / F.col("sqr")).otherwise(F.col("alpha"))
    return samples.withColumn("new_alpha", F.least(F.greatest(ideal, F.lit(0.0)), F.lit(1.0))).withColumn("change", F.col("new_alpha") - F.col("alpha"))


def recomputed_weights(duals: DataFrame, differences: DataFrame, regulariser: float, n: int) -> DataFrame:
    """w = sum of alpha times feature differences over lambda n.  ``duals``: example, alpha; ``differences``: example, index, value."""
    return differences.join(duals, "example").groupBy("index").agg((F.sum(F.col("alpha") * F.col("value")) / F.lit(regulariser * n)).alias("value"))


def in_ball(weights: DataFrame, radius: float) -> DataFrame:
    """Weights scaled back to length ``radius`` if longer."""
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(F.lit(0))))
    return weights.withColumn("value", F.col("value") * F.when(length > radius, F.lit(radius) / length).otherwise(F.lit(1.0)))


def current_examples(events: DataFrame) -> DataFrame:
    """The training set after add, relabel and remove events (seq, example, action, ..): the last event of each example, unless it removes."""
    last = Window.partitionBy("example").orderBy(F.col("seq").desc())
    return events.withColumn("place", F.row_number().over(last)).where((F.col("place") == 1) & (F.col("action") != "remove")).drop("place", "action")


class Learner:
    """A multiclass linear model trained by subgradients over the whole table, one pass a round.

    ``points``: id, vector array<double>, label 0 .. classes - 1.  The loss is
    0 / 1 or a matrix; a round sends the weights out and one partial gradient a
    task back, so that its cost to the driver does not grow with the rows.
    """

    def __init__(self, classes: int, regulariser: float = 1e-3, costs: np.ndarray | None = None):
        self.classes, self.regulariser = classes, regulariser
        self.costs = 1.0 - np.eye(classes) if costs is None else np.asarray(costs, float)
        self.weights: np.ndarray | None = None
        self.trace: list[float] = []

    def _round(self, points: DataFrame, w: np.ndarray) -> tuple[np.ndarray, float, float]:
        ship(points.sparkSession)
        held = points.sparkSession.sparkContext.broadcast((w, self.costs))
        width = w.size + 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, costs = held.value
            total = np.zeros(width)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = rows_of(batch.column(0))
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
                score = x @ w.T + costs[y]
                best = score.argmax(1)
                slack = score[np.arange(len(y)), best] - (x * w[y]).sum(1)
                g = np.zeros_like(w)
                np.add.at(g, y, x)
                np.add.at(g, best, -x)
                total[:-2] += g.ravel()
                total[-2] += slack.sum()
                total[-1] += len(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["i", "v"])

        columns = points.select(F.col("vector").cast("array<double>").alias("vector"), F.col("label").cast("int").alias("label"))
        out = np.zeros(width)
        for r in columns.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r.i] = r.v
        n = max(out[-1], 1)
        return out[:-2].reshape(w.shape) / n, out[-2] / n, n

    def train(self, points: DataFrame, rounds: int = 20) -> Learner:
        """Subgradient descent with steps 1 / (lambda t); the mean of the later half of the iterates is kept."""
        d = len(points.select("vector").first().vector)
        if d * self.classes > MOST_WEIGHTS:
            raise ValueError("the model is too large to be sent to each worker")
        w = np.zeros((self.classes, d)) if self.weights is None else self.weights
        kept, used = np.zeros_like(w), 0
        for t in range(1, rounds + 1):
            gradient, slack, _ = self._round(points, w)
            self.trace.append(slack + self.regulariser / 2 * float((w**2).sum()))
            w = (1 - 1 / (t + 1)) * w + gradient / (self.regulariser * (t + 1))
            length = np.linalg.norm(w)
            w *= min(1.0, np.sqrt(2 / self.regulariser) / length) if length else 1.0
            if 2 * t > rounds:
                kept, used = kept + w, used + 1
        self.weights = kept / max(used, 1)
        return self

    def objective(self, points: DataFrame) -> float:
        _, slack, _ = self._round(points, self.weights)
        return slack + self.regulariser / 2 * float((self.weights**2).sum())

    def predict(self, points: DataFrame) -> DataFrame:
        """(id, label, score) of the best class."""
        ship(points.sparkSession)
        held = points.sparkSession.sparkContext.broadcast(self.weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = rows_of(batch.column(1)) @ held.value.T
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score.argmax(1).astype(np.int32)), pa.array(score.max(1))], ["id", "label", "score"])

        return points.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "id long, label int, score double")
