"""Confusion, accuracy, losses and calibration."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, *by: str) -> DataFrame:
    """Counts of (truth, prediction), also by further columns such as the question's number."""
    return predictions.groupBy(*by, "gt", "pred").agg(F.count("*").alias("n"))


def confusion_totals(predictions: DataFrame) -> DataFrame:
    """Counts with totals by truth, by prediction and over all."""
    return predictions.cube("gt", "pred").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def confusion_json(predictions: DataFrame, names: DataFrame) -> DataFrame:
    """One row with nodes and links as JSON.  ``names``: id, name, a table of classes."""
    links = confusion(predictions).agg(F.sort_array(F.collect_list(F.struct(F.col("gt").alias("source"), F.col("pred").alias("target"), F.col("n").alias("value")))).alias("links"))
    nodes = names.agg(F.sort_array(F.collect_list(F.struct("id", "name"))).alias("nodes"))
    return nodes.join(links).select(F.to_json(F.struct("nodes", "links")).alias("json"))


def topk_accuracy(ranks: DataFrame, window: int, *by: str) -> DataFrame:
    """Share of rows whose true class is within the first ``window`` ranks."""
    return ranks.groupBy(*by).agg(F.avg((F.col("true_rank") <= window).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def test_summary(predictions: DataFrame, weight_norm: float = 0.0, regulariser: float = 0.0) -> DataFrame:
    """Mean loss and slack (score - true score + loss), and slack plus the regulariser's share."""
    slack = F.col("score") - F.col("gt_score") + F.col("loss")
    return predictions.agg(F.avg("loss").alias("loss"), F.avg(slack).alias("slack"), (F.avg(slack) + F.lit(regulariser / 2 * weight_norm**2)).alias("svm_error"))


def lookup_cost(predictions: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """Loss of each (gt, pred): the cost table's, or 0 / 1 where it has none.  ``costs``: gt, pred, cost."""
    zero_one = (F.col("gt") != F.col("pred")).cast("double")
    if costs is None:
        return predictions.withColumn("loss", zero_one)
    return predictions.join(costs, ["gt", "pred"], "left").withColumn("loss", F.coalesce("cost", zero_one)).drop("cost")


def drag_losses(errors: DataFrame, drags: int, threshold: float) -> DataFrame:
    """(step, loss): mean number of parts with an error above ``threshold`` after each number of corrections.

    ``errors``: example, step, part, error; examples that stopped earlier count 0; the mean is over all examples.
    """
    examples = errors.agg(F.countDistinct("example").alias("examples"))
    steps = errors.groupBy("step").agg(F.sum((F.col("error") > threshold).cast("long")).alias("wrong"))
    every = examples.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(drags))))
    return every.join(steps, "step", "left").select("step", (F.coalesce("wrong", F.lit(0)) / F.col("examples")).alias("loss"))


def correct_worst(locations: DataFrame, threshold: float, most: int) -> DataFrame:
    """Simulated correction: an annotator fixes the part of the largest error, again and again.

    ``locations``: example, part, error.  Fixing a part sets its error to 0, so
    the state after each step follows from the order of errors: (example, step,
    part, error) of each correction, while the largest error is above ``threshold``.
    """
    order = Window.partitionBy("example").orderBy(F.col("error").desc(), "part")
    return locations.withColumn("step", F.row_number().over(order)).where((F.col("error") > threshold) & (F.col("step") <= most)).select("example", "step", "part", "error")


def class_costs(weights: DataFrame) -> DataFrame:
    """(gt, pred, cost): distance between the classes' attribute vectors over the largest.  ``weights``: class, attribute, w."""
    other = weights.select(F.col("class").alias("pred"), "attribute", F.col("w").alias("v"))
    pairs = weights.withColumnRenamed("class", "gt").join(other, "attribute").groupBy("gt", "pred").agg(F.sqrt(F.sum(F.pow(F.col("w") - F.col("v"), 2))).alias("distance"))
    most = F.max("distance").over(Window.partitionBy(F.lit(0)))
    return pairs.select("gt", "pred", F.when(most > 0, F.col("distance") / most).otherwise(F.lit(0.0)).alias("cost"))


def centred_signs(weights: DataFrame) -> DataFrame:
    """Each class's attribute weight less the attribute's mean, and its sign."""
    centred = F.col("w") - F.avg("w").over(Window.partitionBy("attribute"))
    return weights.withColumn("centred", centred).withColumn("sign", F.signum("centred").cast("int"))


def gram(weights: DataFrame, norms: DataFrame) -> DataFrame:
    """Products of classes' attribute vectors, each attribute weighed by its norm.  ``norms``: attribute, sqr."""
    other = weights.select(F.col("class").alias("class_b"), "attribute", F.col("w").alias("v"))
    joined = weights.withColumnRenamed("class", "class_a").join(other, "attribute").join(norms, "attribute")
    return joined.groupBy("class_a", "class_b").agg(F.sum(F.col("w") * F.col("v") * F.col("sqr")).alias("product"))


def line_search(objective: Callable[[float], float], low: float = 1e-4, high: float = 1e4, steps: int = 40) -> float:
    """The factor of the least objective: golden sections of its logarithm."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = math.log(low), math.log(high)
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = objective(math.exp(c)), objective(math.exp(d))
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = objective(math.exp(c))
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = objective(math.exp(d))
    return math.exp((a + b) / 2)


def softmax_nll(scores: DataFrame, gammas: list[float]) -> DataFrame:
    """(gamma, nll): summed negative log-likelihood of the true class, for many factors in one pass.

    ``scores``: example, class, gt, score.
    """
    every = scores.withColumn("gamma", F.explode(F.array(*[F.lit(float(g)) for g in gammas])))
    most = F.max(F.col("gamma") * F.col("score")).over(Window.partitionBy("gamma", "example"))
    raised = every.withColumn("z", F.col("gamma") * F.col("score") - most)
    by_example = raised.groupBy("gamma", "example").agg(F.ln(F.sum(F.exp("z"))).alias("total"), F.max(F.when(F.col("class") == F.col("gt"), F.col("z"))).alias("true"))
    return by_example.groupBy("gamma").agg(F.sum(F.col("total") - F.col("true")).alias("nll"))


def calibrate(scores: DataFrame, rounds: int = 4, points: int = 9) -> float:
    """The factor on scores of the least negative log-likelihood: a grid that narrows, one job a round."""
    low, high = math.log(1e-3), math.log(1e3)
    best = 0.0
    for _ in range(rounds):
        grid = [math.exp(low + (high - low) * k / (points - 1)) for k in range(points)]
        found = {r.gamma: r.nll for r in softmax_nll(scores, grid).collect()}
        best = math.log(min(found, key=lambda g: (found[g], g)))
        width = (high - low) / (points - 1)
        low, high = best - width, best + width
    return math.exp(best)


def mean_when_known(value: Column, known: Column) -> Column:
    return F.avg(F.when(known, value))
