"""Running statistics, local maxima, downsampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_mean(value: Column, rows: int, order: str, *by: str) -> Column:
    """Mean of the last ``rows`` values, of fewer at the start."""
    return F.avg(value).over(Window.partitionBy(*(by or (F.lit(0),))).orderBy(order).rowsBetween(1 - rows, 0))


def bucketed_trailing_mean(series: DataFrame, value: str, order: str, rows: int) -> DataFrame:
    """``series`` with the trailing mean over one global order, without gathering it in one task.

    ``order`` counts from 0 without gaps.  Rows lie in blocks of ``rows``; the
    window of a row reaches into the block before at most, whose rows come
    twice.
    """
    block = F.floor(F.col(order) / F.lit(rows))
    own = series.withColumn("block", block).withColumn("own", F.lit(True))
    copy = own.withColumn("block", F.col("block") + 1).withColumn("own", F.lit(False))
    window = Window.partitionBy("block").orderBy(order).rowsBetween(1 - rows, 0)
    return own.unionByName(copy).withColumn("mean", F.avg(value).over(window)).where("own").drop("block", "own")


def pair_compacted(series: DataFrame, order: str, value: str, times: int) -> DataFrame:
    """Means of each 2 ** times neighbours, which is what halving a full buffer so often leaves; a short end keeps its own mean."""
    return series.groupBy(F.floor(F.col(order) / F.lit(1 << times)).alias("bin")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def statistics(trace: DataFrame, window: int) -> DataFrame:
    """By iteration: trailing means of error, dual and regularisation, and the gap between them, epsilon.

    ``trace``: iter (from 0, without gaps), error, dual, regularisation.
    """
    out = bucketed_trailing_mean(trace, "error", "iter", window)
    return out.withColumn("epsilon", F.col("mean") - F.col("dual") / (F.col("iter") + 1) + F.col("regularisation"))


def by_example(trace: DataFrame) -> DataFrame:
    """Iterations numbered within their example, and each one's share of them so far."""
    order = Window.partitionBy("example").orderBy("iter")
    return trace.withColumn("visit", F.row_number().over(order)).withColumn("mean_error", F.avg("error").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def cumulative(df: DataFrame, value: str, order: list, *by: str) -> DataFrame:
    """Running sum and share within each group."""
    window = Window.partitionBy(*by)
    ran = window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(value).over(ran)).withColumn("share", F.col("running") / F.sum(value).over(window))


def weighted_pick(df: DataFrame, value: str, order: list, *by: str, at: float = 0.5) -> DataFrame:
    """The first row of each group whose running share reaches ``at``: a draw by inverse distribution."""
    ran = cumulative(df, value, order, *by).where(F.col("share") >= at)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("running", *order))
    return ran.withColumn("place", place).where("place = 1").drop("place")


def local_maxima(grid: DataFrame) -> DataFrame:
    """Cells (y, x, score) above all four neighbours; absent neighbours don't count."""
    row, column = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")
    out = grid
    for name, window, axis, step in (("left", row, "x", 1), ("right", row, "x", -1), ("up", column, "y", 1), ("down", column, "y", -1)):
        other = F.lag(F.struct(axis, "score"), step).over(window)
        out = out.withColumn(name, F.when(other[axis] == F.col(axis) - step, other["score"]))
    above = F.lit(True)
    for name in ("left", "right", "up", "down"):
        above = above & F.coalesce(F.col("score") > F.col(name), F.lit(True))
    return out.where(above).select("y", "x", "score")


def every_nth(df: DataFrame, order: str, most: int, total: int) -> DataFrame:
    """At most ``most`` of ``total`` points: each one whose place in ``order`` (from 0) the stride divides."""
    return df.where(F.col(order) % max(1, -(-total // most)) == 0)


def feature_offsets(lengths: DataFrame, order: str, *by: str) -> DataFrame:
    """Where each block of features begins in the joined vector: the sum of the lengths before it."""
    before = Window.partitionBy(*(by or (F.lit(0),))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lengths.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def scatter_add(weights: DataFrame, updates: DataFrame) -> DataFrame:
    """``weights`` (index, value) plus ``updates`` (offset, i, value) at offset + i."""
    moved = updates.select((F.col("offset") + F.col("i")).alias("index"), "value")
    return weights.select("index", "value").unionByName(moved).groupBy("index").agg(F.sum("value").alias("value"))
