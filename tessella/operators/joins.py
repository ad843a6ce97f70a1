"""Joins that annotation data asks for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import rows_of, ship

#: Numbers that may be sent to each worker as one side of a search.
MOST_NUMBERS = 20_000_000
#: Rows of the other side that are compared at once.
BLOCK = 2048


def by_name(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """``df`` with the id of the name in ``column``; of equal names the first id counts, unknown ones have null.

    ``names``: id, name.
    """
    first = names.groupBy(F.col("name").alias("of_name")).agg(F.min("id").alias(f"{column}_id"))
    return df.join(first, F.col(column) == F.col("of_name"), "left").drop("of_name")


def renumbered(df: DataFrame, column: str, subset: list) -> DataFrame:
    """Rows whose ``column`` is in ``subset``, with its place in that list as new number."""
    places = F.create_map(*[F.lit(x) for i, v in enumerate(subset) for x in (v, i)])
    return df.where(F.col(column).isin(subset)).withColumn("new_id", F.element_at(places, F.col(column)))


def subset_map(df: DataFrame, column: str, subset: list) -> DataFrame:
    """(old id, new id) of all ids: places in ``subset``, -1 for dropped ones."""
    places = F.create_map(*[F.lit(x) for i, v in enumerate(subset) for x in (v, i)])
    return df.select(F.col(column).alias("old_id"), F.coalesce(F.try_element_at(places, F.col(column)), F.lit(-1)).alias("new_id"))


def checked_array(rows: list, column: str) -> tuple[list, np.ndarray]:
    """Ids and vectors of rows that are to be sent to each worker."""
    values = np.array([r[column] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))
    if values.size > MOST_NUMBERS:
        raise ValueError("this side of the search is too large to be sent to each worker")
    return [r["id"] for r in rows], values


def nearest(queries: DataFrame, points: DataFrame, k: int = 1, same_class: bool = False) -> DataFrame:
    """(id, place, found, distance): each query's ``k`` nearest points by squared distance, ties to the smaller id.

    Both sides: id, vector array<double>, and class where ``same_class`` limits
    the search to points of the query's class.  A query does not find its own
    id.  The queries, whose size is checked, go to every worker; each partition
    of points yields its k nearest of each query, which then meet.
    """
    spark = points.sparkSession
    ship(spark)
    asked = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    if asked.n * max(asked.width or 0, 1) > MOST_NUMBERS:
        raise ValueError("this side of the search is too large to be sent to each worker")
    rows = queries.select("id", "vector", *(["class"] if same_class else [])).collect()
    ids, vectors = checked_array(rows, "vector")
    held = spark.sparkContext.broadcast((np.array(ids, np.int64), vectors, np.array([r["class"] for r in rows]) if same_class else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, classes = held.value
        best = None
        for batch in batches:
            for low in range(0, batch.num_rows if len(ids) else 0, BLOCK):
                part = batch.slice(low, BLOCK)
                own = part.column(0).to_numpy(zero_copy_only=False)
                x = rows_of(part.column(1))
                gap = (vectors**2).sum(1)[:, None] - 2 * vectors @ x.T + (x**2).sum(1)[None, :]
                gap = np.round(np.maximum(gap, 0.0), 9)
                gap[ids[:, None] == own[None, :]] = np.inf
                if classes is not None:
                    gap[classes[:, None] != part.column(2).to_numpy(zero_copy_only=False)[None, :]] = np.inf
                named = np.broadcast_to(own[None, :], gap.shape)
                if best is not None:
                    gap, named = np.hstack([best[0], gap]), np.hstack([best[1], named])
                order = np.lexsort((named, gap), axis=1)[:, :k]
                best = np.take_along_axis(gap, order, 1), np.take_along_axis(named, order, 1)
        if best is not None:
            good = np.isfinite(best[0])
            row = np.nonzero(good)[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best[1][good]), pa.array(best[0][good])], ["id", "found", "distance"])

    columns = [F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), *(["class"] if same_class else [])]
    partial = points.select(*columns).mapInArrow(run, "id long, found long, distance double")
    order = Window.partitionBy("id").orderBy("distance", "found")
    return partial.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("id", "place", "found", "distance")


def _exact_gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, to nine digits, of each row to the centres that may be its nearest; infinity to all others.

    One matrix product tells which those are; only their distances are made
    term by term, so that ties are found as they are.
    """
    size = (x**2).sum(1)[:, None]
    rough = size - 2 * x @ centres.T + (centres**2).sum(1)[None, :]
    near = rough <= rough.min(1, keepdims=True) + 1e-7 * (1 + size)
    row, column = np.nonzero(near)
    out = np.full(rough.shape, np.inf)
    out[row, column] = np.round(((x[row] - centres[column]) ** 2).sum(1), 9)
    return out


def assign(points: DataFrame, centres: list[tuple[int, list[float]]], keep_vector: bool = False) -> DataFrame:
    """(id, cluster, distance), and vector if asked: the nearest centre of each point, ties to the first; no row moves.

    ``points``: id, vector array<double>.
    """
    spark = points.sparkSession
    ship(spark)
    ids, vectors = checked_array([{"id": i, "vector": v} for i, v in centres], "vector")
    held = spark.sparkContext.broadcast((np.array(ids, np.int64), vectors))
    names = ["id", "cluster", "distance", *(["vector"] if keep_vector else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centres = held.value
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                x = rows_of(part.column(1))
                gap = _exact_gaps(x, centres)
                best = gap.argmin(1)
                columns = [part.column(0), pa.array(ids[best]), pa.array(gap[np.arange(len(best)), best]), part.column(1)]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    return points.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "id long, cluster long, distance double" + ", vector array<double>" * keep_vector)


def class_scores(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(example, class, score): attribute scores times class weights, summed.  ``scores``: example, attribute, s; ``weights``: class, attribute, w."""
    return scores.join(weights, "attribute").groupBy("example", "class").agg(F.sum(F.col("s") * F.col("w")).alias("score"))


def paired_questions(events: DataFrame, start: str, end: str) -> DataFrame:
    """Each end beside the last start before it: whether it is of the same question, and the time between.

    ``events``: event_id, user_id, at, kind, question.
    """
    order = Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.last(F.when(F.col("kind") == start, F.struct("event_id", "question", "at")), ignorenulls=True).over(order)
    seen = events.where(F.col("kind").isin(start, end)).withColumn("begun", begun)
    ended = seen.where(F.col("kind") == end)
    return ended.select(
        "event_id", "user_id", "question", F.col("begun.event_id").alias("start_id"), F.coalesce(F.col("begun.question") == F.col("question"), F.lit(False)).alias("matches"),
        (F.col("at") - F.col("begun.at")).alias("ms"), F.floor((F.col("at") - F.col("begun.at")) / 1000).alias("seconds"),
    )


def agreeing(candidates: DataFrame, clicks: DataFrame, radius: float) -> DataFrame:
    """Candidates (object, part, x, y) within ``radius`` of a click of the same object: a semi join that keeps each once."""
    at = clicks.select(F.col("object").alias("of"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = (F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) <= radius * radius
    return candidates.join(at, (F.col("object") == F.col("of")) & near, "left_semi")


def part_distances(parts: DataFrame) -> DataFrame:
    """(a, b, distance, n): mean distance between each two visible parts, over objects that show both."""
    seen = parts.where("visible = 1")
    other = seen.select("object", F.col("part").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    gap = F.sqrt(F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2))
    return seen.withColumnRenamed("part", "a").join(other, "object").where("a < b").groupBy("a", "b").agg(F.avg(gap).alias("distance"), F.count("*").alias("n"))


def spanning_tree(pairs: list[tuple], seen: dict, cost_unseen: float = 0.0) -> list[tuple]:
    """(parent, child) of the least spanning tree, grown from the part seen most often.

    ``pairs``: (a, b, cost), a small table; ``seen``: times each part was seen.
    """
    cost = {}
    for a, b, c in pairs:
        cost[a, b] = cost[b, a] = c
    root = min(seen, key=lambda p: (-seen[p], p))
    inside, links = {root}, []
    while len(inside) < len(seen):
        edges = [(cost.get((a, b), float("inf")) if (a, b) in cost else 1e18 + cost_unseen, a, b) for a in inside for b in seen if b not in inside]
        _, a, b = min(edges)
        inside.add(b)
        links.append((a, b))
    return links
