"""Suppression of overlapping boxes, and scored boxes as text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import ship


def greedy(x, y, w, h, score, part, overlap: float) -> np.ndarray:
    """Which boxes stay: from the highest score down, each one that overlaps none that stays by more than ``overlap``."""
    order = np.lexsort((part, -score))
    left, kept = order, []
    while len(left):
        best, left = left[0], left[1:]
        kept.append(best)
        wide = np.minimum(x[left] + w[left], x[best] + w[best]) - np.maximum(x[left], x[best])
        high = np.minimum(y[left] + h[left], y[best] + h[best]) - np.maximum(y[left], y[best])
        shared = np.maximum(wide, 0) * np.maximum(high, 0)
        union = w[left] * h[left] + w[best] * h[best] - shared
        left = left[~(shared > overlap * np.where(union > 0, union, 1))]
    out = np.zeros(len(x), bool)
    out[kept] = True
    return out


#: Objects with more boxes are solved one by one, the others together.
MANY = 48


def greedy_groups(group, x, y, w, h, score, part, overlap: float) -> np.ndarray:
    """``greedy`` within each of many groups, at once: the boxes of one rank, over all groups, against those of each later rank."""
    order = np.lexsort((part, -score, group))
    g, x, y, w, h = (v[order] for v in (group, x, y, w, h))
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(g)]])))
    size = np.repeat(np.diff(np.concatenate([starts, [len(g)]])), np.diff(np.concatenate([starts, [len(g)]])))
    stays = np.ones(len(g), bool)
    for r in range(int(rank.max()) if len(g) else 0):
        for step in range(1, int(size.max()) - r):
            i = np.flatnonzero((rank == r) & stays & (size > r + step))
            if not len(i):
                break
            j = i + step
            wide = np.minimum(x[i] + w[i], x[j] + w[j]) - np.maximum(x[i], x[j])
            high = np.minimum(y[i] + h[i], y[j] + h[j]) - np.maximum(y[i], y[j])
            shared = np.maximum(wide, 0) * np.maximum(high, 0)
            union = w[i] * h[i] + w[j] * h[j] - shared
            stays[j[shared > overlap * np.where(union > 0, union, 1)]] = False
    out = np.empty(len(g), bool)
    out[order] = stays
    return out


def suppress(boxes: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Boxes (object, part, x, y, w, h, score) that stay within each object.

    One shuffle by object; objects then follow each other in sorted partitions
    and are solved from Arrow batches, several at a time.
    """
    ship(boxes.sparkSession)
    columns = ["object", "part", "x", "y", "w", "h", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                held = batch if held is None else pa.concat_batches([held, batch])
                ids = held.column(0).to_numpy(zero_copy_only=False)
                last = int(np.searchsorted(ids, ids[-1])) if len(ids) and (np.diff(ids) >= 0).all() else 0
            else:
                last = held.num_rows if held is not None else 0
            if held is None or not last:
                continue
            ready, held = held.slice(0, last), held.slice(last)
            ids = ready.column(0).to_numpy(zero_copy_only=False)
            rest = [ready.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3, 4, 5, 6, 1)]
            cuts = np.array([0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)])
            sizes = np.repeat(np.diff(cuts), np.diff(cuts))
            keep = np.ones(len(ids), bool)
            small = sizes <= MANY
            keep[small] = greedy_groups(ids[small], *(c[small] for c in rest), overlap)
            for a, b in zip(cuts, cuts[1:]):
                if b - a > MANY:
                    keep[a:b] = greedy(*(c[a:b] for c in rest), overlap)
            yield ready.filter(pa.array(keep))

    typed = boxes.select(F.col("object").cast("long").alias("object"), F.col("part").cast("long").alias("part"), *[F.col(c).cast("double").alias(c) for c in columns[2:]])
    laid = typed.repartition("object").sortWithinPartitions("object")
    return laid.mapInArrow(run, "object long, part long, x double, y double, w double, h double, score double")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def detection_lines(boxes: DataFrame, name: str = "name") -> DataFrame:
    """'name score x1 y1 x2 y2', one line a box."""
    corner = [F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")]
    return boxes.select(F.concat_ws(" ", F.col(name).cast("string"), F.col("score").cast("string"), *[c.cast("string") for c in corner]).alias("line"))


def parsed_detections(lines: DataFrame) -> DataFrame:
    part = F.split(F.trim("line"), r"\s+")
    names = ["score", "x1", "y1", "x2", "y2"]
    return lines.select(F.element_at(part, 1).alias("name"), *[F.element_at(part, k + 2).cast("double").alias(n) for k, n in enumerate(names)])


def sampled_frames(frames: DataFrame, every: int = 30, offset: int = 29) -> DataFrame:
    return frames.where(F.col("frame") % every == offset)
