"""Codebooks of visual words and of Fisher vectors, learnt from sampled points; pose clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import vectors as ml
from tessella.operators.joins import assign
from tessella.operators.ordering import sampled_points

IMAGES, EACH = 1000, 50


def _sample(points: DataFrame, images: int, each: int) -> DataFrame:
    """(id, vector) of ``each`` random points (image, y, x, vector) of each of ``images`` random images."""
    return sampled_points(points, "image", ["y", "x"], images, each).select(F.xxhash64("image", "y", "x").alias("id"), "vector")


def word_codebook(points: DataFrame, words: int, images: int = IMAGES, each: int = EACH, depth: int = 0) -> dict[str, np.ndarray]:
    """Centres of the words by k-means; with ``depth`` the planes of a tree of 2 ** depth words instead, by which points are assigned in ``depth`` steps."""
    sample = _sample(points, images, each)
    if depth:
        return {"planes": ml.hierarchical(sample, depth)}
    return {"words": ml.kmeans(sample, words)[0]}


def fisher_codebook(points: DataFrame, words: int, dims: int, images: int = IMAGES, each: int = EACH) -> dict[str, np.ndarray]:
    """Means, variances and weights of a mixture over the points; if ``dims`` is less than theirs, over their principal components, which are given too."""
    sample = _sample(points, images, each)
    width = sample.select(F.max(F.size("vector"))).first()[0]
    out = {}
    if dims < width:
        mean, components, _ = ml.principal_components(sample, dims)
        sample = ml.projected(sample, mean, components)
        out = {"mean": mean, "components": components}
    mu, var, weight, _ = ml.mixture(sample, words)
    return out | {"mu": mu, "var": var, "weight": weight}


def words_of(points: DataFrame, codebook: dict[str, np.ndarray]) -> DataFrame:
    """(id, word) of points (id, vector) by either kind of word codebook."""
    if "planes" in codebook:
        depth = int(np.log2(len(codebook["planes"]) + 1))
        return ml.tree_assign(points, codebook["planes"], depth).select("id", F.col("leaf").alias("word"))
    placed = assign(points, [(i, c.tolist()) for i, c in enumerate(codebook["words"])])
    return placed.select("id", F.col("cluster").cast("int").alias("word"))


def pose_clusters(offsets: DataFrame, centres: DataFrame, unseen_cost: float) -> DataFrame:
    """(object, cluster, cost): the nearest of some poses of each object.

    ``offsets``: object, part, dx, dy, visible; ``centres``: cluster, part, dx,
    dy, visible.  A part that both see costs the squared distance of its
    offsets, one that only one of them sees ``unseen_cost``; ties go to the
    smaller cluster.  Parts meet by number, so that an object has a row a
    cluster and part, and nothing is gathered.
    """
    known = centres.select("cluster", F.col("part").alias("of_part"), F.col("dx").alias("cx"), F.col("dy").alias("cy"), F.col("visible").alias("shown"))
    met = offsets.join(known, offsets["part"] == known["of_part"])
    both, one = (F.col("visible") == 1) & (F.col("shown") == 1), F.col("visible") != F.col("shown")
    gap = F.pow(F.col("dx") - F.col("cx"), 2) + F.pow(F.col("dy") - F.col("cy"), 2)
    cost = F.when(both, gap).when(one, F.lit(float(unseen_cost))).otherwise(0.0)
    each = met.groupBy("object", "cluster").agg(F.round(F.sum(cost), 6).alias("cost"))
    return each.groupBy("object").agg(F.min(F.struct("cost", "cluster")).alias("best")).select("object", "best.cluster", "best.cost")
