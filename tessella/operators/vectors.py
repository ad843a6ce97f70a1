"""k-means, mixtures, principal components, Fisher vectors, bags of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.joins import BLOCK, assign
from tessella.session import rows_of, ship

RESTARTS, SHORT, LONG = 10, 2, 15


def kmeans_step(points: DataFrame, centres: list[tuple[int, list[float]]]) -> tuple[DataFrame, DataFrame]:
    """(cluster, j, value) of the new centres, and (id, cluster, distance) before the move; an empty cluster keeps its place by absence.

    Vectors stay with their assignment; components are averaged with map-side combining.
    """
    placed = assign(points, centres, keep_vector=True)
    moved = placed.select("cluster", F.posexplode("vector").alias("j", "v")).groupBy("cluster", "j").agg(F.avg("v").alias("value"))
    return moved, placed.drop("vector")


def mirrored_step(pairs: DataFrame, centres: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """One step of k-means over points that come in pairs, as do the centres (2i and 2i + 1): a point's twin belongs to its centre's twin.

    ``pairs``: id, vector, twin (array<double> both).  Returns (cluster, j,
    value) of the new centres, over both points of all pairs, and (id, cluster,
    distance): the centre of the first point with the least sum of squared
    distances of both; ties go to the first.
    """
    ship(pairs.sparkSession)
    if len(centres) % 2:
        raise ValueError("centres come in pairs")
    held = pairs.sparkSession.sparkContext.broadcast(np.asarray(centres, np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        other = c[np.arange(len(c)) ^ 1]
        gaps = lambda x, y: (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None, :]
        for batch in batches:
            if batch.num_rows:
                gap = np.round(gaps(rows_of(batch.column(1)), c) + gaps(rows_of(batch.column(2)), other), 9)
                best = gap.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(gap[np.arange(len(best)), best])], ["id", "vector", "twin", "cluster", "distance"])

    columns = pairs.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("array<double>").alias(c) for c in ("vector", "twin")])
    placed = columns.mapInArrow(run, "id long, vector array<double>, twin array<double>, cluster long, distance double")
    both = F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.col("vector").alias("v")), F.struct(F.col("cluster").bitwiseXOR(F.lit(1)).alias("c"), F.col("twin").alias("v"))))
    flat = placed.select(both.alias("b")).select(F.col("b.c").alias("cluster"), F.posexplode("b.v").alias("j", "x"))
    return flat.groupBy("cluster", "j").agg(F.avg("x").alias("value")), placed.select("id", "cluster", "distance")


def _partial_sums(points: DataFrame, kernel, width: int) -> np.ndarray:
    """The sum over all points of an array that ``kernel`` makes of each block: one partial array a task, summed by the engine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                if part.num_rows:
                    total += kernel(rows_of(part.column(0))).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["i", "v"])

    ship(points.sparkSession)
    rows = points.select(F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for r in rows:
        out[r.i] = r.v
    return out


def _seeds(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """k-means++ on a sample of bounded size: each next centre is drawn by squared distance to those before."""
    rows = points.orderBy(F.xxhash64("id", F.lit(seed))).limit(max(2000, 40 * k)).select("vector").collect()
    x = np.array([r.vector for r in rows], np.float64)
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(x)))]
    for _ in range(min(k, len(x)) - 1):
        gap = ((x[:, None, :] - x[picked][None, :, :]) ** 2).sum(2).min(1)
        picked.append(int(rng.choice(len(x), p=gap / gap.sum())) if gap.sum() > 0 else int(rng.integers(len(x))))
    return x[picked]


def kmeans(points: DataFrame, k: int, restarts: int = RESTARTS, rounds: int = LONG, seed: int = 0) -> tuple[np.ndarray, float]:
    """Centres and error: short runs from several seeds, the best of them carried on while the error falls.

    ``points``: id, vector.  A round reads the points once; each task sends k
    sums.  An empty cluster keeps its centre.
    """

    def step(centres: np.ndarray) -> tuple[np.ndarray, float]:
        n, d = centres.shape

        def kernel(x: np.ndarray) -> np.ndarray:
            gap = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :]
            best = gap.argmin(1)
            out = np.zeros((n, d + 2))
            np.add.at(out[:, :d], best, x)
            np.add.at(out[:, d], best, 1)
            np.add.at(out[:, d + 1], best, gap[np.arange(len(x)), best])
            return out

        sums = _partial_sums(points, kernel, n * (d + 2)).reshape(n, d + 2)
        full = sums[:, d] > 0
        moved = centres.copy()
        moved[full] = sums[full, :d] / sums[full, d : d + 1]
        return moved, float(sums[:, d + 1].sum())

    best, error = None, np.inf
    for r in range(restarts):
        centres = _seeds(points, k, seed + r)
        for _ in range(SHORT):
            centres, e = step(centres)
        if e < error:
            best, error = centres, e
    for _ in range(rounds + 1):
        moved, e = step(best)
        if e >= error - 1e-12 * max(1.0, error):
            break
        best, error = moved, e
    return best, error


def _leaf_of(x: np.ndarray, planes: np.ndarray, depth: int) -> np.ndarray:
    """The node of level ``depth`` in which each row lies, counted within the level."""
    node = np.zeros(len(x), np.int64)
    for _ in range(depth):
        side = (x * planes[node, :-1]).sum(1) + planes[node, -1] > 0
        node = 2 * node + 1 + side
    return node - (2**depth - 1)


def _farthest(points: DataFrame, kernel, centres: np.ndarray) -> np.ndarray:
    """For each node the point farthest from its row of ``centres``, ties to the lower id; NaN without points.

    ``kernel`` gives the node of each point.  Each task sends one point a node.
    """
    n, d = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                x, ids = rows_of(part.column(1)), part.column(0).to_numpy(zero_copy_only=False)
                node = kernel(x)
                gap = ((x - centres[node]) ** 2).sum(1)
                order = np.lexsort((ids, -gap, node))
                for i in order[np.unique(node[order], return_index=True)[1]].tolist():
                    now = (-gap[i], int(ids[i]), x[i])
                    if int(node[i]) not in best or now[:2] < best[int(node[i])][:2]:
                        best[int(node[i])] = now
        if best:
            rows = sorted(best.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int32()), pa.array([v[0] for _, v in rows], pa.float64()), pa.array([v[1] for _, v in rows], pa.int64()), pa.array([v[2].tolist() for _, v in rows], pa.list_(pa.float64()))],
                ["node", "minus", "id", "vector"],
            )

    ship(points.sparkSession)
    rows = points.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "node int, minus double, id long, vector array<double>")
    out = np.full((n, d), np.nan)
    for r in rows.groupBy("node").agg(F.min(F.struct("minus", "id", "vector")).alias("first")).collect():
        out[r.node] = r.first.vector
    return out


def hierarchical(points: DataFrame, depth: int) -> np.ndarray:
    """Planes (w, b) of a binary tree: each node's points are parted by 2-means; an empty right branch never takes any.

    ``points``: id, vector.  A level's nodes are fitted together, over all
    points: a round reads them once and each task sends two sums a node.  The
    first centre of a node is its point farthest from its mean, the second the
    point farthest from the first, ties to the lower id.
    """
    d = len(points.select("vector").first().vector) if not points.isEmpty() else 0
    planes = np.zeros((2**depth - 1, d + 1))
    if not d:
        return planes
    for level in range(depth):
        n, known = 2**level, planes.copy()

        def node_of(x: np.ndarray, known=known, level=level) -> np.ndarray:
            return _leaf_of(x, known, level)

        def parted(two: np.ndarray, n=n, node_of=node_of) -> np.ndarray:
            """For each node and side the sum of its points and their number; a point goes right if it is nearer to the second centre."""

            def kernel(x: np.ndarray) -> np.ndarray:
                node = node_of(x)
                right = ((x - two[node, 1]) ** 2).sum(1) < ((x - two[node, 0]) ** 2).sum(1)
                out = np.zeros((n, 2, d + 1))
                np.add.at(out, (node, right.astype(np.int64)), np.column_stack([x, np.ones(len(x))]))
                return out

            return _partial_sums(points, kernel, n * 2 * (d + 1)).reshape(n, 2, d + 1)

        total = parted(np.zeros((n, 2, d)))[:, 0]
        first = _farthest(points, node_of, total[:, :-1] / np.maximum(total[:, -1:], 1))
        second = _farthest(points, node_of, np.nan_to_num(first))
        two = np.nan_to_num(np.stack([first, second], axis=1))
        moving = np.isfinite(first).all(1) & (first != second).any(1)
        split = moving.copy()
        for _ in range(LONG):
            sums = parted(two)
            # a node rests when a side is empty or its centres stay
            moving &= (sums[:, :, -1] > 0).all(1)
            moved = np.where(moving[:, None, None], sums[:, :, :-1] / np.maximum(sums[:, :, -1:], 1), two)
            moving &= (moved != two).any((1, 2))
            two = moved
            if not moving.any():
                break
        at = np.arange(n) + n - 1
        planes[at, :-1] = np.where(split[:, None], 2 * (two[:, 1] - two[:, 0]), 0)
        planes[at, -1] = np.where(split, (two[:, 0] ** 2).sum(1) - (two[:, 1] ** 2).sum(1), -10000.0)
    return planes


def tree_assign(points: DataFrame, planes: np.ndarray, depth: int) -> DataFrame:
    """(id, leaf): each point goes down by the signs of its planes; native expressions over the array column."""
    node = F.lit(0)
    table = F.array(*[F.array(*[F.lit(float(v)) for v in plane]) for plane in planes])
    for _ in range(depth):
        plane = F.element_at(table, node + 1)
        side = F.aggregate(F.zip_with(F.col("vector"), F.slice(plane, 1, planes.shape[1] - 1), lambda a, b: a * b), F.element_at(plane, -1), lambda s, v: s + v)
        node = 2 * node + 1 + (side > 0).cast("int")
    return points.select("id", (node - (2**depth - 1)).alias("leaf"))


def mixture_step(points: DataFrame, mu: np.ndarray, var: np.ndarray, weight: np.ndarray, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One round of expectation-maximisation of a Gaussian mixture with diagonal variances; also the log-likelihood before it."""
    k, d = mu.shape
    constant = np.log(weight) - 0.5 * (d * np.log(2 * np.pi) + np.log(var).sum(1))

    def kernel(x: np.ndarray) -> np.ndarray:
        z = constant - 0.5 * ((x[:, None, :] - mu) ** 2 / var).sum(2)
        top = z.max(1, keepdims=True)
        total = np.exp(z - top).sum(1, keepdims=True)
        post = np.exp(z - top) / total
        out = np.zeros((k, 2 * d + 2))
        out[:, :d], out[:, d : 2 * d], out[:, 2 * d] = post.T @ x, post.T @ x**2, post.sum(0)
        out[0, 2 * d + 1] = (np.log(total) + top).sum()
        return out

    sums = _partial_sums(points, kernel, k * (2 * d + 2)).reshape(k, -1)
    mass = np.maximum(sums[:, 2 * d], 1e-12)
    new_mu = sums[:, :d] / mass[:, None]
    new_var = np.maximum(sums[:, d : 2 * d] / mass[:, None] - new_mu**2, floor)
    empty = sums[:, 2 * d] < 1e-9
    if empty.any():  # an empty component takes half of the largest
        big = int(mass.argmax())
        for c in np.flatnonzero(empty):
            new_mu[c], new_var[c] = new_mu[big] + 1e-3 * np.sqrt(new_var[big]), new_var[big]
            mass[c] = mass[big] = mass[big] / 2
    return new_mu, new_var, mass / mass.sum(), float(sums[0, 2 * d + 1])


def mixture(points: DataFrame, k: int, rounds: int = LONG, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Means, variances, weights and the log-likelihood by round, from k-means centres."""
    mu, _ = kmeans(points, k, restarts=3, seed=seed)
    d = mu.shape[1]
    total = _partial_sums(points, lambda x: np.concatenate([x.sum(0), (x**2).sum(0), [len(x)]]), 2 * d + 1)
    var = np.tile(np.maximum(total[d : 2 * d] / total[-1] - (total[:d] / total[-1]) ** 2, 1e-6), (k, 1))
    weight, trace = np.full(k, 1 / k), []
    for _ in range(rounds):
        mu, var, weight, fit = mixture_step(points, mu, var, weight)
        trace.append(fit)
        if len(trace) > 1 and trace[-1] <= trace[-2] + 1e-9 * abs(trace[-2]):
            break
    return mu, var, weight, trace


def covariance(points: DataFrame) -> DataFrame:
    """(a, b, cov): sample covariance of each two components; pairs are made within the row and combined on the map side."""
    v, last = F.col("vector"), F.size("vector") - 1
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.element_at(v, a + 1).alias("x"), F.element_at(v, b + 1).alias("y"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda a: F.transform(F.sequence(a, last), lambda b: pair(a, b))))
    return points.select(F.explode(pairs).alias("p")).select("p.*").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"))


def principal_components(points: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (rows) and variances: the covariance comes from sums of products, one array a task."""
    d = len(points.select("vector").first().vector)
    sums = _partial_sums(points, lambda x: np.concatenate([(x.T @ x).ravel(), x.sum(0), [len(x)]]), d * d + d + 1)
    n = sums[-1]
    mean = sums[d * d : -1] / n
    cov = (sums[: d * d].reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1)
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value)[:dims]
    return mean, vector[:, order].T, value[order]


def projected(points: DataFrame, mean: np.ndarray, components: np.ndarray) -> DataFrame:
    """(id, vector) in the space of the components, centred first."""
    ship(points.sparkSession)
    held = points.sparkSession.sparkContext.broadcast((mean, components))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, components = held.value
        for batch in batches:
            x = rows_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list((x - mean) @ components.T), pa.list_(pa.float64()))], ["id", "vector"])

    return points.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "id long, vector array<double>")


def fisher_vectors(points: DataFrame, mu: np.ndarray, var: np.ndarray, weight: np.ndarray) -> DataFrame:
    """(image, component, j, d_mu, d_sigma): gradients of each image's points under a mixture.

    ``points``: image, vector.  Each task yields partial sums by image, which then meet.
    """
    ship(points.sparkSession)
    held = points.sparkSession.sparkContext.broadcast((mu, var, weight))
    k, d = mu.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mu, var, weight = held.value
        constant = np.log(weight) - 0.5 * (d * np.log(2 * np.pi) + np.log(var).sum(1))
        for batch in batches:
            x = rows_of(batch.column(1))
            scaled = (x[:, None, :] - mu) / np.sqrt(var)
            z = constant - 0.5 * (scaled**2).sum(2)
            post = np.exp(z - z.max(1, keepdims=True))
            post /= post.sum(1, keepdims=True)
            images, place = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            first, second, count = np.zeros((len(images), k, d)), np.zeros((len(images), k, d)), np.zeros(len(images))
            np.add.at(first, place, post[:, :, None] * scaled)
            np.add.at(second, place, post[:, :, None] * (scaled**2 - 1))
            np.add.at(count, place, 1)
            shape = first.shape
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(images, k * d)), pa.array(np.tile(np.repeat(np.arange(k, dtype=np.int32), d), len(images))),
                    pa.array(np.tile(np.arange(d, dtype=np.int32), len(images) * k)), pa.array(first.ravel()), pa.array(second.ravel()), pa.array(np.repeat(count, k * d)),
                ],
                ["image", "component", "j", "a", "b", "n"],
            )
            assert shape == second.shape

    partial = points.select(F.col("image").cast("long").alias("image"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "image long, component int, j int, a double, b double, n double")
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weight]), F.col("component") + 1)
    summed = partial.groupBy("image", "component", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n"))
    return summed.select("image", "component", "j", (F.col("a") / (F.col("n") * F.sqrt(share))).alias("d_mu"), (F.col("b") / (F.col("n") * F.sqrt(2 * share))).alias("d_sigma"))


def power_normalised(fisher: DataFrame) -> DataFrame:
    """Signed square roots, then unit length within each image."""
    root = lambda c: F.signum(c) * F.sqrt(F.abs(F.col(c)))
    rooted = fisher.withColumns({"d_mu": root("d_mu"), "d_sigma": root("d_sigma")})
    length = F.sqrt(F.sum(F.col("d_mu") ** 2 + F.col("d_sigma") ** 2).over(Window.partitionBy("image")))
    over = lambda c: F.when(length > 0, F.col(c) / length).otherwise(F.lit(0.0))
    return rooted.withColumns({"d_mu": over("d_mu"), "d_sigma": over("d_sigma")})


def word_histogram(words: DataFrame) -> DataFrame:
    """(image, word, n, share) from (image, word)."""
    counted = words.groupBy("image", "word").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("image")))


def pyramid(cells: DataFrame, levels: int, width: int, height: int) -> DataFrame:
    """(image, level, cell, word, n): histograms over 4 ** level windows; every word falls into one window a level.

    ``cells``: image, x, y, word with 0 <= x < width, 0 <= y < height.
    """
    every = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    side = F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2.0), F.col("level")).cast("int")
    cell = F.floor(F.col("y") * side / F.lit(height)) * side + F.floor(F.col("x") * side / F.lit(width))
    return every.groupBy("image", "level", cell.cast("int").alias("cell"), "word").agg(F.count("*").alias("n"))


def argmax_class(scores: DataFrame, margin: bool = False) -> DataFrame:
    """(example, class, score): the best class of each example, ties to the lower; with ``margin`` wrong classes gain 1."""
    value = F.col("score") + (F.when(F.col("class") != F.col("gt"), 1.0).otherwise(0.0) if margin else F.lit(0.0))
    best = F.max(F.struct(F.round(value, 9).alias("value"), (-F.col("class")).alias("minus")))
    return scores.groupBy("example").agg(best.alias("best")).select("example", (-F.col("best.minus")).alias("class"), F.col("best.value").alias("score"))
