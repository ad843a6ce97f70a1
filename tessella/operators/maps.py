"""Score maps and images as rows: each map is one row, kernels run where it lies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import grids
from tessella.operators.ordering import unit_of
from tessella.session import ship

MAP = "id long, height int, width int, channels int, values array<double>"


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray]]:
    for row in batch.to_pylist():
        a = np.array(row["values"], np.float64)
        yield row, a.reshape(row["height"], row["width"], row["channels"]) if row["channels"] > 1 else a.reshape(row["height"], row["width"])


def transformed(maps: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``kernel`` of every map (id, height, width, channels, values in row order); it may change the shape.

    Maps are independent, so no row moves.  Extension point: any function of an array.
    """
    ship(maps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, a in _rows(batch):
                b = np.asarray(kernel(a), np.float64)
                out.append({"id": row["id"], "height": b.shape[0], "width": b.shape[1], "channels": b.shape[2] if b.ndim > 2 else 1, "values": b.ravel().tolist()})
            if out:
                kinds = [("id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("values", pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return maps.select("id", "height", "width", "channels", "values").mapInArrow(run, MAP)


def spread(maps: DataFrame, linear: tuple, quadratic: tuple) -> DataFrame:
    """Generalised distance transform of each map."""
    return transformed(maps, lambda a: grids.distance_transform_2d(a, linear, quadratic)[0])


def histograms(maps: DataFrame, cell: int = 8, bins: int = 9) -> DataFrame:
    return transformed(maps, lambda a: grids.oriented_histograms(a, cell, bins))


def patterns(maps: DataFrame) -> DataFrame:
    """Two channels: the code of the one neighbour above each cell, and its weight."""
    return transformed(maps, lambda a: np.dstack(grids.binary_patterns(a)))


def detected(maps: DataFrame, template: np.ndarray) -> DataFrame:
    return transformed(maps, lambda a: grids.slide(a if a.ndim > 2 else a[..., None], template if template.ndim > 2 else template[..., None]))


def flipped(maps: DataFrame) -> DataFrame:
    return transformed(maps, lambda a: a[:, ::-1])


def bordered(maps: DataFrame, size: int, value: float = 0.0) -> DataFrame:
    return transformed(maps, lambda a: np.pad(a, [(size, size), (size, size), *[(0, 0)] * (a.ndim - 2)], constant_values=value))


def channel(maps: DataFrame, which: int) -> DataFrame:
    return transformed(maps, lambda a: a[..., which])


def resized(maps: DataFrame, height: int, width: int) -> DataFrame:
    """Each cell of the new size takes the nearest old one."""
    pick = lambda n, m: np.minimum((np.arange(m) + 0.5) * n / m, n - 1).astype(int)
    return transformed(maps, lambda a: a[np.ix_(pick(a.shape[0], height), pick(a.shape[1], width))])


def filtered(maps: DataFrame, weights: np.ndarray) -> DataFrame:
    """Correlation with ``weights``, edges repeated, the shape kept."""
    h, w = weights.shape

    def kernel(a: np.ndarray) -> np.ndarray:
        wide = np.pad(a, [(h // 2, h - 1 - h // 2), (w // 2, w - 1 - w // 2)], mode="edge")
        return np.einsum("yxhw,hw->yx", np.lib.stride_tricks.sliding_window_view(wide, (h, w)), weights)

    return transformed(maps, kernel)


def lab(maps: DataFrame) -> DataFrame:
    """Red, green and blue from 0 to 255 as CIE L, a, b."""

    def kernel(a: np.ndarray) -> np.ndarray:
        x = a / 255
        linear = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92)
        # sRGB to XYZ, over the white point D65.
        xyz = linear @ np.array([[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]]).T / np.array([0.95047, 1.0, 1.08883])
        f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
        return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)

    return transformed(maps, kernel)


def probability_maps(maps: DataFrame) -> DataFrame:
    """Each map from 0 to 1."""
    return transformed(maps, grids.min_max)


def cells(maps: DataFrame) -> DataFrame:
    """(id, y, x, channel, value): maps as rows of cells, for relational work."""
    flat = maps.select("id", "width", "channels", F.posexplode("values").alias("p", "value"))
    per_row = F.col("width") * F.col("channels")
    return flat.select("id", F.floor(F.col("p") / per_row).cast("int").alias("y"), F.floor(F.col("p") % per_row / F.col("channels")).cast("int").alias("x"), (F.col("p") % F.col("channels")).alias("channel"), "value")


def best_responses(cells: DataFrame, *by: str) -> DataFrame:
    """The highest cell of each group, ties to the upper left."""
    return cells.groupBy(*by).agg(F.max(F.struct("value", (-F.col("y")).alias("my"), (-F.col("x")).alias("mx"))).alias("b")).select(*by, (-F.col("b.my")).alias("y"), (-F.col("b.mx")).alias("x"), F.col("b.value").alias("value"))


def diverse_maxima(maps: DataFrame, most: int, radius: float, least: float = float("-inf")) -> DataFrame:
    """(id, place, y, x, value): up to ``most`` best cells of each map, none within ``radius`` of a better one."""
    ship(maps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, a in _rows(batch):
                a = a.copy()
                y, x = np.indices(a.shape)
                for place in range(1, most + 1):
                    at = np.unravel_index(a.argmax(), a.shape)
                    if not a[at] > least or np.isneginf(a[at]):
                        break
                    out.append((row["id"], place, int(at[0]), int(at[1]), float(a[at])))
                    a[(y - at[0]) ** 2 + (x - at[1]) ** 2 <= radius**2] = -np.inf
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "place", "y", "x", "value"])

    return maps.select("id", "height", "width", "channels", "values").mapInArrow(run, "id long, place int, y int, x int, value double")


def infer_trees(maps: DataFrame, children: dict, springs: dict, root: int) -> DataFrame:
    """(id, part, y, x, score): best placement of all parts in each image.

    ``maps``: id, part and a map for each part of the tree.  An image's maps,
    bounded by its size and the number of parts, come together in one row.
    """
    ship(maps.sparkSession)
    whole = maps.groupBy("id").agg(F.collect_list(F.struct("part", "height", "width", "values")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                unary = {p["part"]: np.array(p["values"]).reshape(p["height"], p["width"]) for p in row["parts"]}
                score, places = grids.tree_max_sum(unary, children, springs, root)
                out += [(row["id"], part, y, x, score) for part, (y, x) in sorted(places.items())]
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "part", "y", "x", "score"])

    return whole.mapInArrow(run, "id long, part int, y int, x int, score double")


def with_evidence(cells: DataFrame, clicks: DataFrame, gamma: float, wx: float, wy: float) -> DataFrame:
    """Cells (id, part, y, x, value) plus the soft scores of all clicks (id, part, x, y) on their own image and part.

    The sum over clicks is a polynomial of the cell's place, so that one row a
    part, of the clicks' number and moments, is all that is joined.
    """
    sums = {f"{k}_{c}": F.sum(F.pow(F.col(c), k)) for c in ("x", "y") for k in (1, 2)}
    moments = clicks.groupBy(F.col("id").alias("of_id"), F.col("part").alias("of_part")).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in sums.items()])
    square = lambda c: F.col("n") * F.pow(F.col(c), 2) - 2 * F.col(c) * F.col(f"1_{c}") + F.col(f"2_{c}")
    soft = -F.lit(gamma) * (F.lit(wx) * square("x") + F.lit(wy) * square("y"))
    joined = cells.join(moments, (cells["id"] == moments["of_id"]) & (cells["part"] == moments["of_part"]), "left")
    return joined.withColumn("value", F.col("value") + F.coalesce(soft, F.lit(0.0))).drop("of_id", "of_part", "n", *sums)


def placed_only(cells: DataFrame, given: DataFrame) -> DataFrame:
    """Where a part's place is given, that cell alone; all cells of other parts."""
    known = given.select("id", "part", F.col("y").alias("gy"), F.col("x").alias("gx"))
    return cells.join(known, ["id", "part"], "left").where(F.col("gy").isNull() | ((F.col("y") == F.col("gy")) & (F.col("x") == F.col("gx")))).drop("gy", "gx")


def with_priors(cells: DataFrame, bias: float, by_cell: dict[int, float], levels: int, height: int, width: int) -> DataFrame:
    """Cells plus a constant and a prior for the window of a 2 ** levels grid that each lies in (by number, row by row)."""
    side = 1 << levels
    window = F.floor(F.col("y") * side / height) * side + F.floor(F.col("x") * side / width)
    prior = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for k, w in by_cell.items() for v in (k, float(w))]), window.cast("int")), F.lit(0.0)) if by_cell else F.lit(0.0)
    return cells.withColumn("value", F.col("value") + F.lit(float(bias)) + prior)


def drawn(rows: DataFrame, by: list[str], order: list[str], mass: str, draws: int, seed: int = 0) -> DataFrame:
    """(by, draw, order): of each group ``draws`` rows, by ``mass``: the inverse of the running sum in ``order``.

    Draws are numbers by md5 of the group and the draw's number.  They are
    sorted in among the starts of the rows' shares, and each takes the last row
    that begins before it, so that rows and draws are never paired.
    """
    group = Window.partitionBy(*by)
    ran = rows.select(*by, *order, F.col(mass).cast("double").alias("mass")).where("mass > 0")
    ran = ran.withColumn("whole", F.sum("mass").over(group)).withColumn("upto", F.sum("mass").over(group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    starts = ran.select(*by, F.struct(*order).alias("row"), (F.coalesce("upto", F.lit(0.0)) / F.col("whole")).alias("at"), F.lit(None).cast("int").alias("draw"))
    groups = rows.select(*by).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    asked = groups.select(*by, F.lit(None).cast(starts.schema["row"].dataType).alias("row"), unit_of(*by, "draw", seed=seed).alias("at"), "draw")
    last = F.last("row", ignorenulls=True).over(group.orderBy("at", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return starts.unionByName(asked).withColumn("row", last).where("draw is not null and row is not null").select(*by, "draw", "row.*")


def sampled_cells(cells: DataFrame, draws: int, gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, draw, y, x): ``draws`` cells of each map, by exp(gamma * value)."""
    mass = F.exp(F.lit(gamma) * (F.col("value") - F.max("value").over(Window.partitionBy("id"))))
    return drawn(cells.withColumn("mass", mass), ["id"], ["y", "x"], "mass", draws, seed)
