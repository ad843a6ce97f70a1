"""Score maps and images as rows (keys, y, x, value): neighbours, templates, windows, masks, pyramids.

All of it joins cells with a small table of offsets or of places, so that a map
may be of any size and maps of any number; nothing is gathered on a worker.
``keys`` tell maps apart; without any there is one map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (code, dy, dx) of the eight neighbours, from the right counter-clockwise.
AROUND = ((0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1), (4, 0, -1), (5, 1, -1), (6, 1, 0), (7, 1, 1))


def _sent(cells: DataFrame, keys: list[str], offsets: list[tuple], name: str) -> DataFrame:
    """Each cell's value, sent to the places from which it lies at each of ``offsets`` (number, dy, dx)."""
    places = F.array(*[F.struct(F.lit(n).alias(name), (F.col("y") - dy).alias("to_y"), (F.col("x") - dx).alias("to_x")) for n, dy, dx in offsets])
    return cells.select(*[F.col(k).alias(f"to_{k}") for k in keys], F.inline(places), F.col("value").alias("sent"))


def neighbour_codes(cells: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, y, x, code, weight): which neighbour alone is above its cell, coded 0 to 7 from the right counter-clockwise.

    Where none or several are, and at the border, code and weight are 0.  A
    cell counts as border if any of its eight neighbours is missing.
    """
    sent = _sent(cells, keys, list(AROUND), "code")
    same = F.lit(True)
    for c in [*keys, "y", "x"]:
        same = same & (cells[c] == sent[f"to_{c}"])
    above = F.col("sent") > F.col("value")
    met = cells.join(sent, same, "left").groupBy(*[cells[c] for c in [*keys, "y", "x"]])
    met = met.agg(F.count("sent").alias("near"), F.coalesce(F.sum(above.cast("int")), F.lit(0)).alias("n"), F.min(F.when(above, F.col("code"))).alias("only"))
    alone = (F.col("near") == len(AROUND)) & (F.col("n") == 1)
    return met.select(*keys, "y", "x", F.when(alone, F.col("only")).otherwise(0).alias("code"), alone.cast("int").alias("weight"))


def slide(cells: DataFrame, template: dict[tuple[int, int], float], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, y, x, score) of a template {(dy, dx): weight} at each place where all its cells are there: the sum of products."""
    weights = F.create_map(*[F.lit(v) for n, w in enumerate(template.values()) for v in (n, float(w))])
    sent = _sent(cells, keys, [(n, dy, dx) for n, (dy, dx) in enumerate(template)], "part")
    scored = sent.groupBy(*[F.col(f"to_{c}").alias(c) for c in [*keys, "y", "x"]]).agg(F.sum(F.col("sent") * F.element_at(weights, F.col("part"))).alias("score"), F.count("*").alias("n"))
    return scored.where(F.col("n") == len(template)).drop("n")


def windows_at(cells: DataFrame, places: DataFrame, height: int, width: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(place, i, value): the window of ``height`` by ``width`` cells about each of ``places`` (place, y, x, flip, visible; keys), row by row.

    Cells beyond the map are 0, as are all of a place that is not visible; with
    flip each row runs from right to left.
    """
    spots = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(i // width - height // 2).alias("dy"), F.lit(i % width - width // 2).alias("dx"), F.lit(i // width * width + width - 1 - i % width).alias("mirrored")) for i in range(height * width)])
    wanted = places.select(*[F.col(k).alias(f"at_{k}") for k in keys], "place", F.col("y").alias("py"), F.col("x").alias("px"), "flip", "visible", F.inline(spots))
    same = (F.col("py") + F.col("dy") == cells["y"]) & (F.col("px") + F.col("dx") == cells["x"]) & F.col("visible")
    for k in keys:
        same = same & (F.col(f"at_{k}") == cells[k])
    joined = wanted.join(cells, same, "left")
    return joined.select("place", F.when(F.col("flip"), F.col("mirrored")).otherwise(F.col("i")).alias("i"), F.coalesce("value", F.lit(0.0)).alias("value"))


def mask_windows(cells: DataFrame, places: DataFrame, height: int, width: int, colour: float | None = None, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The same of a segmentation: 1 where a cell has ``colour`` (or any but 0, without one), else 0."""
    hit = (F.col("value") == colour) if colour is not None else (F.col("value") != 0)
    return windows_at(cells.withColumn("value", hit.cast("double")), places, height, width, keys)


def word_histograms(words: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, word, value): each visual word's share of each of ``windows`` (window, y0, x0, height, width): 1 / (height width) a cell within the map.

    ``words``: y, x, word.  Windows meet cells by rows, so that a pair is made
    only for cells that they hold.
    """
    rows = windows.select("window", "x0", "height", "width", F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("height") - 1)).alias("wy"))
    met = words.join(rows, (words["y"] == rows["wy"]) & words["x"].between(F.col("x0"), F.col("x0") + F.col("width") - 1))
    return met.groupBy("window", "word").agg(F.sum(1.0 / (F.col("height") * F.col("width"))).alias("value"))


def pyramid(cells: DataFrame, levels: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(level, keys, y, x, value): the map, and at each further level means over cells of twice the size, in one pass."""
    each = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    placed = each.select("level", *keys, F.expr("shiftright(y, level)").alias("y"), F.expr("shiftright(x, level)").alias("x"), "value")
    return placed.groupBy("level", *keys, "y", "x").agg(F.avg("value").alias("value"))


def mirrored(cells: DataFrame, width: int) -> DataFrame:
    """The map from right to left."""
    return cells.withColumn("x", F.lit(width - 1) - F.col("x"))


def bordered(cells: DataFrame, height: int, width: int, border: int, fill: float = 0.0) -> DataFrame:
    """(y, x, value) with ``border`` cells of ``fill`` on each side; missing cells are filled too."""
    spark = cells.sparkSession
    rows = spark.range(height + 2 * border).select(F.col("id").cast("int").alias("to_y"))
    every = rows.withColumn("to_x", F.explode(F.sequence(F.lit(0), F.lit(width + 2 * border - 1))))
    same = (every["to_y"] == cells["y"] + border) & (every["to_x"] == cells["x"] + border)
    return every.join(cells, same, "left").select(F.col("to_y").alias("y"), F.col("to_x").alias("x"), F.coalesce("value", F.lit(fill)).alias("value"))


def blitted(base: DataFrame, other: DataFrame, dy: int = 0, dx: int = 0) -> DataFrame:
    """(y, x, value): ``base`` with ``other`` drawn over it at an offset, the larger value of each cell; what falls outside of base is left out."""
    moved = other.select((F.col("y") + dy).alias("oy"), (F.col("x") + dx).alias("ox"), F.col("value").alias("drawn"))
    joined = base.join(moved, (base["y"] == moved["oy"]) & (base["x"] == moved["ox"]), "left")
    return joined.select("y", "x", F.greatest("value", F.coalesce("drawn", F.col("value"))).alias("value"))


def affine(y: Column, x: Column, matrix: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """(y, x) of a point under the 2 by 3 matrix (a, b, c, d, e, f): x' = a x + b y + c, y' = d x + e y + f."""
    a, b, c, d, e, f = (F.lit(float(v)) for v in matrix)
    return d * x + e * y + f, a * x + b * y + c


def resized(cells: DataFrame, width: int, new_width: int) -> DataFrame:
    """(y, x, value) of a map of ``width`` columns scaled to ``new_width``, rows in proportion: the mean of the cells that fall together, as when images are read small."""
    ratio = F.lit(float(new_width) / width)
    return cells.groupBy(F.floor(F.col("y") * ratio).cast("int").alias("y"), F.floor(F.col("x") * ratio).cast("int").alias("x")).agg(F.avg("value").alias("value"))
