"""Nested annotation rows: parts, flips, coordinates, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.numbers import clamp, round_away

#: What files hold in place of an unknown coordinate.
LATENT = -1000000.0


def known(value: Column) -> Column:
    """The sentinel for an unknown coordinate as null."""
    return F.when(value != LATENT, value)


def as_file(value: Column) -> Column:
    return F.coalesce(value, F.lit(LATENT))


def zero_rotations(locations: str | Column) -> Column:
    """Locations with a known place get rotation 0."""
    return F.transform(locations, lambda p: F.when(p["x"].isNotNull(), p.withField("rotation", F.lit(0.0))).otherwise(p))


def scale_conversion(pairs: DataFrame, min_width: float) -> DataFrame:
    """(object, scale): the mean distance of visible parts to their parents over ``min_width``, 1 at least."""
    gap = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return pairs.groupBy("object").agg(F.greatest(F.lit(1.0), F.avg(gap) / F.lit(min_width)).alias("scale"))


def flipped(parts: DataFrame, twins: DataFrame, width: int) -> DataFrame:
    """Parts of mirrored images: x from the other side, rotation turned, part and pose replaced by their twins.

    ``parts``: object, part, x, y, and rotation and pose where present; ``twins``: part, twin.
    """
    out = parts.join(twins, "part", "left").withColumn("part", F.coalesce("twin", "part")).drop("twin").withColumn("x", F.lit(float(width - 1)) - F.col("x"))
    return out.withColumn("rotation", -F.col("rotation")) if "rotation" in out.columns else out


def to_detection(x: Column, y: Column, scale: int, factor: float, cell: int, width: int, height: int) -> tuple[Column, Column]:
    """Cells of the score map at a scale level, kept within the map."""
    step = cell * factor**scale
    return tuple(clamp(round_away(v / F.lit(step)), F.lit(0), F.lit(n - 1)).cast("int") for v, n in ((x, width), (y, height)))


def to_image(x: Column, y: Column, scale: int, factor: float, cell: int) -> tuple[Column, Column]:
    step = cell * factor**scale
    return x * F.lit(step), y * F.lit(step)


def objects_of(dataset: DataFrame) -> DataFrame:
    """One row a valid object of each example; the older form, a label without a list, is a single object.

    ``dataset``: x, y with objects array<struct<.., isValid>>.
    """
    valid = F.filter(F.coalesce(F.col("y.objects"), F.array()), lambda o: F.coalesce(o["isValid"], F.lit(True)))
    return dataset.select("x", F.posexplode(valid).alias("object_no", "object"))


def part_rows(objects: DataFrame, parts: DataFrame) -> DataFrame:
    """A row for each part of each object: unknown names are skipped, absent parts are null.

    ``objects``: key, locations array<struct<part, ..>>; ``parts``: id, name.
    """
    told = objects.select("key", F.explode("locations").alias("location")).select("key", F.col("location.part").alias("name"), "location")
    first = told.groupBy("key", "name").agg(F.first("location").alias("location"))
    every = objects.select("key").join(parts)
    return every.join(first, ["key", "name"], "left").select("key", "id", "name", "location")


def answers_of(users: DataFrame, attributes: int) -> DataFrame:
    """Attribute answers by place: user rows with codes 'answer,certainty,seconds', one for each attribute."""
    from tessella.functions.strings import answer_of

    right = F.assert_true(F.size("codes") == attributes, F.lit("as many answers as attributes are needed"))
    checked = users.where(right.isNull())
    return checked.select("key", F.posexplode("codes").alias("attribute", "code")).select("key", "attribute", answer_of(F.col("code")).alias("a")).select("key", "attribute", "a.*")


def consistent(labels: DataFrame) -> DataFrame:
    """Labels that a partial one allows: all, or those of its class."""
    return labels.where(F.col("partial").isNull() | (F.col("class") == F.col("partial")))


def askable(questions: DataFrame, click: bool = True, binary: bool = True, multiple: bool = True, vision: bool = True) -> DataFrame:
    """Questions of the kinds that are not switched off; batches go with multiple choice, clicks with vision."""
    kind = F.col("type")
    off = F.lit(False)
    if not (click and vision):
        off = off | (kind == "part_click")
    if not binary:
        off = off | (kind == "binary")
    if not multiple:
        off = off | kind.isin("multiple_choice", "batch")
    return questions.where(~off)


def topological(spark, parts: DataFrame) -> DataFrame:
    """(part, depth): parts under their parents, by a recursive query; deepest first is children before parents.

    ``parts``: part, parent (null at the root).
    """
    parts.createOrReplaceTempView("tessella_parts")
    return spark.sql(
        """WITH RECURSIVE tree(part, depth) AS (
             SELECT part, 0 FROM tessella_parts WHERE parent IS NULL
             UNION ALL SELECT p.part, t.depth + 1 FROM tessella_parts p JOIN tree t ON p.parent = t.part)
           SELECT part, depth FROM tree"""
    )
