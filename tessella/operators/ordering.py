"""Sorts, pages, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialize


def by_pose(df: DataFrame, poses: str, cls: str) -> DataFrame:
    """Objects without poses first, then by the poses from the last part to the first, then by class."""
    return df.orderBy((F.size(poses) > 0).cast("int"), F.reverse(F.col(poses)), cls)


def hard_examples(df: DataFrame, by: str = "slack") -> list[Column]:
    """Order of examples by slack, average slack, alpha or suggestion, hardest first; what is missing counts -1e7 for slacks, else 0."""
    slack = {"slack": "slack", "average": "average_slack"}
    if by in slack:
        return [F.coalesce(F.col(slack[by]), F.lit(-1e7)).desc(), F.col("example")]
    return [F.coalesce(F.col(by), F.lit(0.0)).desc(), F.coalesce(F.col("average_slack"), F.lit(-1e7)).desc(), F.col("example")]


def page(df: DataFrame, order: list, start: int = 0, most: int = 100) -> DataFrame:
    """Rows ``start`` to ``start + most`` of the sorted table; Spark keeps that many a task, not all."""
    return df.orderBy(*order).offset(start).limit(most)


def condensed(samples: DataFrame, most: int) -> DataFrame:
    """Cached samples (example, sample, alpha) with a column kept: the ``most`` largest alphas of each example; zeros go."""
    order = Window.partitionBy("example").orderBy(F.col("alpha").desc(), "sample")
    return samples.where("alpha > 0").withColumn("place", F.row_number().over(order)).withColumn("kept", F.col("place") <= most)


def key_of(*columns: str, seed: int = 0) -> Column:
    """A repeatable random key: the md5 of the columns, so that any engine makes the same choice."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed)))
    return F.md5(text.cast("binary"))


def unit_of(*columns: str, seed: int = 0) -> Column:
    """A repeatable random number in (0, 1): the first 52 bits of ``key_of``."""
    return (F.conv(F.substring(key_of(*columns, seed=seed), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def shuffled(df: DataFrame, *columns: str, seed: int = 0) -> DataFrame:
    return df.orderBy(key_of(*columns, seed=seed))


def exact_split(df: DataFrame, columns: list[str], first: int, by: list[str], seed: int = 0) -> DataFrame:
    """``df`` with a column split: 0 for exactly ``first`` random rows of each group (all, if fewer), else 1.

    ``columns`` tell rows apart.  Only the first rows of each group by their
    keys are ranked, which tasks cut short before they meet; the last of them
    is the threshold that all rows are compared with.
    """
    mark = F.struct(key_of(*columns, seed=seed).alias("key"), *columns)
    named = {c: f"of_{c}" for c in by}
    keyed = df.select(*[F.col(c).alias(n) for c, n in named.items()], mark.alias("mark"))
    place = F.row_number().over(Window.partitionBy(*named.values()).orderBy("mark"))
    last = keyed.withColumn("place", place).where(F.col("place") <= first).groupBy(*named.values()).agg(F.max("mark").alias("last_mark"))
    same = F.lit(True)
    for c, n in named.items():
        same = same & df[c].eqNullSafe(last[n])
    late = F.coalesce(mark > F.col("last_mark"), F.lit(True))
    return df.join(last, same, "left").withColumn("split", late.cast("int")).drop(*named.values(), "last_mark")


def scheduled(examples: DataFrame, epoch: int, most: int) -> DataFrame:
    """The next ``most`` examples to train on: fewest iterations first, in an order shuffled anew each epoch."""
    return examples.orderBy("iterations", key_of("example", seed=epoch), "example").limit(most)


def class_order(df: DataFrame, by: str) -> list[Column]:
    """Orders of a confusion view: id, name, frequency or group."""
    return {"id": [F.col("id")], "name": [F.col("name"), F.col("id")], "frequency": [F.col("n").desc(), F.col("id")], "group": [F.col("group"), F.col("id")]}[by]


def by_class(cls: str, *ties: str) -> list[Column]:
    return [F.col(cls), *map(F.col, ties)]


def by_score(score: str, *ties: str) -> list[Column]:
    """Highest first; without a score last."""
    return [F.col(score).desc_nulls_last(), *map(F.col, ties)]


def by_loss(loss: str, *ties: str) -> list[Column]:
    """Lowest first; examples without one, which have nothing to show, before all."""
    return [F.col(loss).asc_nulls_first(), *map(F.col, ties)]


def by_size(value: str, *ties: str) -> list[Column]:
    """Values of features or samples, largest in size first."""
    return [F.abs(F.col(value)).desc_nulls_last(), *map(F.col, ties)]


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with its place, from 0, in an order of the whole table.

    Ranges of the order are sorted apart and numbered by the sums of the
    counts before them; only the counts reach the driver, never a single task.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("numbered_at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "numbered")
    part = F.shiftright("numbered_at", 33)
    starts, total = [], 0
    for p, n in sorted((r.part, r.n) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        starts.append((p, total))
        total += n
    begun = F.broadcast(spark.createDataFrame(starts, "numbered_part long, numbered_from long"))
    joined = ranged.join(begun, part == F.col("numbered_part"))
    return joined.withColumn("place", F.col("numbered_from") + F.col("numbered_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("numbered_at", "numbered_part", "numbered_from")


def sampled_points(points: DataFrame, image: str, columns: list[str], images: int, each: int, seed: int = 0) -> DataFrame:
    """For a codebook: ``each`` random points (told apart by ``columns``) of each of ``images`` random images.

    Images are chosen by the hashes of their ids alone; of the points of one
    image a task keeps no more than are wanted.
    """
    chosen = points.select(F.col(image).alias("of_image")).distinct().orderBy(key_of("of_image", seed=seed)).limit(images)
    joined = points.join(chosen, points[image] == chosen["of_image"]).drop("of_image")
    key = key_of(image, *columns, seed=seed)
    place = F.row_number().over(Window.partitionBy(image).orderBy(key, *columns))
    return joined.withColumn("place", place).where(F.col("place") <= each).drop("place")


def working_set(rows: DataFrame, gain: str, most: int, *ties: str) -> DataFrame:
    """The ``most`` rows that violate most."""
    return rows.orderBy(F.col(gain).desc(), *ties).limit(most)
