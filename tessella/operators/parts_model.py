"""Part models: weights in one vector, pairwise features, ideal places, class scores from attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.numbers import circular_difference, iou
from tessella.operators.ordering import unit_of
from tessella.session import materialize


def flattened_weights(weights: DataFrame, kinds: list[str]) -> DataFrame:
    """(index, value, kind, owner): all weights end to end, kinds in the order given, owners by number.

    ``weights``: kind, owner, values array<double>.  Offsets are running sums of lengths over the owners, a small table.
    """
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    sized = weights.where(order > 0).withColumn("length", F.size("values")).withColumn("order", order)
    before = Window.partitionBy(F.lit(0)).orderBy("order", "owner").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.select(F.posexplode("values").alias("i", "value"), "kind", "owner", "offset").select((F.col("offset") + F.col("i")).alias("index"), "value", "kind", "owner")


def restored_weights(flat: DataFrame) -> DataFrame:
    """The reverse: (kind, owner, values)."""
    return flat.groupBy("kind", "owner").agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "value"))), lambda s: s["value"]).alias("values"))


def pairwise_features(pairs: DataFrame, orientations: int = 8) -> DataFrame:
    """Features of each parent and child: offset, its square, and circular difference of orientations.

    ``pairs``: dx, dy, ideal_x, ideal_y, rotation, parent_rotation (steps).
    """
    x, y = F.col("dx") - F.col("ideal_x"), F.col("dy") - F.col("ideal_y")
    turn = circular_difference(F.col("rotation"), F.col("parent_rotation"), orientations)
    return pairs.withColumn("features", F.array(-x, -y, -x * x, -y * y, -(turn * turn).cast("double")))


def pairwise_score(features: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(features, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def best_offsets(transitions: DataFrame) -> DataFrame:
    """Of each child's transitions the one of the largest weight: (parent, child, dx, dy)."""
    best = F.max_by(F.struct("dx", "dy"), F.struct("weight", (-F.col("transition")).alias("first")))
    return transitions.groupBy("parent", "child").agg(best.alias("b")).select("parent", "child", "b.dx", "b.dy")


def ideal_places(spark: SparkSession, offsets: DataFrame, root: int, x: float, y: float, scale: float = 1.0) -> DataFrame:
    """(part, x, y): all parts at their ideal offsets from the root down, by a recursive query."""
    offsets.createOrReplaceTempView("tessella_offsets")
    return spark.sql(
        f"""WITH RECURSIVE placed(part, x, y) AS (
              SELECT {int(root)}, CAST({float(x)} AS DOUBLE), CAST({float(y)} AS DOUBLE)
              UNION ALL SELECT o.child, p.x + o.dx * {float(scale)}, p.y + o.dy * {float(scale)} FROM tessella_offsets o JOIN placed p ON o.parent = p.part)
            SELECT part, x, y FROM placed"""
    )


def has_transitions(transitions: DataFrame, clicks: bool = False) -> DataFrame:
    """One row: whether there is any transition of the kind."""
    return transitions.agg(F.coalesce(F.bool_or(F.col("is_click") == clicks), F.lit(False)).alias("found"))


def mirrored(poses: DataFrame, twins: DataFrame) -> DataFrame:
    """Poses and their mirrored copies: names with a suffix, offsets turned, parts replaced by their twins.

    ``poses``: pose, part, dx, dy; ``twins``: part, twin.
    """
    other = poses.join(twins, "part", "left")
    copy = other.select(F.concat("pose", F.lit("_flipped")).alias("pose"), F.coalesce("twin", "part").alias("part"), (-F.col("dx")).alias("dx"), "dy")
    return poses.select("pose", "part", "dx", "dy").unionByName(copy)


def click_parts(parts: DataFrame) -> DataFrame:
    """Parts and a click twin of each."""
    copy = parts.select(F.concat("name", F.lit("_click")).alias("name"), F.col("name").alias("of"), F.lit(True).alias("is_click"))
    return parts.select("name", F.lit(None).cast("string").alias("of"), F.lit(False).alias("is_click")).unionByName(copy)


def offset_vectors(parts: DataFrame, pivot: DataFrame, unseen: float = 0.0) -> DataFrame:
    """(id, vector): each object's offsets from its pivot part, part by part; unseen parts have ``unseen``.

    ``pivot``: object, px, py.  Input to pose clustering by k-means.
    """
    numbers = parts.select("part").distinct()
    every = pivot.select("object", "px", "py").join(numbers)
    told = every.join(parts.where("visible = 1").select("object", "part", "x", "y"), ["object", "part"], "left")
    pair = F.struct("part", F.coalesce(F.col("x") - F.col("px"), F.lit(unseen)).alias("dx"), F.coalesce(F.col("y") - F.col("py"), F.lit(unseen)).alias("dy"))
    gathered = told.groupBy(F.col("object").alias("id")).agg(F.sort_array(F.collect_list(pair)).alias("all"))
    return gathered.select("id", F.flatten(F.transform("all", lambda p: F.array(p["dx"], p["dy"]))).alias("vector"))


def attribute_class_inference(scores: DataFrame, weights: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """(example, class, score): the best class by attribute scores times class attributes; with ``costs`` the most violating one.

    ``scores``: example, gt, attribute, s; ``weights``: class, attribute, w; ``costs``: gt, pred, cost.
    """
    summed = scores.join(weights, "attribute").groupBy("example", "gt", "class").agg(F.sum(F.col("s") * F.col("w")).alias("score"))
    if costs is not None:
        summed = summed.join(costs.withColumnRenamed("pred", "class"), ["gt", "class"], "left").withColumn("score", F.col("score") + F.coalesce("cost", F.lit(0.0)))
    best = F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("class")).alias("minus")))
    return summed.groupBy("example", "gt").agg(best.alias("b")).select("example", "gt", (-F.col("b.minus")).alias("class"), F.col("b.score").alias("score"))


def hard_negatives(scores: DataFrame, most: int, margin: float = -1.0) -> DataFrame:
    """Negatives (example, sample, score) above the margin, the ``most`` highest of each example."""
    order = Window.partitionBy("example").orderBy(F.col("score").desc(), "sample")
    return scores.where(F.col("score") > margin).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def drawn_places(spark: SparkSession, offsets: DataFrame, root: int, draws: int, width: float, height: float, pad: float, seed: int = 0) -> DataFrame:
    """(draw, part, x, y): places of a tree of parts, drawn without looking at an image.

    The root lies anywhere within ``pad`` of the border; each child at its
    parent's place plus its mean offset plus a Gaussian of its spread.
    ``offsets``: parent, child, dx, dy, spread.  Random numbers come by md5 from
    the draw and the part (Box-Muller), so that the tree, level by level, is
    joined only with itself.
    """
    lucky = lambda mark: unit_of("draw", "part", mark, seed=seed)
    # one column for each random number, which holds its name
    marked = lambda df: df.withColumns({m: F.lit(m) for m in ("x", "y", "u", "v")})
    first = marked(spark.range(draws).select(F.col("id").cast("int").alias("draw"), F.lit(root).alias("part")))
    level = materialize(first.select("draw", "part", (pad + (width - 2 * pad) * lucky("x")).alias("x"), (pad + (height - 2 * pad) * lucky("y")).alias("y")), "level")
    out = level
    while True:
        step = level.withColumnRenamed("part", "above").join(offsets, F.col("above") == offsets["parent"])
        step = marked(step.select("draw", F.col("child").cast("int").alias("part"), F.col("x").alias("px"), F.col("y").alias("py"), "dx", "dy", "spread"))
        length, turn = F.col("spread") * F.sqrt(-2 * F.ln(lucky("u"))), 2 * F.pi() * lucky("v")
        level = step.select("draw", "part", (F.col("px") + F.col("dx") + length * F.cos(turn)).alias("x"), (F.col("py") + F.col("dy") + length * F.sin(turn)).alias("y"))
        level = materialize(level, "level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def part_losses(predicted: DataFrame, truth: DataFrame, kind: str, radius: float = 5.0, most: float = 5.0) -> DataFrame:
    """(object, loss) of predicted parts (object, part, x, y, w, h, visible) against true ones, by the name of a detection loss.

    ``intersection_parts``: one less the mean overlap of the parts' boxes;
    ``intersection_object``: one less the overlap of the boxes around all
    visible parts; ``num_click_std_dev``: the mean distance in units of
    ``radius``, ``most`` at most; ``num_parts_incorrect``: the share of parts
    farther than ``radius``; ``detection``: 1 if the object's boxes overlap by
    less than a half, else 0.  A part that only one side sees counts as wholly
    wrong, one that neither sees as right.
    """
    t = truth.select("object", "part", *[F.col(c).alias(f"t{c}") for c in ("x", "y", "w", "h", "visible")])
    met = predicted.join(t, ["object", "part"])
    both, neither = (F.col("visible") == 1) & (F.col("tvisible") == 1), (F.col("visible") != 1) & (F.col("tvisible") != 1)
    box = lambda p: tuple(F.col(f"{p}{c}") for c in ("x", "y", "w", "h"))
    far = F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2))
    each = {
        "intersection_parts": 1 - iou(box(""), box("t")),
        "num_click_std_dev": F.least(far / radius, F.lit(float(most))),
        "num_parts_incorrect": (far > radius).cast("double"),
    }
    if kind in each:
        worst = float(most) if kind == "num_click_std_dev" else 1.0
        return met.groupBy("object").agg(F.avg(F.when(both, each[kind]).when(neither, 0.0).otherwise(worst)).alias("loss"))
    if kind not in ("intersection_object", "detection"):
        raise ValueError(f"no detection loss {kind}")
    edge = lambda f, p, c, size=None: f(F.when(F.col(f"{p}visible") == 1, F.col(f"{p}{c}") + (F.col(f"{p}{size}") if size else 0)))
    around = met.groupBy("object").agg(*[edge(F.min, p, c).alias(f"{p}{c}0") for p in ("", "t") for c in "xy"], *[edge(F.max, p, c, s).alias(f"{p}{c}1") for p in ("", "t") for c, s in (("x", "w"), ("y", "h"))])
    whole = lambda p: (F.col(f"{p}x0"), F.col(f"{p}y0"), F.col(f"{p}x1") - F.col(f"{p}x0"), F.col(f"{p}y1") - F.col(f"{p}y0"))
    overlap = F.when(F.col("x0").isNull() & F.col("tx0").isNull(), 1.0).otherwise(F.coalesce(iou(whole(""), whole("t")), F.lit(0.0)))
    return around.select("object", (1 - overlap if kind == "intersection_object" else (overlap < 0.5).cast("double")).alias("loss"))
