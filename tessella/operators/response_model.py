"""How users of each class answer attributes: smoothed tables, medians, spatial moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialize

BETA_CLASS = 10.0
BETA_CERTAINTY = (32.0, 16.0, 8.0, 4.0)
TINY = 1e-7


def certainty_weights(betas: tuple[float, ...] = BETA_CERTAINTY, not_visible: int | None = None) -> list[float]:
    """1 / (beta + 1/2) over the largest; 0 for the certainty that says an attribute can't be seen."""
    raw = [0.0 if k == not_visible else 1.0 / (b + 0.5) for k, b in enumerate(betas)]
    return [w / max(raw) for w in raw]


def _picked(values: list[float], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), index + 1)


def answer_counts(responses: DataFrame) -> DataFrame:
    """n and positive answers by class, attribute and certainty: all that the model needs of the rows, in one shuffle."""
    return responses.groupBy("class", "attribute", "certainty").agg(F.count("*").alias("n"), F.sum("answer").alias("n1"))


def response_model(
    responses: DataFrame, beta_class: float = BETA_CLASS, betas: tuple[float, ...] = BETA_CERTAINTY, not_visible: int | None = None
) -> DataFrame:
    """(class, attribute, certainty, weight, pos, neg, p): smoothed answer probabilities of every combination.

    ``responses``: example, class, attribute, answer 0/1, certainty.  Combinations
    that nobody gave count as zeros.  The rows are read once; the number of answer sets is
    that of answers to the first attribute.  pos and neg are by certainty; p, which
    sessions use, is over all certainties, weighted.
    """
    counts = materialize(answer_counts(responses), "answers")
    first = counts.agg(F.min("attribute").alias("attribute"))
    sets = counts.join(F.broadcast(first), "attribute").agg(F.sum("n").alias("sets"))
    dims = counts.select("class").distinct().crossJoin(counts.select("attribute").distinct())
    dims = dims.withColumn("certainty", F.explode(F.sequence(F.lit(0), F.lit(len(betas) - 1))))
    dense = dims.join(counts, ["class", "attribute", "certainty"], "left").fillna(0, ["n", "n1"]).crossJoin(F.broadcast(sets))
    weight = _picked(certainty_weights(betas, not_visible), F.col("certainty"))
    beta = _picked(list(betas), F.col("certainty"))
    by_pair, by_attribute, by_answer = (Window.partitionBy(*c) for c in (("class", "attribute"), ("attribute",), ("attribute", "certainty")))
    dense = dense.withColumns(
        {
            "weight": weight,
            "beta": beta,
            "glob1": F.sum("n1").over(by_answer) / F.col("sets"),
            "glob0": F.sum(F.col("n") - F.col("n1")).over(by_answer) / F.col("sets"),
        }
    ).withColumns(
        {
            "nac": F.sum(F.col("weight") * F.col("n")).over(by_pair),
            "pac": F.sum(F.col("weight") * F.col("n1")).over(by_pair) / (F.sum(F.col("weight") * F.col("n")).over(by_pair) + TINY),
            "na": F.sum(F.col("weight") * F.col("n")).over(by_attribute),
            "pa": F.sum(F.col("weight") * F.col("n1")).over(by_attribute) / F.sum(F.col("weight") * F.col("n")).over(by_attribute),
        }
    )
    m1 = F.least(F.lit(beta_class), F.col("nac"))
    m2 = F.least(F.col("beta"), F.col("sets").cast("double"))
    total = m1 + m2 + F.col("n") + TINY
    m = F.least(F.lit(beta_class), F.col("na"))
    return dense.select(
        "class",
        "attribute",
        "certainty",
        "weight",
        ((F.col("pac") * m1 + F.col("glob1") * m2 + F.col("n1")) / total).alias("pos"),
        (((1 - F.col("pac")) * m1 + F.col("glob0") * m2 + F.col("n") - F.col("n1")) / total).alias("neg"),
        ((F.col("pac") * F.col("nac") + m * F.col("pa")) / (F.col("nac") + m + TINY)).alias("p"),
    )


def upper_median(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The element n div 2 (from 0) of the sorted values of each group.

    A quantile sketch with map-side combining brackets the median between its
    49th and 51st hundredths, wide of the sketch's error of a thousandth; rows
    below are counted, and only those within the bracket are ranked, so that no
    task sorts a whole group.  Nulls don't count.
    """
    named = {c: f"of_{c}" for c in by}
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    sketch = rows.groupBy(*[F.col(c).alias(n) for c, n in named.items()]).agg(
        F.count("*").alias("of"), F.percentile_approx("v", F.array(F.lit(0.49), F.lit(0.51)), F.lit(1000)).alias("bracket")
    )
    same = F.lit(True)
    for c, n in named.items():
        same = same & rows[c].eqNullSafe(sketch[n])
    placed = rows.join(sketch, same)
    low, high = F.col("bracket")[0], F.col("bracket")[1]
    below = placed.groupBy(*named.values()).agg(F.count_if(F.col("v") < low).alias("below")).select(*[F.col(n).alias(f"{n}_") for n in named.values()], "below")
    order = Window.partitionBy(*named.values()).orderBy("v")
    inside = placed.where((F.col("v") >= low) & (F.col("v") <= high)).withColumn("place", F.row_number().over(order))
    match = F.lit(True)
    for n in named.values():
        match = match & F.col(n).eqNullSafe(F.col(f"{n}_"))
    found = inside.join(below, match).where(F.col("place") + F.col("below") == F.floor(F.col("of") / 2) + 1)
    return found.select(*by, F.col("v").alias("median"))


def parent_child(parts: DataFrame, parents: DataFrame) -> DataFrame:
    """Each visible part of an object beside its visible parent: offsets from the parent.

    ``parts``: object, part, x, y, visible; ``parents``: part, parent.
    """
    child = parts.where("visible = 1").join(parents, "part")
    above = parts.where("visible = 1").select(F.col("object"), F.col("part").alias("parent"), F.col("x").alias("parent_x"), F.col("y").alias("parent_y"))
    return child.join(above, ["object", "parent"]).withColumns({"dx": F.col("x") - F.col("parent_x"), "dy": F.col("y") - F.col("parent_y")})


def spatial_moments(pairs: DataFrame, *by: str, min_examples: int = 1, most: float = 10.0) -> DataFrame:
    """Count, mean and variance of offsets by group, the springs' weights min(most, 1 / (2 var)), and the largest departure."""
    mean = [F.avg(c).over(Window.partitionBy(*by)) for c in ("dx", "dy")]
    spread = pairs.withColumns({"gap_x": F.abs(F.col("dx") - mean[0]), "gap_y": F.abs(F.col("dy") - mean[1])})
    spring = lambda v: F.when(F.col(v) > 0, F.least(F.lit(most), 1 / (2 * F.col(v)))).otherwise(F.lit(most))
    out = spread.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("dx").alias("mean_x"), F.avg("dy").alias("mean_y"), F.var_pop("dx").alias("var_x"), F.var_pop("dy").alias("var_y"),
        F.max("gap_x").alias("gap_x"), F.max("gap_y").alias("gap_y"),
    )
    return out.where(F.col("n") >= min_examples).withColumns({"weight_x": spring("var_x"), "weight_y": spring("var_y")})


def pseudo_parts(parts: DataFrame, groups: DataFrame) -> DataFrame:
    """Parts made of others: the mean place and time of the visible members; not visible without any.

    ``groups``: part, pseudo.
    """
    seen = F.col("visible") == 1
    return parts.join(groups, "part").groupBy("object", "pseudo").agg(
        F.avg(F.when(seen, F.col("x"))).alias("x"), F.avg(F.when(seen, F.col("y"))).alias("y"), F.avg(F.when(seen, F.col("seconds"))).alias("seconds"), F.max("visible").alias("visible")
    )


def without_unseen_pseudo(objects: DataFrame) -> DataFrame:
    """Objects all of whose pseudo parts have a visible member."""
    bad = objects.groupBy("object").agg(F.min("visible").alias("all_seen")).where("all_seen = 0").select("object")
    return objects.join(bad, "object", "left_anti")
