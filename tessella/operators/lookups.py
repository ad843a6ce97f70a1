"""Links by name, questions of attributes, answers out of recorded responses, clicks against truth, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolved(links: DataFrame, entities: DataFrame, name: str = "name") -> DataFrame:
    """``links`` with the id of the entity (id, name; names are unique) that column ``name`` names: -1 if there is none, null without a name."""
    known = entities.select(F.col("name").alias("of_name"), F.col("id").alias("found_id"))
    joined = links.join(known, links[name] == known["of_name"], "left").drop("of_name")
    return joined.withColumn("id", F.when(F.col(name).isNull(), F.lit(None)).otherwise(F.coalesce("found_id", F.lit(-1)))).drop("found_id")


def unresolved(resolved_links: DataFrame) -> DataFrame:
    """Links that name nothing that is there."""
    return resolved_links.where("id = -1")


def property_questions(attributes: DataFrame, properties: DataFrame, separator: str = "::") -> DataFrame:
    """(question, kind, part, attribute, position) of attributes (attribute, name 'property::value') by their properties (property, kind, part).

    A property is a question of all its attributes, in order of their ids;
    attributes of other properties are in none.
    """
    named = attributes.withColumn("question", F.substring_index("name", separator, 1))
    known = properties.withColumnRenamed("property", "of_property")
    joined = named.join(known, named["question"] == known["of_property"])
    place = F.row_number().over(Window.partitionBy("question").orderBy("attribute")) - 1
    return joined.select("question", "kind", "part", "attribute", place.alias("position"))


def chosen_answers(responses: DataFrame, choices: DataFrame) -> DataFrame:
    """(example, question, answer, certainty, seconds): what recorded yes-no responses say to multiple choice.

    ``responses``: example, attribute, answer, certainty, seconds of one user;
    ``choices``: question, attribute, position.  The last choice that was said
    to be there is the answer, by its attribute; without any the first choice
    with its own answer and certainty 0.
    """
    met = responses.join(choices, "attribute")
    row = F.struct("position", "attribute", "answer", "certainty", "seconds")
    both = met.groupBy("example", "question").agg(F.max(F.when(F.col("answer") == 1, row)).alias("last"), F.min(row).alias("first"))
    said = F.col("last").isNotNull()
    return both.select(
        "example", "question",
        F.when(said, F.col("last.attribute")).otherwise(F.col("first.answer")).alias("answer"),
        F.when(said, F.col("last.certainty")).otherwise(0).alias("certainty"),
        F.when(said, F.col("last.seconds")).otherwise(F.col("first.seconds")).alias("seconds"),
    )


def batch_told(responses: DataFrame, batches: DataFrame) -> DataFrame:
    """(example, question, told): the answers to all members of a batch (question, attribute, position) in order; members without an answer are left out."""
    row = F.struct("position", "attribute", "answer", "certainty", "seconds")
    return responses.join(batches, "attribute").groupBy("example", "question").agg(F.sort_array(F.collect_list(row)).alias("told"))


def first_user(rows: DataFrame, user: str = "user") -> DataFrame:
    """The rows of the first user of each example: only those count as answers of a test example."""
    first = rows.groupBy(F.col("example").alias("of_example")).agg(F.min(user).alias("first_user"))
    return rows.join(first, (rows["example"] == first["of_example"]) & (rows[user] == first["first_user"])).drop("of_example", "first_user")


def click_errors(clicks: DataFrame, truth: DataFrame) -> DataFrame:
    """Each user's click (object, part, user, x, y) beside the true place (object, part, x, y, visible): dx, dy and distance, null where the part is not seen."""
    known = truth.select(F.col("object").alias("o"), F.col("part").alias("p"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("visible").alias("seen"))
    met = clicks.join(known, (clicks["object"] == known["o"]) & (clicks["part"] == known["p"]))
    dx, dy = (F.when(F.col("seen") == 1, F.col(c) - F.col(t)) for c, t in (("x", "tx"), ("y", "ty")))
    return met.select("object", "part", "user", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("distance"))


def user_losses(shown: DataFrame, losses: DataFrame) -> DataFrame:
    """(user, place, image, loss): each user's images (user, image, at) in the order in which they were shown, with their losses (user, image, loss)."""
    known = losses.withColumnsRenamed({"user": "of_user", "image": "of_image"})
    place = F.row_number().over(Window.partitionBy("user").orderBy("at", "image")) - 1
    joined = shown.withColumn("place", place).join(known, (F.col("user") == F.col("of_user")) & (F.col("image") == F.col("of_image")), "left")
    return joined.select("user", "place", "image", "loss")


def linked_nodes(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (source, target, value) with the names and groups of both their nodes (id, name, group); links of unknown nodes are left out."""
    side = lambda s: nodes.select(F.col("id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name"), F.col("group").alias(f"{s}_group"))
    a, b = side("source"), side("target")
    return links.join(a, links["source"] == a["source_id"]).join(b, links["target"] == b["target_id"]).drop("source_id", "target_id")


def offset_bounds(offsets: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean_x, mean_y, most_x, most_y): the number of offsets (dx, dy), their means, and how far any lies from those.

    The greatest distance from a mean is that of the least or of the greatest
    value, so that one pass is enough.
    """
    out = offsets.groupBy(*by).agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("dx", "dy") for k, f in (("mean", F.avg), ("low", F.min), ("high", F.max))])
    most = lambda c: F.greatest(F.col(f"mean_{c}") - F.col(f"low_{c}"), F.col(f"high_{c}") - F.col(f"mean_{c}"))
    return out.select(*by, "n", F.col("mean_dx").alias("mean_x"), F.col("mean_dy").alias("mean_y"), most("dx").alias("most_x"), most("dy").alias("most_y"))


def summary(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(kind, name, n): how many rows of each table have each value of a column."""
    out = None
    for kind, (df, column) in tables.items():
        part = df.groupBy(F.col(column).cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
        out = part if out is None else out.unionByName(part)
    return out


def nearest_images(poses: DataFrame, wanted: DataFrame) -> DataFrame:
    """(session, class, image, distance): for each class that is shown the image whose places lie nearest to the session's.

    ``poses``: class, image, part, x, y; ``wanted``: session, class, part, x, y
    (the places of the session's image, for the classes that it returns).  Parts
    that either lacks do not count; ties go to the smaller image.
    """
    known = wanted.select("session", F.col("class").alias("of_class"), F.col("part").alias("of_part"), F.col("x").alias("wx"), F.col("y").alias("wy"))
    met = poses.join(known, (poses["class"] == known["of_class"]) & (poses["part"] == known["of_part"]))
    far = F.avg(F.pow(F.col("x") - F.col("wx"), 2) + F.pow(F.col("y") - F.col("wy"), 2))
    each = met.groupBy("session", "class", "image").agg(F.round(far, 9).alias("distance"))
    return each.groupBy("session", "class").agg(F.min(F.struct("distance", "image")).alias("best")).select("session", "class", "best.image", "best.distance")
