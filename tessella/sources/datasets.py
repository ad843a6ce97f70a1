"""Annotated datasets, predictions and model definitions as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.lookups import resolved

LOCATION = (
    "struct<part:string,pose:string,x:float,y:float,scale:float,rotation:float,visible:boolean,flipHorizontal:boolean,flipVertical:boolean,responseTime:float,score:float>"
)
USER = f"struct<part_locations:array<{LOCATION}>,attribute_responses:array<string>>"
OBJECT = f"struct<part_locations:array<{LOCATION}>,class:string,isValid:boolean,bounding_box:struct<x:int,y:int,width:int,height:int>,users:array<{USER}>>"
LABEL = f"struct<objects:array<{OBJECT}>,part_locations:array<{LOCATION}>,class:string,bounding_box:struct<x:int,y:int,width:int,height:int>,users:array<{USER}>>"
DATA = "struct<imagename:string,width:int,height:int,image_scale:float,segmentation:string>"
EXAMPLE = f"x {DATA}, y {LABEL}, y_latent {LABEL}"


def read_examples(spark: SparkSession, path: str, schema: str = EXAMPLE) -> DataFrame:
    """JSON lines with an explicit schema; a line that does not parse fails the read, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def with_defaults(examples: DataFrame) -> DataFrame:
    """Absent sizes are -1, the scale is 1; a label without a list of objects becomes a list of itself."""
    x = F.col("x")
    whole = x.withField("width", F.coalesce(x["width"], F.lit(-1))).withField("height", F.coalesce(x["height"], F.lit(-1)))
    whole = whole.withField("image_scale", F.coalesce(x["image_scale"], F.lit(1.0).cast("float")))
    y = F.col("y")
    single = F.array(
        F.struct(y["part_locations"].alias("part_locations"), y["class"].alias("class"), F.lit(True).alias("isValid"), y["bounding_box"].alias("bounding_box"), y["users"].alias("users"))
    )
    return examples.withColumn("x", whole).withColumn("y", y.withField("objects", F.coalesce(y["objects"], single)))


def write_examples(examples: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; with ``append`` only these rows are added."""
    examples.select("x", "y", *(["y_latent"] if "y_latent" in examples.columns else [])).write.mode("append" if append else "overwrite").json(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """{predicted: {y, score}, ground_truth: {y, score}, loss} a line, in order of ``example``.

    ``predictions``: example, pred, score, gt, gt_score, loss.
    """
    line = F.to_json(
        F.struct(
            F.struct(F.col("pred").alias("y"), "score").alias("predicted"), F.struct(F.col("gt").alias("y"), F.col("gt_score").alias("score")).alias("ground_truth"), "loss"
        )
    )
    predictions.orderBy("example").select(line.alias("value")).write.mode("overwrite").text(path)


ENTITIES = {
    "classes": "name string, id int, wikipedia string, meta map<string,string>, exemplars array<string>, weights array<double>, attributesWeights array<double>",
    "attributes": "name string, id int, value_name string, property_name string, part string, gamma double, visualization string, weights array<double>",
    "parts": "name string, id int, parent string, poses array<string>, isClick boolean, color string, abbreviation string, visualization string",
    "poses": "name string, id int, visualization string, isNotVisible boolean, weights array<double>",
    "clickParts": "name string, id int, parent string, poses array<string>, isClick boolean",
    "clickPoses": "name string, id int, visualization string, isNotVisible boolean, weights array<double>",
    "spatialTransitions": "parent string, parentPose string, child string, childPoses array<string>, weights array<double>, offsets array<double>, numTrainExamples array<int>",
    "certainties": "name string, weight double",
    "questions": "id int, type string, expectedTimeSeconds double, text string, visualization string, attribute string, attributes array<string>, questions array<int>, part string, numSamples int",
    "features": "name string, type string, width int, height int, numBlocksX int, numBlocksY int, numBins int, cellWidth int, normEps double, normMax double, normalize boolean",
    "featureWindows": "name string, w int, h int, dx int, dy int, dim int, scale double, orientation double, poseInd int",
    "codebooks": "name string, fileName string, numWords int, dims int, treeDepth int",
    "fisherCodebooks": "name string, fileName string, numWords int, dims int, pcaDims int",
}
SETTINGS = {
    "gammaClass": 1.0, "gammaClick": 1.0, "imageScale": 1.0, "numScales": 1.0, "numOrientations": 1.0, "spatialGranularity": 1.0, "scaleOffset": 0.0,
}
#: What a feature has where the file is silent.
FEATURE_DEFAULTS = {"numBlocksX": 1, "numBlocksY": 1, "numBins": 9, "cellWidth": 8, "normEps": 1e-4, "normMax": 0.2, "normalize": True}
#: The links between entities by name: (table, column, table that holds the name).
LINKS = (
    ("attributes", "part", "parts"), ("parts", "parent", "parts"), ("clickParts", "parent", "parts"), ("spatialTransitions", "parent", "parts"), ("spatialTransitions", "child", "parts"),
    ("spatialTransitions", "parentPose", "poses"), ("questions", "attribute", "attributes"), ("questions", "part", "parts"),
)


def read_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A model definition, one JSON document, as a table for each kind of entity, with settings and their defaults.

    Entities keep their order in ``place``, which also is their id where they
    have none; questions take 500 samples, features their defaults.
    """
    fields = ",".join(f"{n}:array<struct<{_typed(s)}>>" for n, s in ENTITIES.items())
    settings = ",".join(f"{n}:double" for n in SETTINGS)
    whole = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(f"{_columns(fields)}, {_columns(settings)}").json(path)
    out = {n: whole.select(F.posexplode(F.coalesce(F.col(n), F.array())).alias("place", "e")).select("place", "e.*") for n in ENTITIES}
    out = {n: df.withColumn("id", F.coalesce("id", "place")) if "id" in df.columns else df for n, df in out.items()}
    out["questions"] = out["questions"].withColumn("numSamples", F.coalesce("numSamples", F.lit(500)))
    out["features"] = out["features"].withColumns({n: F.coalesce(n, F.lit(v)) for n, v in FEATURE_DEFAULTS.items()})
    out["settings"] = whole.select(*[F.coalesce(n, F.lit(v)).alias(n) for n, v in SETTINGS.items()])
    return out


def linked_model(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with an id beside each name of another entity (<column>_id): -1 where the name is unknown, null where there is none."""
    out = dict(tables)
    for name, column, target in LINKS:
        linked = resolved(out[name].withColumnRenamed("id", "own_id") if "id" in out[name].columns else out[name], tables[target].select("name", "id"), column)
        linked = linked.withColumnRenamed("id", f"{column}_id")
        out[name] = linked.withColumnRenamed("own_id", "id") if "own_id" in linked.columns else linked
    return out


def model_document(tables: dict[str, DataFrame]) -> DataFrame:
    """(value): the model as one JSON document that ``read_model`` reads back, entities in their order."""
    parts = None
    for name in ENTITIES:
        columns = [c.split(" ", 1)[0] for c in ENTITIES[name].split(", ")]
        rows = F.array_sort(F.collect_list(F.struct("place", F.struct(*columns).alias("e"))), lambda a, b: F.signum(a["place"] - b["place"]).cast("int"))
        row = tables[name].agg(rows.alias("rows")).select(F.transform("rows", lambda r: r["e"]).alias(name))
        parts = row if parts is None else parts.crossJoin(row)
    whole = parts.crossJoin(tables["settings"])
    return whole.select(F.to_json(F.struct(*ENTITIES, *SETTINGS)).alias("value"))


def write_model_document(tables: dict[str, DataFrame], path: str) -> None:
    model_document(tables).coalesce(1).write.mode("overwrite").text(path)


def _typed(schema: str) -> str:
    """'name type, ..' as 'name:type,..'."""
    return ",".join(":".join(part.split(" ", 1)) for part in schema.split(", "))


def _columns(fields: str) -> str:
    """'name:type,..' at the outer level as 'name type, ..'."""
    out, depth, word = [], 0, ""
    for c in fields + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = word.split(":", 1)
            out.append(f"{name} {kind}")
            word = ""
        else:
            word += c
    return ", ".join(out)


def write_model(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet, under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def confusion_document(confusion: DataFrame, path: str) -> None:
    confusion.select(F.col("json").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file's whole text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, number, line) of ``read_text_files``; a last line break ends the last line."""
    lines = F.split(F.regexp_replace("value", "\n$", ""), "\n")
    return files.select("path", F.posexplode(lines).alias("number", "line"))


def gallery(images: DataFrame, order: list, title: str) -> DataFrame:
    """(value): an HTML page of images (image, caption, thumb) in an order, one row.

    Text is escaped; a missing thumb is the image itself.
    """
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    cell = F.concat(F.lit('<a href="'), safe("image"), F.lit('"><img src="'), F.when(F.col("thumb").isNull(), safe("image")).otherwise(safe("thumb")), F.lit('"></a><br>'), safe("caption"))
    rows = images.select(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("k"), cell.alias("cell"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "cell"))), lambda r: F.concat(F.lit("<td>"), r["cell"], F.lit("</td>"))), "\n")
    return rows.agg(F.concat(F.lit(f"<html><h1>{title}</h1><table><tr>"), body, F.lit("</tr></table></html>")).alias("value"))


def cropped(examples: DataFrame, old: str, new: str) -> DataFrame:
    """Examples (x, y) cut to the box of their first object: its size as theirs, its places moved, and ``old`` in the image's path as ``new``.

    An example without a box stays whole, but for its path.
    """
    box = F.get(F.col("y.objects"), F.lit(0))["bounding_box"]
    has = box.isNotNull()
    shifted = lambda p: p.withField("x", p["x"] - F.coalesce(box["x"], F.lit(0))).withField("y", p["y"] - F.coalesce(box["y"], F.lit(0)))
    moved = F.transform("y.objects", lambda o: o.withField("part_locations", F.transform(o["part_locations"], shifted)).withField(
        "bounding_box", F.when(o["bounding_box"].isNotNull(), o["bounding_box"].withField("x", o["bounding_box"]["x"] - F.coalesce(box["x"], F.lit(0))).withField("y", o["bounding_box"]["y"] - F.coalesce(box["y"], F.lit(0))))))
    x = F.col("x").withField("imagename", F.replace(F.col("x.imagename"), F.lit(old), F.lit(new)))
    x = x.withField("width", F.when(has, box["width"]).otherwise(F.col("x.width"))).withField("height", F.when(has, box["height"]).otherwise(F.col("x.height")))
    return examples.withColumn("cut_y", F.col("y").withField("objects", moved)).withColumn("x", x).withColumn("y", F.col("cut_y")).drop("cut_y")


def write_codebook(spark: SparkSession, arrays: dict[str, object], path: str) -> None:
    """Named arrays of a codebook (words, tree planes, projection, mixture) as Parquet."""
    import numpy as np

    rows = [(name, list(np.shape(a)), np.asarray(a, float).ravel().tolist()) for name, a in sorted(arrays.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, cells array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read_codebook(spark: SparkSession, path: str) -> dict:
    import numpy as np

    return {r.name: np.array(r.cells).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
