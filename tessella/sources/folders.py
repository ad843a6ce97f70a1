"""Folders of images, text tables of a dataset, session logs, study files and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.ordering import exact_split
from tessella.operators.sessions import latest_version


def listing(spark: SparkSession, folder: str, match: str = "*") -> DataFrame:
    """(path, name, length) of files whose name contains any of the strings in ``match``, which bars separate; * is all."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.substring_index("path", "/", -1).alias("name"))
    if match == "*":
        return files
    found = F.lit(False)
    for word in match.split("|"):
        found = found | F.contains("name", F.lit(word))
    return files.where(found)


def class_folders(spark: SparkSession, folder: str, match: str = ".jpg|.png", excluded: list[str] = (), train_each: int = 0) -> DataFrame:
    """(path, name, class, split): files in a folder for each class, less those whose folder and name are excluded.

    ``train_each`` random files of each class are split 0, the rest 1; the choice repeats.
    """
    files = listing(spark, folder, match).withColumn("class", F.element_at(F.split("path", "/"), -2))
    if excluded:
        out = spark.createDataFrame([(e,) for e in excluded], "key string")
        files = files.join(out, F.concat_ws("/", "class", "name") == F.col("key"), "left_anti")
    return exact_split(files.select("path", "name", "class"), ["class", "name"], train_each, ["class"])


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(origin, width, height, channels, data): images as Spark decodes them."""
    return spark.read.format("image").option("dropInvalid", True).load(folder).select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


BIRD_TABLES = {
    "classes": ("classes.txt", "class_id int, class string"),
    "parts": ("parts/parts.txt", "part_id int, part string"),
    "attributes": ("attributes/attributes.txt", "attribute_id int, attribute string"),
    "certainties": ("attributes/certainties.txt", "certainty_id int, certainty string"),
    "images": ("images.txt", "image_id int, path string"),
    "boxes": ("bounding_boxes.txt", "image_id int, x double, y double, width double, height double"),
    "labels": ("image_class_labels.txt", "image_id int, class_id int"),
    "split": ("train_test_split.txt", "image_id int, is_train int"),
    "locations": ("parts/part_locs.txt", "image_id int, part_id int, x double, y double, visible int"),
    "clicks": ("parts/part_click_locs.txt", "image_id int, part_id int, x double, y double, visible int, seconds double"),
    "responses": ("attributes/image_attribute_labels.txt", "image_id int, attribute_id int, present int, certainty_id int, seconds double"),
}


def bird_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The space-separated tables of a dataset of birds.  Names of several words, as of certainties, are joined again."""
    out = {}
    for name, (file, schema) in BIRD_TABLES.items():
        if name in ("certainties", "parts", "classes", "attributes"):
            key, value = (c.split(" ")[0] for c in schema.split(", "))
            text = spark.read.text(f"{folder}/{file}").where(F.length(F.trim("value")) > 0)
            out[name] = text.select(F.regexp_extract("value", r"^\s*(\d+)", 1).cast("int").alias(key), F.regexp_replace("value", r"^\s*\d+\s+", "").alias(value))
        else:
            out[name] = spark.read.schema(schema).option("sep", " ").option("mode", "FAILFAST").csv(f"{folder}/{file}")
    return out


def checked_ids(df: DataFrame, column: str) -> DataFrame:
    """One row (n, low, high, distinct, dense): whether ids run from 1 without gaps or repeats."""
    out = df.agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.countDistinct(column).alias("distinct"))
    return out.withColumn("dense", (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("distinct") == F.col("n")))


def class_attribute_weights(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, attribute_id, w): percentages, a row a class in order of the file, as weights from -1 to 1."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda s: F.length(F.trim(s)) > 0)).alias("row", "line"))
    cells = lines.select((F.col("row") + 1).alias("class_id"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("column", "v"))
    return cells.select("class_id", (F.col("column") + 1).alias("attribute_id"), (F.col("v").cast("double") / 50 - 1).alias("w"))


def bird_examples(tables: dict[str, DataFrame]) -> DataFrame:
    """One row an image: path, class, box, split, and its parts as an array in order of their ids."""
    t = tables
    located = t["locations"].join(t["parts"], "part_id").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("part_id", "part", "x", "y", "visible"))).alias("parts"))
    return t["images"].join(t["boxes"], "image_id").join(t["labels"], "image_id").join(t["split"], "image_id").join(t["classes"], "class_id").join(located, "image_id", "left")


def bird_responses(tables: dict[str, DataFrame]) -> DataFrame:
    """The rows that the response model takes: example, class, attribute, answer, certainty, seconds, all from 0."""
    r = tables["responses"].join(tables["labels"], "image_id")
    return r.select(
        F.col("image_id").alias("example"), (F.col("class_id") - 1).alias("class"), (F.col("attribute_id") - 1).alias("attribute"), F.col("present").alias("answer"),
        (F.col("certainty_id") - 1).alias("certainty"), "seconds",
    )


LOG = (
    "start_session struct<sessionId:string,sessionImgName:string,imageName:string,time:string>, end_session struct<time:string,selection:string>, "
    "questions array<struct<id:string,type:string,time:string,stage:string,answer:string,certainty:string>>, results array<struct<classes:string,time:string>>, "
    "removals array<struct<class:string,time:string>>, detail_views array<struct<class:string,time:string>>"
)


def session_logs(spark: SparkSession, folder: str) -> DataFrame:
    """The last version of each log under <folder>/<user>/<image>/log_<version>.txt: user, image, version, session and its parts."""
    path = F.col("_metadata.file_path")
    raw = spark.read.schema(LOG).option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    named = raw.select(
        "*", F.element_at(F.split(path, "/"), -3).alias("user"), F.element_at(F.split(path, "/"), -2).alias("image"), F.regexp_extract(path, r"log_(\d+)\.txt$", 1).cast("int").alias("version")
    ).where(F.col("version").isNotNull())
    return latest_version(named).withColumn("session", F.concat_ws("/", "user", "image"))


def study_files(spark: SparkSession, folder: str) -> DataFrame:
    """(user, image_no, type, class, file) of lines '<number> <type> <class>/<file>', a file a user."""
    text = spark.read.text(folder).withColumn("user", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1))
    part = lambda k: F.regexp_extract("value", r"^\s*(\d+)\s+(\S+)\s+([^/\s]+)/(\S+)", k)
    return text.select("user", part(1).cast("int").alias("image_no"), part(2).alias("type"), part(3).alias("class"), part(4).alias("file")).where(F.col("image_no").isNotNull())


def study_scores(study: DataFrame, results: DataFrame) -> DataFrame:
    """(user, score): summed losses over control images.  ``results``: user, image_no, loss."""
    return study.join(results, ["user", "image_no"], "left").groupBy("user").agg(F.sum(F.when(F.col("type") == "control", F.coalesce("loss", F.lit(0.0))).otherwise(F.lit(0.0))).alias("score"))


REQUEST = "jsonrpc string, id string, method string, session_id string, question_id int, answer int, response_time double, certainty string, class int, verified boolean, num_classes int"
#: Longer requests are refused.
MOST_BYTES = 1_999_999


def parsed_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """Requests, one JSON text a row, with an error for those that can't be read, are too long or name no method."""
    body = F.col(column)
    parsed = F.from_json(body, REQUEST)
    error = F.when(F.octet_length(body) > MOST_BYTES, "request too long").when(parsed.isNull() | F.get_json_object(body, "$").isNull(), "parse error").when(parsed["method"].isNull(), "no method")
    return lines.select("*", parsed.alias("request"), error.alias("error"))


def responses(replies: DataFrame, result: Column) -> DataFrame:
    """JSON texts of replies with the request's id."""
    return replies.select(F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("request.id").alias("id"), result.alias("result"), "error")).alias("value"))


def ordered_lines(df: DataFrame, order: str, line: Column, path: str) -> None:
    """Text in the order of ``order``, however the rows were made."""
    df.orderBy(order).select(line.alias("value")).write.mode("overwrite").text(path)


def numbered_within(df: DataFrame, by: str, order: str) -> DataFrame:
    return df.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy(order)))
