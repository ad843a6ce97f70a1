"""Stand-ins for annotation data, on the supplied tables: as DataFrames and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import table

ATTRIBUTES = 24

SQL = {
    "responses": f"""SELECT vec_id AS example, label AS class, j AS attribute, (embedding[j + 1] > 0)::INT AS answer,
        least(3, floor(abs(embedding[j + 1]::DOUBLE) / 0.1::DOUBLE))::INT AS certainty, 1 + 10 * abs(embedding[j + 1]::DOUBLE) AS seconds
        FROM embeddings, (SELECT unnest(range({ATTRIBUTES}))::INT AS j)""",
    "parts": """SELECT l_orderkey AS object, l_linenumber AS part, avg(l_extendedprice % 640) AS x, avg((l_partkey % 480)::DOUBLE) AS y,
        max((l_discount > 0.02::DOUBLE)::INT) AS visible, avg(l_quantity) AS seconds FROM lineitem GROUP BY 1, 2""",
    "boxes": """SELECT l_orderkey AS object, l_linenumber AS part, max(l_extendedprice % 640) AS x, max((l_partkey % 480)::DOUBLE) AS y,
        max(l_quantity * 4) AS w, max(20 + l_tax * 1000) AS h, max(l_discount) AS score FROM lineitem GROUP BY 1, 2""",
    "prices": "SELECT l_suppkey AS grp, l_returnflag AS item, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2",
    "grid": """SELECT (l_partkey % 40)::INT AS y, floor(l_extendedprice % 40)::INT AS x, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2""",
    "log": """SELECT event_id, user_id, epoch_us(ts) // 1000 AS at_ms, event_type AS kind, json_extract_string(props, '$.k') AS question, value FROM events""",
    "centroids": """SELECT label AS class, j, avg(embedding[j + 1]::DOUBLE) AS w FROM embeddings, (SELECT unnest(range(64))::INT AS j) GROUP BY 1, 2""",
}


def cte(*names: str) -> str:
    """The named views as the head of a WITH clause."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every example answers each attribute: example, class, attribute, answer, certainty, seconds."""
    t = table(spark, sf_dir, "embeddings")
    x = F.col("x").cast("double")
    flat = t.select(F.col("vec_id").alias("example"), F.col("label").alias("class"), F.posexplode(F.slice("embedding", 1, ATTRIBUTES)).alias("attribute", "x"))
    certainty = F.least(F.lit(3), F.floor(F.abs(x) / F.lit(0.1)).cast("int"))
    return flat.select("example", "class", "attribute", (x > 0).cast("int").alias("answer"), certainty.alias("certainty"), (1 + 10 * F.abs(x)).alias("seconds"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of objects: object, part, x, y, visible, seconds."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_orderkey").alias("object"), F.col("l_linenumber").alias("part")).agg(
        F.avg(F.col("l_extendedprice") % 640).alias("x"),
        F.avg((F.col("l_partkey") % 480).cast("double")).alias("y"),
        F.max((F.col("l_discount") > 0.02).cast("int")).alias("visible"),
        F.avg("l_quantity").alias("seconds"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored boxes of objects: object, part, x, y, w, h, score."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_orderkey").alias("object"), F.col("l_linenumber").alias("part")).agg(
        F.max(F.col("l_extendedprice") % 640).alias("x"),
        F.max((F.col("l_partkey") % 480).cast("double")).alias("y"),
        F.max(F.col("l_quantity") * 4).alias("w"),
        F.max(20 + F.col("l_tax") * 1000).alias("h"),
        F.max("l_discount").alias("score"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of items in groups: grp, item, weight."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_suppkey").alias("grp"), F.col("l_returnflag").alias("item")).agg(F.sum("l_quantity").alias("weight"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score map: y, x, score."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy((F.col("l_partkey") % 40).cast("int").alias("y"), F.floor(F.col("l_extendedprice") % 40).cast("int").alias("x")).agg(F.sum("l_quantity").alias("score"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interface events: event_id, user_id, at (ms), kind, question, value."""
    t = table(spark, sf_dir, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.select("event_id", "user_id", at.alias("at"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("question"), "value")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors of the classes, one row a component: class, j, w."""
    t = table(spark, sf_dir, "embeddings")
    flat = t.select(F.col("label").alias("class"), F.posexplode("embedding").alias("j", "x"))
    return flat.groupBy("class", "j").agg(F.avg(F.col("x").cast("double")).alias("w"))
