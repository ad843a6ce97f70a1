"""Queries over score maps as rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import images
from tessella.plans import views
from tessella.plans.game_queries import r6
from tessella.plans.views import cte
from tessella.session import table

TEMPLATE = {(dy, dx): (dy * 3 + dx + 1) / 10 for dy in range(3) for dx in range(3)}
SPOTS = "(SELECT n_nationkey AS place, n_nationkey AS y, (n_regionkey * 9)::INT AS x, n_nationkey % 2 = 1 AS flip, n_nationkey % 5 <> 3 AS visible FROM nation)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    return views.grid(spark, d).withColumnRenamed("score", "value")


def spots(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(n.alias("place"), n.alias("y"), (F.col("n_regionkey") * 9).cast("int").alias("x"), (n % 2 == 1).alias("flip"), (n % 5 != 3).alias("visible"))


def m20(spark, d):
    return images.neighbour_codes(cells(spark, d))


def m20_maps(spark, d):
    t = table(spark, d, "lineitem")
    many = t.groupBy(F.col("l_returnflag").alias("map"), (F.col("l_partkey") % 12).cast("int").alias("y"), (F.col("l_suppkey") % 10).cast("int").alias("x")).agg(F.count("*").cast("double").alias("value"))
    return images.neighbour_codes(many, ["map"]).groupBy("map", "code", "weight").agg(F.count("*").alias("n"))


def m22(spark, d):
    return images.slide(cells(spark, d), TEMPLATE).select("y", "x", r6(F.col("score")).alias("score"))


def r4(spark, d):
    return images.windows_at(cells(spark, d), spots(spark, d), 3, 5)


def s11(spark, d):
    return images.mask_windows(cells(spark, d).withColumn("value", F.floor("value") % 4), spots(spark, d), 3, 3, 2.0)


def s11_any(spark, d):
    return images.mask_windows(cells(spark, d).withColumn("value", F.floor("value") % 2), spots(spark, d), 3, 3)


def r4_words(spark, d):
    words = cells(spark, d).select("y", "x", (F.floor("value") % 8).cast("int").alias("word"))
    n = F.col("n_nationkey")
    windows = table(spark, d, "nation").select(n.alias("window"), (n * 2 - 3).cast("int").alias("y0"), (n % 7 * 5).cast("int").alias("x0"), (4 + n % 3).cast("int").alias("height"), (6 + n % 4).cast("int").alias("width"))
    return images.word_histograms(words, windows).select("window", "word", r6(F.col("value")).alias("value"))


def r5(spark, d):
    return images.pyramid(cells(spark, d), 4).select("level", "y", "x", r6(F.col("value")).alias("value"))


def m23(spark, d):
    flipped = images.mirrored(cells(spark, d), 40)
    return images.blitted(images.bordered(cells(spark, d), 40, 40, 2, 1.0), flipped, 2, 2)


def s10(spark, d):
    return images.resized(cells(spark, d), 40, 25).select("y", "x", r6(F.col("value")).alias("value"))


_SENT = "s(code, dy, dx) AS (VALUES (0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1), (4, 0, -1), (5, 1, -1), (6, 1, 0), (7, 1, 1))"
_CODES = """CASE WHEN count(n.v) = 8 AND sum((n.v > c.v)::INT) = 1 THEN min(CASE WHEN n.v > c.v THEN code END) ELSE 0 END AS code,
    (count(n.v) = 8 AND coalesce(sum((n.v > c.v)::INT), 0) = 1)::INT AS weight"""

QUERIES = {
    "m20_lbp": (m20, cte("grid") + f""", {_SENT}, c AS (SELECT y, x, score AS v FROM grid)
        SELECT c.y, c.x, {_CODES} FROM c CROSS JOIN s LEFT JOIN c n ON n.y = c.y + s.dy AND n.x = c.x + s.dx GROUP BY 1, 2"""),
    "m20_lbp_maps": (m20_maps, f"""WITH {_SENT}, c AS (SELECT l_returnflag AS map, (l_partkey % 12)::INT AS y, (l_suppkey % 10)::INT AS x, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1, 2, 3),
        k AS (SELECT c.map, c.y, c.x, {_CODES} FROM c CROSS JOIN s LEFT JOIN c n ON n.map = c.map AND n.y = c.y + s.dy AND n.x = c.x + s.dx GROUP BY 1, 2, 3)
        SELECT map, code, weight, count(*) AS n FROM k GROUP BY 1, 2, 3"""),
    "m22_sliding_window": (m22, cte("grid") + """ SELECT a.y, a.x, round(sum(b.score * ((b.y - a.y) * 3 + b.x - a.x + 1) / 10), 6) + 0 AS score
        FROM (SELECT y + oy AS y, x + ox AS x FROM (SELECT DISTINCT y, x FROM grid) CROSS JOIN (SELECT unnest(range(-2, 1))::INT AS oy) CROSS JOIN (SELECT unnest(range(-2, 1))::INT AS ox) GROUP BY 1, 2) a
        JOIN grid b ON b.y BETWEEN a.y AND a.y + 2 AND b.x BETWEEN a.x AND a.x + 2 GROUP BY 1, 2 HAVING count(*) = 9"""),
    "r4_gather": (r4, cte("grid") + f""" SELECT place, (CASE WHEN flip THEN r * 5 + 4 - k ELSE r * 5 + k END)::INT AS i, coalesce(score, 0) AS value
        FROM {SPOTS} p CROSS JOIN (SELECT unnest(range(3)) AS r) CROSS JOIN (SELECT unnest(range(5)) AS k) LEFT JOIN grid g ON visible AND g.y = p.y + r - 1 AND g.x = p.x + k - 2"""),
    "s11_mask": (s11, cte("grid") + f""" SELECT place, (CASE WHEN flip THEN r * 3 + 2 - k ELSE r * 3 + k END)::INT AS i, coalesce((floor(score) % 4 = 2)::INT, 0)::DOUBLE AS value
        FROM {SPOTS} p CROSS JOIN (SELECT unnest(range(3)) AS r) CROSS JOIN (SELECT unnest(range(3)) AS k) LEFT JOIN grid g ON visible AND g.y = p.y + r - 1 AND g.x = p.x + k - 1"""),
    "s11_mask_any": (s11_any, cte("grid") + f""" SELECT place, (CASE WHEN flip THEN r * 3 + 2 - k ELSE r * 3 + k END)::INT AS i, coalesce((floor(score) % 2 <> 0)::INT, 0)::DOUBLE AS value
        FROM {SPOTS} p CROSS JOIN (SELECT unnest(range(3)) AS r) CROSS JOIN (SELECT unnest(range(3)) AS k) LEFT JOIN grid g ON visible AND g.y = p.y + r - 1 AND g.x = p.x + k - 1"""),
    "r4_word_histograms": (r4_words, cte("grid") + """, w AS (SELECT n_nationkey AS window, n_nationkey * 2 - 3 AS y0, n_nationkey % 7 * 5 AS x0, 4 + n_nationkey % 3 AS h, 6 + n_nationkey % 4 AS w FROM nation)
        SELECT w.window, (floor(score) % 8)::INT AS word, round(sum(1.0::DOUBLE / (w.h * w.w)), 6) AS value FROM w JOIN grid g ON g.y BETWEEN y0 AND y0 + h - 1 AND g.x BETWEEN x0 AND x0 + w.w - 1 GROUP BY 1, 2"""),
    "s10_resized": (s10, cte("grid") + " SELECT floor(y * 0.625::DOUBLE)::INT AS y, floor(x * 0.625::DOUBLE)::INT AS x, round(avg(score), 6) + 0 AS value FROM grid GROUP BY 1, 2"),
    "r5_pyramid": (r5, cte("grid") + """ SELECT level::INT AS level, (y >> level)::INT AS y, (x >> level)::INT AS x, round(avg(score), 6) + 0 AS value FROM grid CROSS JOIN (SELECT unnest(range(4))::INT AS level) GROUP BY 1, 2, 3"""),
    "m23_image_utilities": (m23, cte("grid") + """, b AS (SELECT p AS y, q AS x, coalesce(score, 1) AS v FROM (SELECT unnest(range(44)) AS p) CROSS JOIN (SELECT unnest(range(44)) AS q) LEFT JOIN grid ON y + 2 = p AND x + 2 = q)
        SELECT b.y::INT AS y, b.x::INT AS x, greatest(b.v, coalesce(g.score, b.v)) AS value FROM b LEFT JOIN grid g ON g.y + 2 = b.y AND 39 - g.x + 2 = b.x"""),
}
