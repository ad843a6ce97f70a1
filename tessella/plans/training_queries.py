"""Queries over cached samples, training steps and draws, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import maps, ordering, training
from tessella.operators import vectors as ml
from tessella.plans import table_queries as tq
from tessella.plans import views
from tessella.plans.game_queries import r6
from tessella.plans.views import cte
from tessella.session import table

C = F.col


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(example, gt, label, score, loss): every vector against every class's mean vector, losses by the distance of the labels."""
    w = views.centroids(spark, d).withColumnRenamed("class", "label")
    t = table(spark, d, "embeddings").select(C("vec_id").alias("example"), C("label").alias("gt"), F.posexplode("embedding").alias("j", "x"))
    s = t.join(w, "j").groupBy("example", "gt", "label").agg(F.round(F.sum(C("x").cast("double") * C("w")), 9).alias("score"))
    return s.withColumn("loss", F.when(C("label") == C("gt"), 0.0).otherwise(0.5 + F.abs(C("label") - C("gt")) / 20))


SCORES = f"""WITH centroids AS ({views.SQL["centroids"]}), {tq.FLAT},
s AS (SELECT id AS example, f.class AS gt, c.class AS label, round(sum(x * w), 9) AS score FROM flat f JOIN centroids c USING (j) GROUP BY 1, 2, 3),
scores AS (SELECT *, CASE WHEN label = gt THEN 0 ELSE 0.5::DOUBLE + abs(label - gt) / 20 END AS loss FROM s),
truth AS (SELECT example, score AS gt_score FROM scores WHERE label = gt)
"""


def r17(spark, d):
    return training.most_violated(scores(spark, d)).select("example", "label", r6(C("loss")).alias("loss"), r6(C("slack")).alias("slack"))


def r18(spark, d):
    return training.created_samples(scores(spark, d)).select("example", "label", r6(C("loss")).alias("loss"), r6(C("slack")).alias("slack"))


def x10(spark, d):
    s = scores(spark, d).select("example", C("label").alias("latent"), "score", (C("label") % 3 == C("gt") % 3).alias("allowed"))
    return training.latent_values(s).select("example", "latent", r6(C("score")).alias("score"))


def x2(spark, d):
    worst = training.most_violated(scores(spark, d)).where("example = 7").select("label")
    w = views.centroids(spark, d).withColumnRenamed("w", "value")
    t = table(spark, d, "embeddings").where("vec_id = 7")
    gt, violated = t.first().label, worst.first().label
    x = t.select(F.posexplode("embedding").alias("j", "x")).select("j", C("x").cast("double").alias("x"))
    return training.one_example_step(w, x, gt, violated, 0.1, 5).select("class", "j", r6(C("value")).alias("value"))


def u5(spark, d):
    e = table(spark, d, "events").select(C("user_id").alias("example"), (C("event_id") % 7).alias("label"), C("value").alias("score"), (C("event_id") % 3 == 0).alias("late"), "event_id")
    kept = e.groupBy("example", "label", "late").agg(F.max_by("score", "event_id").alias("score"), F.count("*").alias("n"))
    old = kept.where("not late").select("example", "label", (C("n") / 10).alias("alpha"), "score")
    return training.merged_samples(old, kept.where("late").select("example", "label", "score"))


def x6(spark, d):
    first = table(spark, d, "events").groupBy(C("user_id").alias("example")).agg(F.min("event_id").alias("added"))
    return ordering.numbered(first, [C("added")]).select("example", "added", "place")


def _placed(df: DataFrame, order: list, *columns: str) -> DataFrame:
    return ordering.numbered(df, order).select("place", *columns)


def t3(spark, d):
    return _placed(table(spark, d, "embeddings"), ordering.by_class("label", "vec_id"), "vec_id", "label")


def t4(spark, d):
    return _placed(views.boxes(spark, d), ordering.by_score("score", "object", "part"), "object", "part", "score")


def t6(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(C("event_type") != "view", C("value")).alias("loss"))
    return _placed(e, ordering.by_loss("loss", "event_id"), "event_id", "loss")


def t8_alpha(spark, d):
    e = table(spark, d, "events").select(C("user_id").alias("example"), C("event_id").alias("sample"), F.round(C("value") % 3, 3).alias("alpha"))
    return _placed(e, ordering.by_score("alpha", "sample"), "example", "sample", "alpha")


def t9(spark, d):
    flat = table(spark, d, "embeddings").where("vec_id = 3").select(F.posexplode("embedding").alias("word", "value"))
    return _placed(flat.select("word", C("value").cast("double").alias("value")), ordering.by_size("value", "word"), "word", "value")


def t14(spark, d):
    s = training.created_samples(scores(spark, d)).withColumn("slack", F.round("slack", 6))
    return ordering.working_set(s, "slack", 40, "example", "label").select("example", "label", "slack")


def t18(spark, d):
    return maps.drawn(views.prices(spark, d), ["grp"], ["item"], "weight", 20)


def t20(spark, d):
    points = table(spark, d, "lineitem").select(C("l_suppkey").alias("image"), C("l_orderkey").alias("y"), C("l_partkey").alias("x")).distinct()
    return ordering.sampled_points(points, "image", ["y", "x"], 6, 30, 4)


def t19(spark, d):
    n = C("n_nationkey")
    offsets = table(spark, d, "nation").where("n_nationkey > 0").select(F.floor((n - 1) / 2).cast("int").alias("parent"), n.alias("child"), (C("n_regionkey") * 1.5).alias("dx"), (n % 7).cast("double").alias("dy"), F.lit(0.5).alias("spread"))
    from tessella.operators.parts_model import drawn_places

    out = drawn_places(spark, offsets, 0, 4, 640.0, 480.0, 20.0, 3)
    return out.select("draw", "part", r6(C("x")).alias("x"), r6(C("y")).alias("y"))


def mirrored(spark: SparkSession, d: str):
    """The step over neighbouring vectors as pairs, with the first two pairs as centres, over eight components."""
    t = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).cast("array<double>").alias("v"))
    twin = t.select((C("vec_id") - 1).alias("of"), C("v").alias("twin"))
    pairs = t.where("vec_id % 2 = 0").join(twin, C("vec_id") == C("of")).select(C("vec_id").alias("id"), C("v").alias("vector"), "twin")
    centres = np.array([r.v for r in t.where("vec_id < 4").orderBy("vec_id").collect()])
    return ml.mirrored_step(pairs, centres)


def m4(spark, d):
    return mirrored(spark, d)[0].select(C("cluster").cast("int").alias("cluster"), "j", r6(C("value")).alias("value"))


def m4_assign(spark, d):
    return mirrored(spark, d)[1].select("id", C("cluster").cast("int").alias("cluster"), r6(C("distance")).alias("distance"))


_M4 = """WITH f AS (SELECT vec_id, j, embedding[j + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(8))::INT AS j)),
    g AS (SELECT p.vec_id AS id, c.vec_id AS cluster, round(sum((p.x - c.x) ** 2 + (t.x - m.x) ** 2), 9) AS distance FROM f p JOIN f t ON t.vec_id = p.vec_id + 1 AND t.j = p.j
      JOIN f c ON c.j = p.j AND c.vec_id < 4 JOIN f m ON m.j = p.j AND m.vec_id = xor(c.vec_id::INT, 1) WHERE p.vec_id % 2 = 0 GROUP BY 1, 2),
    a AS (SELECT id, cluster, distance FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cluster) = 1) """
_U = "((('0x' || substr(md5({}), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496)"

QUERIES = {
    "m4_mirrored_kmeans": (m4, _M4 + """SELECT k::INT AS cluster, j, round(avg(x), 6) + 0 AS value FROM (SELECT id AS vec_id, cluster AS k FROM a UNION ALL SELECT id + 1, xor(cluster::INT, 1) FROM a) JOIN f USING (vec_id) GROUP BY 1, 2"""),
    "m4_mirrored_assignment": (m4_assign, _M4 + "SELECT id, cluster::INT AS cluster, round(distance, 6) AS distance FROM a"),
    "r17_importance_sample": (r17, SCORES + """SELECT example, label, round(loss, 6) AS loss, round(score + loss - gt_score, 6) + 0 AS slack FROM scores JOIN truth USING (example)
        QUALIFY row_number() OVER (PARTITION BY example ORDER BY round(score + loss, 9) DESC, label) = 1"""),
    "r18_create_samples": (r18, SCORES + "SELECT example, label, round(loss, 6) AS loss, round(score + loss - gt_score, 6) + 0 AS slack FROM scores JOIN truth USING (example) WHERE label <> gt"),
    "x10_latent_values": (x10, SCORES + "SELECT example, label AS latent, round(score, 6) + 0 AS score FROM scores WHERE label % 3 = gt % 3 QUALIFY row_number() OVER (PARTITION BY example ORDER BY round(score, 9) DESC, label) = 1"),
    "x2_one_example_step": (x2, SCORES + """, b AS (SELECT label, gt FROM scores WHERE example = 7 QUALIFY row_number() OVER (ORDER BY round(score + loss, 9) DESC, label) = 1)
        SELECT c.class, c.j, round(w * 0.8::DOUBLE + 2 * x * ((c.class = gt)::INT - (c.class = label)::INT), 6) + 0 AS value FROM centroids c JOIN flat f ON f.j = c.j AND f.id = 7 CROSS JOIN b"""),
    "u5_merge_samples": (u5, """WITH e AS (SELECT user_id AS example, event_id % 7 AS label, event_id % 3 = 0 AS late, arg_max(value, event_id) AS score, count(*) AS n FROM events GROUP BY 1, 2, 3)
        SELECT example, label, sum(CASE WHEN late THEN 0 ELSE n / 10 END) AS alpha, arg_max(score, late::INT) AS score FROM e GROUP BY 1, 2"""),
    "x6_add_example": (x6, "SELECT user_id AS example, min(event_id) AS added, row_number() OVER (ORDER BY min(event_id)) - 1 AS place FROM events GROUP BY 1"),
    "t3_class_order": (t3, "SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS place, vec_id, label FROM embeddings"),
    "t4_score_order": (t4, cte("boxes") + " SELECT row_number() OVER (ORDER BY score DESC, object, part) - 1 AS place, object, part, score FROM boxes"),
    "t6_loss_order": (t6, "SELECT row_number() OVER (ORDER BY loss NULLS FIRST, event_id) - 1 AS place, event_id, loss FROM (SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS loss FROM events)"),
    "t8_alpha_order": (t8_alpha, "SELECT row_number() OVER (ORDER BY alpha DESC, sample) - 1 AS place, example, sample, alpha FROM (SELECT user_id AS example, event_id AS sample, round(value % 3, 3) AS alpha FROM events)"),
    "t9_feature_values": (t9, "SELECT row_number() OVER (ORDER BY abs(value) DESC, word) - 1 AS place, word, value FROM (SELECT j AS word, embedding[j + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(64))::INT AS j) WHERE vec_id = 3)"),
    "t14_working_set": (t14, SCORES + "SELECT example, label, round(score + loss - gt_score, 6) + 0 AS slack FROM scores JOIN truth USING (example) WHERE label <> gt ORDER BY slack DESC, example, label LIMIT 40"),
    "t18_draw_locations": (t18, cte("prices") + f""", r AS (SELECT *, sum(weight) OVER (PARTITION BY grp) AS whole, sum(weight) OVER (PARTITION BY grp ORDER BY item) AS upto FROM prices),
        d AS (SELECT DISTINCT grp, draw, {_U.format("grp || '|' || draw || '|0'")} AS u FROM prices CROSS JOIN (SELECT unnest(range(20))::INT AS draw))
        SELECT r.grp, d.draw, r.item FROM r JOIN d ON r.grp = d.grp AND (upto - weight) / whole <= u AND upto / whole > u"""),
    "t19_draw_without_detector": (t19, f"""WITH RECURSIVE o AS (SELECT (n_nationkey - 1) // 2 AS parent, n_nationkey AS child, n_regionkey * 1.5::DOUBLE AS dx, (n_nationkey % 7)::DOUBLE AS dy, 0.5::DOUBLE AS spread FROM nation WHERE n_nationkey > 0),
        r AS (SELECT draw, 0 AS part, 20 + 600 * {_U.format("draw || '|0|x|3'")} AS x, 20 + 440 * {_U.format("draw || '|0|y|3'")} AS y FROM (SELECT unnest(range(4))::INT AS draw)
        UNION ALL SELECT draw, child, x + dx + spread * sqrt(-2 * ln({_U.format("draw || '|' || child || '|u|3'")})) * cos(2 * pi() * {_U.format("draw || '|' || child || '|v|3'")}),
          y + dy + spread * sqrt(-2 * ln({_U.format("draw || '|' || child || '|u|3'")})) * sin(2 * pi() * {_U.format("draw || '|' || child || '|v|3'")}) FROM r JOIN o ON o.parent = r.part)
        SELECT draw, part, round(x, 6) AS x, round(y, 6) AS y FROM r"""),
    "t20_codebook_points": (t20, """WITH p AS (SELECT DISTINCT l_suppkey AS image, l_orderkey AS y, l_partkey AS x FROM lineitem),
        i AS (SELECT DISTINCT image FROM p ORDER BY md5(image::VARCHAR || '|4') LIMIT 6)
        SELECT image, y, x FROM p SEMI JOIN i USING (image) QUALIFY row_number() OVER (PARTITION BY image ORDER BY md5(image || '|' || y || '|' || x || '|4'), y, x) <= 30"""),
}
