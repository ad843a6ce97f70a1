"""Further queries: part models, costs, schedules, predicates, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import probability as prob
from tessella.functions import strings as st
from tessella.operators import evaluation as ev
from tessella.operators import game, maps, ordering, parts_model
from tessella.operators import joins as jn
from tessella.operators import vectors as ml
from tessella.operators import windows as wn
from tessella.plans import table_queries as tq
from tessella.plans import views
from tessella.plans.game_queries import MODEL, PRIORS, model_of, priors_of, r6
from tessella.plans.views import cte
from tessella.session import table

C = F.col


def a6(spark, d):
    m = model_of(spark, d)
    joint = game.binary_answers(priors_of(spark, d, m), m)
    by_answer = joint.groupBy("session", "attribute", "certainty", "answer").agg(F.sum("u").alias("mass"))
    return by_answer.select("session", "attribute", "certainty", "answer", r6(prob.normalise(C("mass"), "session", "attribute")).alias("p"))


def a17(spark, d):
    parts = views.parts(spark, d)
    pairs = [(r.a, r.b, round(r.distance, 6)) for r in jn.part_distances(parts).collect()]
    seen = {r.part: r.n for r in parts.where("visible = 1").groupBy("part").agg(F.count("*").alias("n")).collect()}
    return spark.createDataFrame(jn.spanning_tree(pairs, seen), "parent int, child int")


def a23(spark, d):
    return ev.confusion(tq.predictions(spark, d)).groupBy(C("gt").alias("source")).agg(F.sum("n").alias("frequency"))


def j12(spark, d):
    s = tq.points(spark, d).select(C("id").alias("example"), F.posexplode("vector").alias("index", "x"))
    w = views.centroids(spark, d).where("w > 0").select(C("j").alias("index"), "class", "w")
    return s.join(w, "index").groupBy("example", "class").agg(r6(F.sum(C("x") * C("w"))).alias("dot"))


def j17(spark, d):
    p = tq.predictions(spark, d)
    pairs = p.select("gt", "pred").distinct().where("(gt + pred) % 3 = 0").withColumn("cost", F.abs(C("gt") - C("pred")) / 10)
    return ev.lookup_cost(p, pairs).groupBy("gt").agg(r6(F.avg("loss")).alias("loss"))


def m5(spark, d):
    placed = jn.assign(tq.points(spark, d), tq.class_centres(spark, d))
    return placed.groupBy(C("cluster").cast("int").alias("cluster")).agg(F.count("*").alias("n"), r6(F.sum("distance")).alias("error"))


def m12(spark, d):
    parts = views.parts(spark, d)
    pivot = parts.where("part = 1 and visible = 1").select("object", C("x").alias("px"), C("y").alias("py"))
    v = parts_model.offset_vectors(parts, pivot, -1000.0)
    return v.select("id", F.size("vector").alias("n"), r6(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)).alias("total"))


def m25(spark, d):
    s = tq.points(spark, d).select(C("id").alias("example"), C("class").alias("gt"), F.posexplode("vector").alias("attribute", "s"))
    w = views.centroids(spark, d).withColumnRenamed("j", "attribute")
    costs = w.select(C("class").alias("gt")).distinct().crossJoin(w.select(C("class").alias("pred")).distinct()).withColumn("cost", F.abs(C("gt") - C("pred")) / 20)
    out = parts_model.attribute_class_inference(s, w, costs)
    return out.select("example", "class", r6(C("score")).alias("score"))


def m17(spark, d):
    g = views.grid(spark, d)
    rows = g.groupBy("y").agg(F.sort_array(F.collect_list(F.struct("x", "score"))).alias("cells"), F.count("*").alias("n")).where("n = 40")
    line = rows.select(C("y").cast("long").alias("id"), F.lit(1).alias("height"), F.lit(40).alias("width"), F.lit(1).alias("channels"), F.transform("cells", lambda c: c["score"].cast("double")).alias("values"))
    out = maps.cells(maps.spread(line, (0.5, 0.0), (2.0, 1.0)))
    return out.select(C("id").cast("int").alias("y"), "x", F.round("value", 4).alias("score"))


def m24_loss_free(spark, d):
    s = tq.points(spark, d).select(C("id").alias("example"), C("class").alias("gt"), F.posexplode("vector").alias("attribute", "s"))
    scores = s.join(views.centroids(spark, d).withColumnRenamed("j", "attribute"), "attribute").groupBy("example", "gt", "class").agg(F.sum(C("s") * C("w")).alias("score"))
    return ml.argmax_class(scores).select("example", "class", r6(C("score")).alias("score"))


def p9(spark, d):
    return views.parts(spark, d).groupBy("object").agg(F.bool_or(C("visible") == 1).alias("any_visible"), F.bool_and(C("visible") == 1).alias("all_visible"))


def p12(spark, d):
    return table(spark, d, "pages").select("page_id", st.is_safe_name(C("url")).alias("safe"), st.is_safe_name(F.regexp_replace("url", "[:/?]", "_")).alias("cleaned"))


def r1(spark, d):
    w = views.centroids(spark, d).groupBy("class").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "w"))), lambda s: s["w"]).alias("values"))
    kinds = w.select(F.when(C("class") % 2 == 0, "part").otherwise("attribute").alias("kind"), C("class").alias("owner"), "values")
    return parts_model.flattened_weights(kinds, ["part", "attribute"]).select("index", r6(C("value")).alias("value"))


def r12(spark, d):
    o = table(spark, d, "nation").where("n_nationkey > 0").select(
        F.floor((C("n_nationkey") - 1) / 2).cast("int").alias("parent"), C("n_nationkey").alias("child"), (C("n_regionkey") * 1.5).alias("dx"), (C("n_nationkey") % 7).cast("double").alias("dy")
    )
    return parts_model.ideal_places(spark, o, 0, 10.0, 20.0)


def r14(spark, d):
    t = table(spark, d, "part").select((C("p_size") > 100).alias("is_click"))
    return parts_model.has_transitions(t, True).unionByName(parts_model.has_transitions(t, False))


def t8(spark, d):
    t = table(spark, d, "events").select(C("user_id").alias("example"), C("event_id").alias("sample"), C("value").alias("score"))
    return parts_model.hard_negatives(t, 3, 10.0)


def x9(spark, d):
    t = table(spark, d, "events").groupBy(C("user_id").alias("example")).agg(F.count("*").alias("iterations"))
    return ordering.scheduled(t, 2, 25)


def w2b(spark, d):
    t = tq.traced(spark, d)
    return wn.pair_compacted(t, "iter", "dual", 7).select("bin", r6(C("mean")).alias("mean"), "n")


def m3(spark, d):
    centres, error = ml.kmeans(tq.points(spark, d), 8, restarts=2, rounds=4)
    return spark.createDataFrame([(i, j, float(np.round(v, 4)), float(round(error, 3))) for i, c in enumerate(centres) for j, v in enumerate(c)], "cluster int, j int, value double, error double")


def x1(spark, d):
    from tessella.operators.learning import Learner

    points = tq.points(spark, d).withColumnRenamed("class", "label")
    learner = Learner(10, 0.05).train(points, 8)
    return learner.predict(points).select("id", "label", F.round("score", 6).alias("score"))


FLAT = tq.FLAT
QUERIES = {
    "a6_answer_probabilities": (a6, MODEL + PRIORS + """, j AS (SELECT session, attribute, certainty, answer, sum(priors.p * CASE WHEN q > 0 THEN exp(weight * ln(q)) ELSE 0 END) AS mass
        FROM priors JOIN (SELECT *, CASE WHEN answer = 1 THEN p ELSE 1 - p END AS q FROM model CROSS JOIN (SELECT unnest([0, 1])::INT AS answer)) m USING (class) GROUP BY 1, 2, 3, 4)
        SELECT session, attribute, certainty, answer, round(mass / sum(mass) OVER (PARTITION BY session, attribute), 6) AS p FROM j"""),
    "a17_spanning_tree": (a17, cte("parts").replace("WITH", "WITH RECURSIVE", 1) + """, p AS (SELECT * FROM parts WHERE visible = 1),
        e AS (SELECT p.part AS a, q.part AS b, round(avg(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)), 6) AS c FROM p JOIN p q ON p.object = q.object AND p.part <> q.part GROUP BY 1, 2),
        root AS (SELECT part FROM p GROUP BY 1 ORDER BY count(*) DESC, part LIMIT 1),
        r AS (SELECT [part] AS used, NULL::INT AS parent, part AS child, 0 AS step FROM root
          UNION ALL SELECT list_append(any_value(used), (min({'c': c, 'a': a, 'b': b})).b), (min({'c': c, 'a': a, 'b': b})).a, (min({'c': c, 'a': a, 'b': b})).b, step + 1
          FROM r JOIN e ON list_contains(used, a) AND NOT list_contains(used, b) GROUP BY step)
        SELECT parent, child FROM r WHERE step > 0"""),
    "a23_node_frequency": (a23, "SELECT label AS source, count(*)::BIGINT AS frequency FROM embeddings GROUP BY 1"),
    "j12_sparse_dense_dot": (j12, f"WITH centroids AS ({views.SQL['centroids']}), {FLAT} SELECT id AS example, c.class, round(sum(x * w), 6) + 0 AS dot FROM flat JOIN centroids c USING (j) WHERE w > 0 GROUP BY 1, 2"),
    "j17_cost_lookup": (j17, tq.PRED + "SELECT gt, round(avg(CASE WHEN (gt + pred) % 3 = 0 THEN abs(gt - pred) / 10 ELSE (gt <> pred)::INT END), 6) AS loss FROM predictions GROUP BY 1"),
    "m3_kmeans": (m3, None),
    "m5_cluster_error": (m5, tq.PRED + "SELECT pred AS cluster, count(*) AS n, round(sum(distance), 6) AS error FROM predictions GROUP BY 1"),
    "m12_pose_offsets": (m12, cte("parts") + """, p AS (SELECT * FROM parts), v AS (SELECT object, x AS px, y AS py FROM p WHERE part = 1 AND visible = 1)
        SELECT v.object AS id, (2 * count(*))::INT AS n, round(sum(CASE WHEN p.x IS NULL THEN -2000 ELSE p.x - px + p.y - py END), 6) + 0 AS total
        FROM v CROSS JOIN (SELECT DISTINCT part FROM p) k LEFT JOIN p ON p.object = v.object AND p.part = k.part AND p.visible = 1 GROUP BY 1"""),
    "m17_distance_transform": (m17, cte("grid") + """, f AS (SELECT y, x, score FROM grid WHERE y IN (SELECT y FROM grid GROUP BY y HAVING count(*) = 40))
        SELECT p.y, p.x, round(max(q.score - 0.5::DOUBLE * (q.x - p.x) - 2 * (q.x - p.x) ** 2), 4) AS score FROM f p JOIN f q ON p.y = q.y GROUP BY 1, 2"""),
    "m24_argmax_plain": (m24_loss_free, f"""WITH centroids AS ({views.SQL["centroids"]}), {FLAT}, s AS (SELECT id, c.class, round(sum(x * w), 9) AS s FROM flat f JOIN centroids c USING (j) GROUP BY 1, 2)
        SELECT id AS example, class, round(s, 6) + 0 AS score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, class) = 1"""),
    "m25_attribute_inference": (m25, f"""WITH centroids AS ({views.SQL["centroids"]}), {FLAT}, s AS (SELECT id, f.class AS gt, c.class, round(sum(x * w) + abs(f.class - c.class) / 20, 9) AS s FROM flat f JOIN centroids c USING (j) GROUP BY 1, 2, 3)
        SELECT id AS example, class, round(s, 6) + 0 AS score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, class) = 1"""),
    "p9_visibility": (p9, cte("parts") + " SELECT object, bool_or(visible = 1) AS any_visible, bool_and(visible = 1) AS all_visible FROM parts GROUP BY 1"),
    "p12_safe_names": (p12, r"SELECT page_id, NOT regexp_matches(url, '[/\\~]') AS safe, NOT regexp_matches(regexp_replace(url, '[:/?]', '_', 'g'), '[/\\~]') AS cleaned FROM pages"),
    "r1_flatten_weights": (r1, cte("centroids") + " SELECT row_number() OVER (ORDER BY class % 2, class, j) - 1 AS index, round(w, 6) + 0 AS value FROM centroids"),
    "r12_ideal_places": (r12, """WITH RECURSIVE t AS (SELECT 0 AS part, 10.0::DOUBLE AS x, 20.0::DOUBLE AS y UNION ALL
        SELECT n_nationkey, t.x + n_regionkey * 1.5::DOUBLE, t.y + n_nationkey % 7 FROM nation JOIN t ON (n_nationkey - 1) // 2 = t.part WHERE n_nationkey > 0) SELECT part, x, y FROM t"""),
    "r14_has_transitions": (r14, "SELECT bool_or(p_size > 100) AS found FROM part UNION ALL SELECT bool_or(p_size <= 100) FROM part"),
    "t8_hard_negatives": (t8, "SELECT user_id AS example, event_id AS sample, value AS score FROM events WHERE value > 10 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3"),
    "w2_compaction_deep": (w2b, tq.TRACE + " SELECT iter // 128 AS bin, round(avg(dual), 6) AS mean, count(*) AS n FROM t GROUP BY 1"),
    "x1_train_predict": (x1, None),
    "x9_schedule": (x9, "SELECT user_id AS example, count(*) AS iterations FROM events GROUP BY 1 ORDER BY 2, md5(user_id::VARCHAR || '|2'), 1 LIMIT 25"),
}
