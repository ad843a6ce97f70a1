"""Queries over joins, windows, sorts, sets, scalars and vectors, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import numbers as num
from tessella.functions import probability as prob
from tessella.functions import strings as st
from tessella.functions import vectors as vec
from tessella.operators import annotations as ann
from tessella.operators import boxes as bx
from tessella.operators import evaluation as ev
from tessella.operators import joins as jn
from tessella.operators import learning as ln
from tessella.operators import ordering as od
from tessella.operators import response_model as rm
from tessella.operators import sessions as ss
from tessella.operators import vectors as ml
from tessella.operators import windows as wn
from tessella.plans import views
from tessella.plans.game_queries import r6
from tessella.plans.views import cte
from tessella.session import table

C = F.col


def points(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings")
    return t.select(C("vec_id").alias("id"), C("embedding").cast("array<double>").alias("vector"), C("label").alias("class"))


def class_centres(spark: SparkSession, d: str, dims: int = 64) -> list:
    rows = views.centroids(spark, d).where(C("j") < dims).groupBy("class").agg(F.sort_array(F.collect_list(F.struct("j", "w"))).alias("v")).collect()
    return [(r["class"], [x.w for x in r.v]) for r in sorted(rows, key=lambda r: r["class"])]


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(id, gt, pred): each vector's label and that of the nearest class centre."""
    p = points(spark, d)
    placed = jn.assign(p, class_centres(spark, d))
    return placed.join(p.select("id", C("class").alias("gt")), "id").select("id", "gt", C("cluster").cast("int").alias("pred"), "distance")


FLAT = "flat AS (SELECT vec_id AS id, label AS class, j, embedding[j + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(64))::INT AS j))"
PRED = f"""WITH centroids AS ({views.SQL["centroids"]}), {FLAT},
gaps AS (SELECT id, f.class AS gt, c.class AS pred, round(sum((x - w) * (x - w)), 9) AS g FROM flat f JOIN centroids c USING (j) GROUP BY 1, 2, 3),
predictions AS (SELECT id, gt, pred, g AS distance FROM gaps QUALIFY row_number() OVER (PARTITION BY id ORDER BY g, pred) = 1)
"""


def scan(spark, d):
    t = table(spark, d, "lineitem").where((C("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")) & (C("l_quantity") > 25))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", r6(C("l_extendedprice") * (1 - C("l_discount"))).alias("net"))


def p1(spark, d):
    return table(spark, d, "orders").where(C("o_orderkey") % 3 == 0).select("o_orderkey", "o_orderstatus")


SUBSET = [7, 3, 12, 20, 0]


def p2(spark, d):
    return jn.subset_map(table(spark, d, "nation"), "n_nationkey", SUBSET)


def p2_rows(spark, d):
    return jn.renumbered(table(spark, d, "customer"), "c_nationkey", SUBSET).select("c_custkey", "new_id")


def p4(spark, d):
    t = views.boxes(spark, d).withColumn("locations", F.array(F.struct(F.when(C("x") > 100, C("x")).alias("x"), C("h").alias("rotation"))))
    out = t.withColumn("locations", ann.zero_rotations("locations"))
    return out.select("object", "part", r6(C("locations")[0]["rotation"]).alias("rotation"))


def tree(parts):
    return parts.select("part").distinct().where("part > 1").select("part", (C("part") - 1).alias("parent"))


def p5(spark, d):
    parts = views.parts(spark, d)
    return ann.scale_conversion(rm.parent_child(parts, tree(parts)), 50.0).select("object", r6(C("scale")).alias("scale"))


def p6(spark, d):
    parts = views.parts(spark, d)
    twins = parts.select("part").distinct().where("part <= 6").select("part", F.when(C("part") % 2 == 0, C("part") - 1).otherwise(C("part") + 1).alias("twin"))
    return ann.flipped(parts, twins, 640).select("object", "part", r6(C("x")).alias("x"))


def p7(spark, d):
    x, y = ann.to_detection(C("x"), C("y"), 2, 1.25, 8, 40, 30)
    return views.parts(spark, d).select("object", "part", x.alias("cell_x"), y.alias("cell_y"))


def p8(spark, d):
    questions = table(spark, d, "events").select("event_id", F.element_at(F.create_map(*[F.lit(v) for v in ("click", "part_click", "view", "binary", "signup", "multiple_choice", "error", "batch", "purchase", "binary")]), C("event_type")).alias("type"))
    return ann.askable(questions, vision=False, multiple=False)


def p10(spark, d):
    parts = views.parts(spark, d)
    return jn.agreeing(parts.where("part > 1"), parts.where("part = 1 and visible = 1"), 150.0).select("object", "part")


def p13(spark, d):
    t = table(spark, d, "labels").select("doc_id", C("quality").alias("class"), F.when(C("doc_id") % 2 == 0, C("toxic")).alias("partial"))
    return ann.consistent(t).select("doc_id", "class")


def p15(spark, d):
    scaled = vec.scale_regions(vec.sparse_of(C("vector")), [20, 40, 64], [2.0, 0.5, -1.0])
    part = vec.sparse_slice(scaled, 10, 44)
    return points(spark, d).select("id", F.explode(part).alias("i", "v")).select("id", "i", r6(C("v")).alias("v"))


def j1(spark, d):
    t = {n: table(spark, d, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    joined = (
        t["lineitem"].join(t["orders"], C("l_orderkey") == C("o_orderkey")).join(t["customer"], C("o_custkey") == C("c_custkey"))
        .join(t["nation"], C("c_nationkey") == C("n_nationkey")).join(t["region"], C("n_regionkey") == C("r_regionkey"))
    )
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def j2(spark, d):
    names = table(spark, d, "nation").select(C("n_nationkey").alias("id"), F.concat(F.lit("k"), (C("n_nationkey") % 20).cast("string")).alias("name"))
    t = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("k"), (C("c_nationkey") + 0).cast("string")).alias("nation"))
    return jn.by_name(t, names, "nation").select("c_custkey", "nation_id")


def j5(spark, d):
    r = views.responses(spark, d)
    dims = [r.select(c).distinct() for c in ("class", "attribute", "certainty")]
    return dims[0].crossJoin(dims[1]).crossJoin(dims[2])


def j7(spark, d):
    parts = views.parts(spark, d)
    return rm.parent_child(parts, tree(parts)).select("object", "part", r6(C("dx")).alias("dx"), r6(C("dy")).alias("dy"))


def j8(spark, d):
    return jn.part_distances(views.parts(spark, d)).select("a", "b", r6(C("distance")).alias("distance"), "n")


def j9(spark, d):
    p = points(spark, d)
    return jn.nearest(p.where("id % 100 = 0"), p, 3).select("id", "place", "found", r6(C("distance")).alias("distance"))


def j9_class(spark, d):
    p = points(spark, d)
    return jn.nearest(p.where("id % 100 = 0"), p, 1, same_class=True).select("id", "found", r6(C("distance")).alias("distance"))


def j10(spark, d):
    return predictions(spark, d).select("id", "pred", r6(C("distance")).alias("distance"))


def j11(spark, d):
    scores = points(spark, d).select(C("id").alias("example"), F.posexplode("vector").alias("attribute", "s"))
    weights = views.centroids(spark, d).withColumnRenamed("j", "attribute")
    return jn.class_scores(scores, weights).select("example", "class", r6(C("score")).alias("score"))


def j14(spark, d):
    return jn.paired_questions(views.log(spark, d), "view", "click")


def a3(spark, d):
    parts = views.parts(spark, d)
    return rm.upper_median(parts.where("visible = 1"), "seconds", "part")


def a4(spark, d):
    parts = views.parts(spark, d)
    m = rm.spatial_moments(rm.parent_child(parts, tree(parts)), "parent", "part", min_examples=20)
    return m.select("parent", "part", "n", *[F.round(c, 4).alias(c) for c in ("mean_x", "mean_y", "var_x", "var_y", "gap_x", "gap_y")], F.round("weight_x", 8).alias("weight_x"))


def a5(spark, d):
    return views.prices(spark, d).select("grp", "item", r6(prob.normalise(C("weight"), "grp")).alias("p"))


def a7(spark, d):
    p = views.prices(spark, d).withColumn("p", prob.normalise(C("weight"), "grp"))
    return p.groupBy("grp").agg(r6(prob.entropy(C("p"))).alias("entropy"))


def labelled(spark, d):
    return table(spark, d, "labels").select(C("quality").alias("gt"), C("toxic").alias("pred"))


def a9(spark, d):
    return ev.confusion(predictions(spark, d))


def a12(spark, d):
    p = predictions(spark, d)
    near = F.abs(C("gt") - C("pred"))
    loss = num.taxonomic_loss(near == 0, near == 1, near <= 3, near <= 6)
    return p.agg(r6(F.avg((C("gt") != C("pred")).cast("double"))).alias("error"), r6(F.avg(loss)).alias("taxonomic"), r6(ev.mean_when_known(C("distance"), C("gt") % 2 == 0)).alias("known"))


def a13(spark, d):
    p = predictions(spark, d).select((C("gt") != C("pred")).cast("double").alias("loss"), (-C("distance")).alias("score"), (-C("distance") * 1.5).alias("gt_score"))
    return ev.test_summary(p, 2.0, 0.1).select(*[r6(C(c)).alias(c) for c in ("loss", "slack", "svm_error")])


def a14(spark, d):
    errors = table(spark, d, "lineitem").groupBy(C("l_orderkey").alias("example"), (C("l_linenumber") - 1).alias("step"), C("l_suppkey").alias("part")).agg(F.max("l_discount").alias("error"))
    return ev.drag_losses(errors, 8, 0.05).select("step", r6(C("loss")).alias("loss"))


def a15(spark, d):
    parts = views.parts(spark, d)
    groups = parts.select("part").distinct().select("part", (C("part") % 2).alias("pseudo"))
    out = rm.without_unseen_pseudo(rm.pseudo_parts(parts, groups))
    return out.select("object", "pseudo", *[r6(C(c)).alias(c) for c in ("x", "y", "seconds")])


def a16(spark, d):
    parts = table(spark, d, "nation").select((C("n_nationkey") + 0).alias("part"), F.when(C("n_nationkey") > 0, F.floor((C("n_nationkey") - 1) / 2).cast("int")).alias("parent"))
    return ann.topological(spark, parts)


def a19(spark, d):
    w = views.centroids(spark, d).withColumnRenamed("j", "attribute")
    return ev.class_costs(w).select("gt", "pred", r6(C("cost")).alias("cost"))


def a20(spark, d):
    w = views.centroids(spark, d).withColumnRenamed("j", "attribute")
    return ev.centred_signs(w).select("class", "attribute", r6(C("centred")).alias("centred"), "sign")


def a21(spark, d):
    w = views.centroids(spark, d).withColumnRenamed("j", "attribute")
    norms = w.select("attribute").distinct().withColumn("sqr", (1 + C("attribute") % 3).cast("double"))
    return ev.gram(w, norms).select("class_a", "class_b", r6(C("product")).alias("product"))


def a22(spark, d):
    e = views.log(spark, d)
    loss = num.study_loss(C("value") % 4, C("value"))
    return e.groupBy("user_id").agg(r6(F.sum(F.when(C("kind") == "view", loss).otherwise(0.0))).alias("loss"))


def a26(spark, d):
    g = views.grid(spark, d).withColumn("map", C("y") % 4)
    best = F.max(F.struct("score", (-C("y")).alias("my"), (-C("x")).alias("mx")))
    return g.groupBy("map").agg(best.alias("b")).select("map", (-C("b.my")).alias("y"), (-C("b.mx")).alias("x"), C("b.score").alias("score"))


def traced(spark, d):
    e = table(spark, d, "events")
    return e.select(C("event_id").alias("iter"), C("user_id").alias("example"), C("value").alias("error"), (C("value") * 0.5).alias("dual"), F.lit(0.25).alias("regularisation"))


def w1(spark, d):
    return wn.bucketed_trailing_mean(traced(spark, d), "error", "iter", 100).select("iter", r6(C("mean")).alias("mean"))


def w2(spark, d):
    return wn.pair_compacted(traced(spark, d), "iter", "error", 4).select("bin", r6(C("mean")).alias("mean"), "n")


def w3(spark, d):
    return wn.by_example(traced(spark, d)).select("iter", "visit", F.round("mean_error", 9).alias("mean_error"))


def w4(spark, d):
    return wn.cumulative(views.prices(spark, d), "weight", ["item"], "grp").select("grp", "item", "running", r6(C("share")).alias("share"))


def w5(spark, d):
    t = table(spark, d, "part").select(C("p_partkey").alias("part"), C("p_brand").alias("brand"), C("p_size").alias("length"))
    return wn.feature_offsets(t, "part", "brand").select("part", "offset")


def w7(spark, d):
    return wn.local_maxima(views.grid(spark, d))


def w9(spark, d):
    e = traced(spark, d)
    return wn.every_nth(e, "iter", 500, e.count()).select("iter", "error")


def w10(spark, d):
    return wn.statistics(traced(spark, d), 50).select("iter", F.round("epsilon", 9).alias("epsilon"))


def t2(spark, d):
    t = views.parts(spark, d).groupBy("object").agg(F.sort_array(F.collect_set("part")).alias("poses"))
    return od.by_pose(t, "poses", "object").select("object", F.array_join(F.transform("poses", lambda x: x.cast("string")), ",").alias("poses"))


def t5(spark, d):
    return views.boxes(spark, d).orderBy(C("w") / C("h"), "object", "part").select("object", "part", r6(C("w") / C("h")).alias("ratio"))


def t7(spark, d):
    e = table(spark, d, "events").select(C("event_id").alias("example"), F.when(C("event_type") != "error", C("value")).alias("slack"))
    return e.orderBy(*od.hard_examples(e)).limit(100)


def t10(spark, d):
    return od.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [C("o_totalprice").desc(), C("o_orderkey")], 200, 100)


def t13(spark, d):
    s = table(spark, d, "events").select(C("user_id").alias("example"), C("event_id").alias("sample"), C("value").alias("alpha"))
    return od.condensed(s, 20).select("example", "sample", "kept")


def t15(spark, d):
    return od.shuffled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", seed=3)


def t16(spark, d):
    return od.exact_split(table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], 30, ["lang"], seed=1).select("doc_id", "split")


def t17(spark, d):
    return wn.weighted_pick(views.prices(spark, d), "weight", ["item"], "grp").select("grp", "item")


def u1(spark, d):
    t = {n: table(spark, d, n) for n in ("events", "conversations", "orders")}
    one = t["events"].select(C("user_id").alias("who"), F.lit("event").alias("what"), C("event_id").alias("n"))
    two = t["conversations"].select(C("conv_id").alias("who"), F.lit("turn").alias("what"), C("turn").alias("n"))
    three = t["orders"].select(C("o_custkey").alias("who"), F.lit("order").alias("what"), C("o_orderkey").alias("n"))
    return one.unionByName(two).unionByName(three)


def u2(spark, d):
    e = views.log(spark, d)
    every = e.select("question").distinct()
    users = e.select("user_id").distinct()
    return users.crossJoin(every).join(e.select("user_id", "question"), ["user_id", "question"], "left_anti")


def u3(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(C("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


def u4(spark, d):
    p = points(spark, d).select("id", vec.sparse_of(F.slice("vector", 1, 32)).alias("a"), vec.sparse_of(F.slice("vector", 33, 32)).alias("b"))
    both = p.select("id", F.explode(F.map_concat("a", vec.sparse_shift(C("b"), 32))).alias("i", "v"))
    return both.select("id", "i", r6(C("v")).alias("v"))


def u6(spark, d):
    t = views.parts(spark, d).groupBy("object").agg(F.collect_list(F.struct("part", "visible", (C("part") != 2).alias("isValid"))).alias("objects"))
    nested = t.select(C("object").alias("x"), F.struct("objects").alias("y"))
    return ann.objects_of(nested).select(C("x").alias("object"), C("object.part").alias("part"), C("object.visible").alias("visible"))


def s_paths(spark, d):
    u = C("url")
    return table(spark, d, "pages").select(
        "page_id", st.file_name(u).alias("file"), st.folder(u).alias("folder"), st.extension(u).alias("ext"), st.strip_extension(u).alias("bare"), st.is_safe_name(st.file_name(u)).alias("safe"),
        st.replace_all(u, "e", "3").alias("everywhere"), st.replace_first(u, "e", "3").alias("once"),
    )


def s_tokens(spark, d):
    tokens = st.split_tokens(C("url"), "/.?&=")
    return table(spark, d, "pages").select("page_id", F.size(tokens).alias("n"), F.array_join(tokens, "|").alias("tokens"))


def s_prefix(spark, d):
    t = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_set("s_name")).alias("names"))
    return t.select("s_nationkey", st.common_prefix(C("names")).alias("prefix"))


def s_math(spark, d):
    b = C("c_acctbal")
    return table(spark, d, "customer").select(
        "c_custkey", num.round_away(b).alias("rounded"), r6(num.sigmoid2(b / 5000)).alias("sigmoid"), r6(num.clamp(b, F.lit(0.0), F.lit(5000.0))).alias("clamped"),
        num.circular_difference(C("c_nationkey"), F.lit(3), 25).cast("int").alias("turn"), r6(F.log2(F.abs(b) + 1)).alias("log2"),
    )


def s_distances(spark, d):
    p = points(spark, d)
    other = p.select((C("id") - 1).alias("id"), C("vector").alias("w"))
    a, b = C("vector"), C("w")
    return p.join(other, "id").select(
        "id", r6(vec.l2_squared(a, b)).alias("l2sq"), r6(vec.l2(a, b)).alias("l2"), r6(vec.l1(a, b)).alias("l1"),
        r6(vec.chi_squared(F.transform(a, F.abs), F.transform(b, F.abs))).alias("chi2"), r6(vec.dot(a, b)).alias("dot"), r6(vec.magnitude_squared(a)).alias("sqr"),
    )


def s_sparse(spark, d):
    p = points(spark, d).select("id", vec.sparse_of(F.transform("vector", lambda x: F.when(x > 0.05, x).otherwise(0.0))).alias("a"))
    q = p.select((C("id") - 1).alias("id"), C("a").alias("b"))
    return p.join(q, "id").select("id", r6(vec.sparse_dot(C("a"), C("b"))).alias("dot"), F.size(vec.sparse_multiply(C("a"), C("b"))).alias("shared"), F.size(vec.sparse_add(C("a"), C("b"))).alias("either"))


def s_unit(spark, d):
    v = C("vector")
    return points(spark, d).select("id", *[r6(f(v)[0]).alias(n) for n, f in (("unit", vec.unit), ("power", vec.power_unit), ("clipped", vec.clipped_unit), ("minmax", vec.min_max))])


def s_json(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return e.select("event_id", C("p.k").alias("k"), F.to_json(F.struct(C("event_id").alias("id"), C("p.k").alias("k"))).alias("json"))


def s_answer(spark, d):
    code = st.answer_code((C("event_id") % 2).cast("int"), (C("event_id") % 4).cast("int"), C("value"))
    return table(spark, d, "events").select("event_id", st.answer_of(code).alias("a")).select("event_id", "a.answer", "a.certainty", F.round(C("a.seconds").cast("double"), 2).alias("seconds"))


def s_taxonomy(spark, d):
    t = {n: table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier", "nation")}
    near = t["nation"].select(C("n_nationkey").alias("m"), C("n_regionkey").alias("q"))
    pairs = (
        t["lineitem"].join(t["orders"], C("l_orderkey") == C("o_orderkey")).join(t["customer"], C("o_custkey") == C("c_custkey")).join(t["supplier"], C("l_suppkey") == C("s_suppkey"))
        .join(t["nation"], C("c_nationkey") == C("n_nationkey")).join(near, C("s_nationkey") == C("m"))
    )
    loss = num.taxonomic_loss(C("c_custkey") == C("s_suppkey"), C("c_nationkey") == C("s_nationkey"), C("n_regionkey") == C("q"), F.abs(C("n_regionkey") - C("q")) == 1)
    return pairs.groupBy("c_nationkey").agg(F.sum(loss).alias("loss"), F.count("*").alias("n"))


def s_iou(spark, d):
    b = views.boxes(spark, d)
    o = b.select("object", (C("part") - 1).alias("part"), *[C(c).alias(c + "2") for c in "xywh"])
    return b.join(o, ["object", "part"]).select("object", "part", r6(num.iou(tuple(C(c) for c in "xywh"), tuple(C(c + "2") for c in "xywh"))).alias("iou"))


def m2(spark, d):
    moved, placed = ml.kmeans_step(points(spark, d), class_centres(spark, d))
    return moved.select(C("cluster").cast("int").alias("cluster"), "j", r6(C("value")).alias("value"))


def m6(spark, d):
    planes = np.array([[1.0 if j == k else 0.0 for j in range(64)] + [0.01 * k] for k in range(7)])
    return ml.tree_assign(points(spark, d), planes, 3)


def m6_fit(spark, d):
    """(id, leaf) by planes that are learnt from all points."""
    return ml.tree_assign(points(spark, d), ml.hierarchical(points(spark, d), 3), 3)


def m7(spark, d):
    new_mu, new_var, weight, _ = ml.mixture_step(points(spark, d), np.array(MEANS), np.full((3, 64), VARIANCE), np.full(3, 1 / 3))
    rows = [(k, j, float(round(new_mu[k, j], 6)), float(round(new_var[k, j], 6)), float(round(weight[k], 6))) for k in range(3) for j in range(64)]
    return spark.createDataFrame(rows, "component int, j int, mu double, var double, weight double")


def m8(spark, d):
    return ml.covariance(points(spark, d)).select("a", "b", r6(C("cov")).alias("cov"))


MEANS = [[0.02 * (k + 1) * (1 if j % 2 else -1) for j in range(64)] for k in range(3)]
VARIANCE = 0.5


def m9(spark, d):
    p = points(spark, d).select(C("class").cast("long").alias("image"), "vector")
    out = ml.fisher_vectors(p, np.array(MEANS), np.full((3, 64), VARIANCE), np.full(3, 1 / 3))
    return out.select("image", "component", "j", r6(C("d_mu")).alias("d_mu"), r6(C("d_sigma")).alias("d_sigma"))


def m10(spark, d):
    words = predictions(spark, d).select((C("id") % 7).alias("image"), C("pred").alias("word"))
    return ml.word_histogram(words).select("image", "word", "n", r6(C("share")).alias("share"))


def m11(spark, d):
    cells = table(spark, d, "lineitem").select((C("l_suppkey") % 5).alias("image"), (C("l_partkey") % 40).alias("y"), (C("l_orderkey") % 64).alias("x"), C("l_returnflag").alias("word"))
    return ml.pyramid(cells, 3, 64, 40)


def m14(spark, d):
    return bx.suppress(views.boxes(spark, d), 0.1).select("object", "part")


def m24(spark, d):
    scores = points(spark, d).select(C("id").alias("example"), C("class").alias("gt"), F.posexplode("vector").alias("attribute", "s"))
    joined = scores.join(views.centroids(spark, d).withColumnRenamed("j", "attribute"), "attribute").groupBy("example", "gt", "class").agg(F.sum(C("s") * C("w")).alias("score"))
    return ml.argmax_class(joined, margin=True).select("example", "class", r6(C("score")).alias("score"))


def x3(spark, d):
    samples = points(spark, d).select(C("id").alias("example"), F.posexplode("vector").alias("index", "value")).where("value > 0")
    weights = views.centroids(spark, d).where("class = 0").select(C("j").alias("index"), C("w").alias("value"))
    return ln.gradient_step(samples, weights, 0.01, 5).select("index", r6(C("value")).alias("value"))


def x4(spark, d):
    s = table(spark, d, "events").select(C("event_id").alias("example"), (C("value") % 1).alias("alpha"), (C("value") - 10).alias("slack"), (C("event_id") % 5).cast("double").alias("sqr"))
    return ln.dual_step(s, 0.01, 100).select("example", r6(C("new_alpha")).alias("new_alpha"), r6(C("change")).alias("change"))


def x5(spark, d):
    duals = points(spark, d).select(C("id").alias("example"), ((C("id") % 10) / 10).alias("alpha"))
    diff = points(spark, d).select(C("id").alias("example"), F.posexplode("vector").alias("index", "value"))
    return ln.recomputed_weights(duals, diff, 0.01, 100).select("index", r6(C("value")).alias("value"))


def x7(spark, d):
    e = table(spark, d, "events").select(C("event_id").alias("seq"), C("user_id").alias("example"), F.when(C("event_type") == "error", "remove").when(C("event_type") == "view", "relabel").otherwise("add").alias("action"), "value")
    return ln.current_examples(e)


def x13(spark, d):
    s = table(spark, d, "customer").select(C("c_custkey").alias("session"), (C("c_custkey") * 7919 % 1009).alias("stamp"), (C("c_nationkey") % 3 == 0).alias("finished"))
    return ss.evicted(s, 100).where("evicted").select("session")


def x15(spark, d):
    return ss.folded(views.log(spark, d)).select("user_id", "n", "clicks", "questions", "seconds")


def gaps(spark, d):
    return ss.gap_sessions(views.log(spark, d), 3 * 3600)


def r1(spark, d):
    return wn.scatter_add(traced(spark, d).select(C("iter").alias("index"), C("error").alias("value")), traced(spark, d).select((C("iter") % 20 * 10).alias("offset"), (C("iter") % 10).alias("i"), C("dual").alias("value"))).select("index", r6(C("value")).alias("value"))


def k9(spark, d):
    return ev.confusion_totals(labelled(spark, d))


def s18(spark, d):
    return bx.sampled_frames(table(spark, d, "events").select(C("event_id").alias("frame"), "user_id"))


def k11(spark, d):
    lines = bx.detection_lines(views.boxes(spark, d).withColumn("name", F.concat(F.lit("o"), C("object").cast("string"))))
    p = bx.parsed_detections(lines)
    return p.groupBy("name").agg(F.count("*").alias("n"), r6(F.max("score")).alias("score"), F.round(F.sum(C("x2") - C("x1")), 3).alias("width"))


LOG = cte("log")
TRACE = "WITH t AS (SELECT event_id AS iter, user_id AS example, value AS error, value * 0.5 AS dual FROM events)"
CENT = cte("centroids")
PARTS = cte("parts")

QUERIES = {
    "scan_filter_project": (scan, "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' AND l_quantity > 25"),
    "p1_extract_subset": (p1, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0"),
    "p2_subset_renumber": (p2, "SELECT n_nationkey AS old_id, (coalesce(list_position([7, 3, 12, 20, 0], n_nationkey), 0) - 1)::INT AS new_id FROM nation"),
    "p2_subset_rows": (p2_rows, "SELECT c_custkey, (list_position([7, 3, 12, 20, 0], c_nationkey) - 1)::INT AS new_id FROM customer WHERE c_nationkey IN (7, 3, 12, 20, 0)"),
    "p4_zero_rotations": (p4, cte("boxes") + " SELECT object, part, round(CASE WHEN x > 100 THEN 0 ELSE h END, 6) AS rotation FROM boxes"),
    "p5_scale_conversion": (p5, PARTS + " SELECT c.object, round(greatest(1.0, avg(sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2)) / 50), 6) AS scale FROM parts c JOIN parts p ON c.object = p.object AND c.part = p.part + 1 WHERE c.visible = 1 AND p.visible = 1 GROUP BY 1"),
    "p6_flip_parts": (p6, PARTS + " SELECT object, CASE WHEN part > 6 THEN part WHEN part % 2 = 0 THEN part - 1 ELSE part + 1 END AS part, round(639 - x, 6) AS x FROM parts"),
    "p7_detection_cells": (p7, PARTS + " SELECT object, part, least(greatest(floor(x / 12.5 + 0.5), 0), 39)::INT AS cell_x, least(greatest(floor(y / 12.5 + 0.5), 0), 29)::INT AS cell_y FROM parts"),
    "p8_disable_questions": (p8, "SELECT event_id, 'binary' AS type FROM events WHERE event_type IN ('view', 'purchase')"),
    "p10_agree_with_clicks": (p10, PARTS + " SELECT object, part FROM parts p WHERE part > 1 AND EXISTS (SELECT 1 FROM parts c WHERE c.object = p.object AND c.part = 1 AND c.visible = 1 AND (c.x - p.x) ** 2 + (c.y - p.y) ** 2 <= 22500)"),
    "p13_partial_label": (p13, "SELECT doc_id, quality AS class FROM labels WHERE doc_id % 2 = 1 OR quality = toxic"),
    "p15_feature_regions": (p15, f"""WITH {FLAT} SELECT id, (j - 10)::INT AS i, round(x * CASE WHEN j < 20 THEN 2.0::DOUBLE WHEN j < 40 THEN 0.5::DOUBLE ELSE -1.0::DOUBLE END, 6) + 0 AS v FROM flat WHERE j BETWEEN 10 AND 53 AND x <> 0"""),
    "j1_import_joins": (j1, "SELECT r_name, n_name, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "j2_name_lookup": (j2, "SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN c_nationkey END AS nation_id FROM customer"),
    "j5_cross_dims": (j5, cte("responses") + " SELECT * FROM (SELECT DISTINCT class FROM responses) CROSS JOIN (SELECT DISTINCT attribute FROM responses) CROSS JOIN (SELECT DISTINCT certainty FROM responses)"),
    "j7_parent_child": (j7, PARTS + " SELECT c.object, c.part, round(c.x - p.x, 6) + 0 AS dx, round(c.y - p.y, 6) + 0 AS dy FROM parts c JOIN parts p ON c.object = p.object AND c.part = p.part + 1 WHERE c.visible = 1 AND p.visible = 1"),
    "j8_part_distances": (j8, PARTS + " SELECT c.part AS a, p.part AS b, round(avg(sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2)), 6) AS distance, count(*) AS n FROM parts c JOIN parts p ON c.object = p.object AND c.part < p.part WHERE c.visible = 1 AND p.visible = 1 GROUP BY 1, 2"),
    "j9_nearest_example": (j9, """WITH g AS (SELECT q.vec_id AS id, p.vec_id AS found, round(list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 9) AS g FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY g, found)::INT AS place, found, round(g, 6) AS distance FROM g) SELECT * FROM r WHERE place <= 3"""),
    "j9_nearest_in_class": (j9_class, """WITH g AS (SELECT q.vec_id AS id, p.vec_id AS found, round(list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 9) AS g FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id AND q.label = p.label WHERE q.vec_id % 100 = 0)
        SELECT id, found, round(g, 6) AS distance FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY g, found) = 1"""),
    "j10_nearest_centroid": (j10, PRED + "SELECT id, pred, round(distance, 6) AS distance FROM predictions"),
    "j11_class_scores": (j11, f"WITH centroids AS ({views.SQL['centroids']}), {FLAT} SELECT id AS example, c.class, round(sum(x * w), 6) + 0 AS score FROM flat JOIN centroids c USING (j) GROUP BY 1, 2"),
    "j14_question_pairs": (j14, LOG + """, s AS (SELECT *, last_value(CASE WHEN kind = 'view' THEN event_id END IGNORE NULLS) OVER w AS start_id, last_value(CASE WHEN kind = 'view' THEN question END IGNORE NULLS) OVER w AS sq, last_value(CASE WHEN kind = 'view' THEN at_ms END IGNORE NULLS) OVER w AS sa
        FROM log WINDOW w AS (PARTITION BY user_id ORDER BY at_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT event_id, user_id, question, start_id, coalesce(sq = question, false) AS matches, at_ms - sa AS ms, floor((at_ms - sa) / 1000)::BIGINT AS seconds FROM s WHERE kind = 'click'"""),
    "a3_click_medians": (a3, PARTS + ", s AS (SELECT part, seconds, row_number() OVER (PARTITION BY part ORDER BY seconds) AS i, count(*) OVER (PARTITION BY part) AS n FROM parts WHERE visible = 1) SELECT part, seconds AS median FROM s WHERE i = n // 2 + 1"),
    "a4_spatial_moments": (a4, PARTS + """, d AS (SELECT p.part AS parent, c.part, c.x - p.x AS dx, c.y - p.y AS dy FROM parts c JOIN parts p ON c.object = p.object AND c.part = p.part + 1 WHERE c.visible = 1 AND p.visible = 1),
        e AS (SELECT *, abs(dx - avg(dx) OVER (PARTITION BY part)) AS gx, abs(dy - avg(dy) OVER (PARTITION BY part)) AS gy FROM d)
        SELECT parent, part, count(*) AS n, round(avg(dx), 4) AS mean_x, round(avg(dy), 4) AS mean_y, round(var_pop(dx), 4) AS var_x, round(var_pop(dy), 4) AS var_y, round(max(gx), 4) AS gap_x, round(max(gy), 4) AS gap_y, round(least(10, 1 / (2 * var_pop(dx))), 8) AS weight_x FROM e GROUP BY 1, 2 HAVING count(*) >= 20"""),
    "a5_normalise": (a5, cte("prices") + " SELECT grp, item, round(weight / sum(weight) OVER (PARTITION BY grp), 6) AS p FROM prices"),
    "a7_entropy": (a7, cte("prices") + ", q AS (SELECT grp, weight / sum(weight) OVER (PARTITION BY grp) AS p FROM prices) SELECT grp, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) AS entropy FROM q GROUP BY 1"),
    "a9_confusion": (a9, PRED + "SELECT gt, pred, count(*) AS n FROM predictions GROUP BY 1, 2"),
    "a9_confusion_cube": (k9, "SELECT quality AS gt, toxic AS pred, count(*) AS n, grouping(quality, toxic)::INT AS level FROM labels GROUP BY CUBE (quality, toxic)"),
    "a12_mean_losses": (a12, PRED + "SELECT round(avg((gt <> pred)::INT::DOUBLE), 6) AS error, round(avg(CASE WHEN gt = pred THEN 0 WHEN abs(gt - pred) = 1 THEN 1 WHEN abs(gt - pred) <= 3 THEN 2 WHEN abs(gt - pred) <= 6 THEN 3 ELSE 4 END), 6) AS taxonomic, round(avg(CASE WHEN gt % 2 = 0 THEN distance END), 6) AS known FROM predictions"),
    "a13_test_summary": (a13, PRED + "SELECT round(avg((gt <> pred)::INT::DOUBLE), 6) AS loss, round(avg(distance * 0.5::DOUBLE + (gt <> pred)::INT), 6) AS slack, round(avg(distance * 0.5::DOUBLE + (gt <> pred)::INT) + 0.2::DOUBLE, 6) AS svm_error FROM predictions"),
    "a14_drag_losses": (a14, """WITH e AS (SELECT l_orderkey AS example, l_linenumber - 1 AS step, l_suppkey, max(l_discount) AS error FROM lineitem GROUP BY 1, 2, 3)
        SELECT s.step, round(coalesce(sum((error > 0.05::DOUBLE)::INT), 0) / (SELECT count(DISTINCT example) FROM e), 6) AS loss FROM (SELECT unnest(range(9))::INT AS step) s LEFT JOIN e USING (step) GROUP BY 1"""),
    "a15_pseudo_parts": (a15, PARTS + """, p AS (SELECT object, part % 2 AS pseudo, avg(CASE WHEN visible = 1 THEN x END) AS x, avg(CASE WHEN visible = 1 THEN y END) AS y, avg(CASE WHEN visible = 1 THEN seconds END) AS seconds, max(visible) AS v FROM parts GROUP BY 1, 2)
        SELECT object, pseudo, round(x, 6) AS x, round(y, 6) AS y, round(seconds, 6) AS seconds FROM p WHERE object NOT IN (SELECT object FROM p WHERE v = 0)"""),
    "a16_topological_order": (a16, """WITH RECURSIVE tree AS (SELECT 0 AS part, 0 AS depth UNION ALL SELECT n.n_nationkey, t.depth + 1 FROM nation n JOIN tree t ON (n.n_nationkey - 1) // 2 = t.part WHERE n.n_nationkey > 0) SELECT part, depth FROM tree"""),
    "a19_confusion_cost": (a19, CENT + ", g AS (SELECT a.class AS gt, b.class AS pred, sqrt(sum((a.w - b.w) ** 2)) AS d FROM centroids a JOIN centroids b USING (j) GROUP BY 1, 2) SELECT gt, pred, round(d / (SELECT max(d) FROM g), 6) AS cost FROM g"),
    "a20_center_sign": (a20, CENT + " SELECT class, j AS attribute, round(w - avg(w) OVER (PARTITION BY j), 6) + 0 AS centred, sign(w - avg(w) OVER (PARTITION BY j))::INT AS sign FROM centroids"),
    "a21_gram": (a21, CENT + " SELECT a.class AS class_a, b.class AS class_b, round(sum(a.w * b.w * (1 + j % 3)), 6) + 0 AS product FROM centroids a JOIN centroids b USING (j) GROUP BY 1, 2"),
    "a22_study_loss": (a22, LOG + " SELECT user_id, round(sum(CASE WHEN kind = 'view' THEN least(5, value % 4 + value / 45) ELSE 0 END), 6) AS loss FROM log GROUP BY 1"),
    "a26_best_response": (a26, cte("grid") + " SELECT y % 4 AS map, y, x, score FROM grid QUALIFY row_number() OVER (PARTITION BY y % 4 ORDER BY score DESC, y, x) = 1"),
    "w1_window_avg": (w1, TRACE + " SELECT iter, round(avg(error) OVER (ORDER BY iter ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS mean FROM t"),
    "w2_compaction": (w2, TRACE + " SELECT iter // 16 AS bin, round(avg(error), 6) AS mean, count(*) AS n FROM t GROUP BY 1"),
    "w3_stats": (w3, TRACE + " SELECT iter, row_number() OVER (PARTITION BY example ORDER BY iter)::INT AS visit, round(avg(error) OVER (PARTITION BY example ORDER BY iter ROWS UNBOUNDED PRECEDING), 9) AS mean_error FROM t"),
    "w4_cumulative_cdf": (w4, cte("prices") + " SELECT grp, item, sum(weight) OVER w AS running, round(sum(weight) OVER w / sum(weight) OVER (PARTITION BY grp), 6) AS share FROM prices WINDOW w AS (PARTITION BY grp ORDER BY item ROWS UNBOUNDED PRECEDING)"),
    "w5_feature_offsets": (w5, "SELECT p_partkey AS part, coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM part"),
    "w7_local_maxima": (w7, cte("grid") + " SELECT g.y, g.x, g.score FROM grid g WHERE NOT EXISTS (SELECT 1 FROM grid n WHERE abs(n.y - g.y) + abs(n.x - g.x) = 1 AND n.score >= g.score)"),
    "w9_downsample": (w9, "SELECT event_id AS iter, value AS error FROM events WHERE event_id % (SELECT greatest(1, (count(*) + 499) // 500) FROM events) = 0"),
    "w10_epsilon": (w10, TRACE + " SELECT iter, round(avg(error) OVER (ORDER BY iter ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) - dual / (iter + 1) + 0.25::DOUBLE, 9) AS epsilon FROM t"),
    "t2_pose_sort": (t2, PARTS + ", o AS (SELECT object, list_sort(list(DISTINCT part)) AS poses FROM parts GROUP BY 1) SELECT object, array_to_string(poses, ',') AS poses FROM o ORDER BY list_reverse(poses), object"),
    "t5_aspect_sort": (t5, cte("boxes") + " SELECT object, part, round(w / h, 6) AS ratio FROM boxes ORDER BY w / h, object, part"),
    "t7_hard_examples": (t7, "SELECT event_id AS example, CASE WHEN event_type <> 'error' THEN value END AS slack FROM events ORDER BY coalesce(slack, -1e7) DESC, event_id LIMIT 100"),
    "t10_paging": (t10, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200"),
    "t13_condense": (t13, "SELECT user_id AS example, event_id AS sample, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 20 AS kept FROM events WHERE value > 0"),
    "t15_shuffle": (t15, "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || '|3')"),
    "t16_exact_split": (t16, "SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || '|1'), doc_id) > 30)::INT AS split FROM documents"),
    "t17_weighted_pick": (t17, cte("prices") + ", c AS (SELECT grp, item, sum(weight) OVER (PARTITION BY grp ORDER BY item ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY grp) AS share FROM prices) SELECT grp, min(item) AS item FROM c WHERE share >= 0.5 GROUP BY 1"),
    "u1_timeline": (u1, "SELECT * FROM (SELECT user_id AS who, 'event' AS what, event_id AS n FROM events UNION ALL SELECT conv_id, 'turn', turn FROM conversations UNION ALL SELECT o_custkey, 'order', o_orderkey FROM orders)"),
    "u2_remaining_questions": (u2, LOG + " SELECT u.user_id, q.question FROM (SELECT DISTINCT user_id FROM log) u CROSS JOIN (SELECT DISTINCT question FROM log) q WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.user_id = u.user_id AND l.question = q.question)"),
    "u3_exclusion": (u3, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "u4_concatenate": (u4, f"WITH {FLAT} SELECT id, j AS i, round(x, 6) + 0 AS v FROM flat WHERE x <> 0"),
    "u6_flatten": (u6, PARTS + " SELECT object, part, visible FROM parts WHERE part <> 2"),
    "s_string_paths": (s_paths, r"""SELECT page_id, split_part(url, '/', -1) AS file, regexp_replace(url, '/[^/]*$', '') AS folder, CASE WHEN contains(split_part(url, '/', -1), '.') THEN split_part(split_part(url, '/', -1), '.', -1) ELSE '' END AS ext,
        regexp_replace(url, '\.[^./]*$', '') AS bare, NOT regexp_matches(split_part(url, '/', -1), '[/\\~]') AS safe, replace(url, 'e', '3') AS everywhere, regexp_replace(url, 'e', '3') AS once FROM pages"""),
    "s_split_tokens": (s_tokens, "SELECT page_id, len(t)::INT AS n, array_to_string(t, '|') AS tokens FROM (SELECT page_id, list_filter(regexp_split_to_array(url, '[/.?&=]+'), lambda x: x <> '') AS t FROM pages)"),
    "s_common_prefix": (s_prefix, "SELECT s_nationkey, max(p) AS prefix FROM (SELECT a.s_nationkey, left(a.s_name, n) AS p FROM (SELECT s_nationkey, min(s_name) AS s_name FROM supplier GROUP BY 1) a CROSS JOIN (SELECT unnest(range(0, 40)) AS n) WHERE n <= length(a.s_name) AND NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND left(b.s_name, n) <> left(a.s_name, n))) GROUP BY 1"),
    "s_math": (s_math, """SELECT c_custkey, sign(c_acctbal) * floor(abs(c_acctbal) + 0.5::DOUBLE) AS rounded, round(1 / (1 + exp(-c_acctbal / 5000)), 6) AS sigmoid, round(least(greatest(c_acctbal, 0), 5000), 6) AS clamped,
        (CASE WHEN c_nationkey - 3 > 12.5 THEN c_nationkey - 28 WHEN c_nationkey - 3 < -12.5 THEN c_nationkey + 22 ELSE c_nationkey - 3 END)::INT AS turn, round(log2(abs(c_acctbal) + 1), 6) AS log2 FROM customer"""),
    "s_distances": (s_distances, f"""WITH {FLAT} SELECT a.id, round(sum((a.x - b.x) ** 2), 6) AS l2sq, round(sqrt(sum((a.x - b.x) ** 2)), 6) AS l2, round(sum(abs(a.x - b.x)), 6) AS l1,
        round(sum(CASE WHEN abs(a.x) + abs(b.x) <> 0 THEN (abs(a.x) - abs(b.x)) ** 2 / (abs(a.x) + abs(b.x)) ELSE 0 END), 6) AS chi2, round(sum(a.x * b.x), 6) + 0 AS dot, round(sum(a.x * a.x), 6) AS sqr FROM flat a JOIN flat b ON b.id = a.id + 1 AND a.j = b.j GROUP BY 1"""),
    "s_sparse_dot": (s_sparse, f"""WITH {FLAT} SELECT a.id, round(sum(CASE WHEN a.x > 0.05::DOUBLE AND b.x > 0.05::DOUBLE THEN a.x * b.x ELSE 0 END), 6) AS dot, sum((a.x > 0.05::DOUBLE AND b.x > 0.05::DOUBLE)::INT)::INT AS shared, sum((a.x > 0.05::DOUBLE OR b.x > 0.05::DOUBLE)::INT)::INT AS either FROM flat a JOIN flat b ON b.id = a.id + 1 AND a.j = b.j GROUP BY 1"""),
    "s_unit_vectors": (s_unit, f"""WITH {FLAT}, q AS (SELECT id, sqrt(sum(x * x)) AS n, sqrt(sum(abs(x))) AS r, min(x) AS low, max(x) AS high FROM flat GROUP BY 1),
        c AS (SELECT id, sqrt(sum(least(x / n, 0.2::DOUBLE) ** 2)) AS m FROM flat JOIN q USING (id) GROUP BY 1)
        SELECT id, round(x / n, 6) + 0 AS unit, round(sign(x) * sqrt(abs(x)) / r, 6) + 0 AS power, round(least(x / n, 0.2::DOUBLE) / m, 6) + 0 AS clipped, round((x - low) / (high - low), 6) AS minmax
        FROM flat JOIN q USING (id) JOIN c USING (id) WHERE j = 0"""),
    "s_json": (s_json, """SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, '{"id":' || event_id || ',"k":' || json_extract_string(props, '$.k') || '}' AS json FROM events"""),
    "s_answer_codec": (s_answer, "SELECT event_id, (event_id % 2)::INT AS answer, (event_id % 4)::INT AS certainty, round(value, 2) AS seconds FROM events"),
    "s_taxonomic_loss": (s_taxonomy, """SELECT c_nationkey, sum(CASE WHEN c_custkey = s_suppkey THEN 0 WHEN c_nationkey = s_nationkey THEN 1 WHEN n.n_regionkey = m.n_regionkey THEN 2 WHEN abs(n.n_regionkey - m.n_regionkey) = 1 THEN 3 ELSE 4 END)::BIGINT AS loss, count(*) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation n ON c_nationkey = n.n_nationkey JOIN nation m ON s_nationkey = m.n_nationkey GROUP BY 1"""),
    "s_iou": (s_iou, cte("boxes") + """, p AS (SELECT a.object, a.part, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS s, a.w * a.h + b.w * b.h AS u FROM boxes a JOIN boxes b ON a.object = b.object AND b.part = a.part + 1)
        SELECT object, part, round(s / (u - s), 6) AS iou FROM p"""),
    "m2_kmeans_step": (m2, PRED + "SELECT pred AS cluster, j, round(avg(x), 6) + 0 AS value FROM predictions JOIN flat USING (id) GROUP BY 1, 2"),
    "m6_tree_assign": (m6, """WITH a AS (SELECT vec_id AS id, embedding, 1 + (embedding[1] > 0)::INT AS n FROM embeddings),
        b AS (SELECT *, 2 * n + 1 + (embedding[n + 1]::DOUBLE + 0.01::DOUBLE * n > 0)::INT AS m FROM a) SELECT id, (2 * m + 1 + (embedding[m + 1]::DOUBLE + 0.01::DOUBLE * m > 0)::INT - 7)::INT AS leaf FROM b"""),
    "m6_tree_fit": (m6_fit, None),
    "m7_em_step": (m7, f"""WITH f AS (SELECT vec_id AS id, j, embedding[j + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(64))::INT AS j)),
        c AS (SELECT k::INT AS component, j::INT AS j, 0.02::DOUBLE * (k + 1) * (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) AS mu FROM (SELECT unnest(range(3)) AS k), (SELECT unnest(range(64)) AS j)),
        z AS (SELECT id, component, -0.5::DOUBLE * sum((x - mu) ** 2 / 0.5::DOUBLE) AS z FROM f JOIN c USING (j) GROUP BY 1, 2),
        r AS (SELECT id, component, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM z), g AS (SELECT id, component, e / sum(e) OVER (PARTITION BY id) AS g FROM r)
        SELECT component, j, round(sum(g * x) / sum(g), 6) + 0 AS mu, round(sum(g * x * x) / sum(g) - (sum(g * x) / sum(g)) ** 2, 6) AS var, round(sum(g) / (SELECT count(*) FROM embeddings), 6) AS weight FROM g JOIN f USING (id) GROUP BY 1, 2"""),
    "m8_pca_cov": (m8, f"WITH {FLAT} SELECT p.j AS a, q.j AS b, round(covar_samp(p.x, q.x), 6) + 0 AS cov FROM flat p JOIN flat q ON p.id = q.id AND p.j <= q.j GROUP BY 1, 2"),
    "m9_fisher_vector": (m9, f"""WITH f AS (SELECT vec_id AS id, label AS image, j, embedding[j + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(64))::INT AS j)),
        c AS (SELECT k::INT AS component, j::INT AS j, 0.02::DOUBLE * (k + 1) * (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) AS mu FROM (SELECT unnest(range(3)) AS k), (SELECT unnest(range(64)) AS j)),
        z AS (SELECT id, component, -0.5::DOUBLE * sum((x - mu) ** 2 / 0.5::DOUBLE) AS z FROM f JOIN c USING (j) GROUP BY 1, 2),
        r AS (SELECT id, component, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM z), g AS (SELECT id, component, e / sum(e) OVER (PARTITION BY id) AS g FROM r)
        SELECT image::BIGINT AS image, component, j, round(sum(g * (x - mu) / sqrt(0.5::DOUBLE)) / (count(*) * sqrt(1 / 3::DOUBLE)), 6) + 0 AS d_mu, round(sum(g * ((x - mu) ** 2 / 0.5::DOUBLE - 1)) / (count(*) * sqrt(2 / 3::DOUBLE)), 6) + 0 AS d_sigma FROM f JOIN c USING (j) JOIN g USING (id, component) GROUP BY 1, 2, 3"""),
    "m10_bow_hist": (m10, PRED + "SELECT id % 7 AS image, pred AS word, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY id % 7), 6) AS share FROM predictions GROUP BY 1, 2"),
    "m11_pyramid": (m11, """WITH c AS (SELECT l_suppkey % 5 AS image, l_partkey % 40 AS y, l_orderkey % 64 AS x, l_returnflag AS word FROM lineitem), v AS (SELECT *, (2 ** level)::INT AS side FROM c CROSS JOIN (SELECT unnest(range(3))::INT AS level))
        SELECT image, level, ((y * side) // 40 * side + (x * side) // 64)::INT AS cell, word, count(*) AS n FROM v GROUP BY 1, 2, 3, 4"""),
    "m14_nms": (m14, cte("boxes").replace("WITH", "WITH RECURSIVE", 1) + """, b AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY score DESC, part) AS k FROM boxes),
        r AS (SELECT object, k, [{'part': part, 'x': x, 'y': y, 'w': w, 'h': h}] AS kept FROM b WHERE k = 1
          UNION ALL SELECT b.object, b.k, CASE WHEN len(list_filter(r.kept, lambda q:
            greatest(least(q.x + q.w, b.x + b.w) - greatest(q.x, b.x), 0) * greatest(least(q.y + q.h, b.y + b.h) - greatest(q.y, b.y), 0)
            > 0.1::DOUBLE * (q.w * q.h + b.w * b.h - greatest(least(q.x + q.w, b.x + b.w) - greatest(q.x, b.x), 0) * greatest(least(q.y + q.h, b.y + b.h) - greatest(q.y, b.y), 0)))) > 0
            THEN r.kept ELSE list_append(r.kept, {'part': b.part, 'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}) END FROM r JOIN b ON b.object = r.object AND b.k = r.k + 1),
        ends AS (SELECT object, arg_max(kept, k) AS kept FROM r GROUP BY 1)
        SELECT object, unnest(list_transform(kept, lambda q: q.part))::BIGINT AS part FROM ends"""),
    "m24_multiclass_argmax": (m24, f"""WITH centroids AS ({views.SQL["centroids"]}), {FLAT}, s AS (SELECT id, f.class AS gt, c.class, round(sum(x * w) + (f.class <> c.class)::INT, 9) AS s FROM flat f JOIN centroids c USING (j) GROUP BY 1, 2, 3)
        SELECT id AS example, class, round(s, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, class) = 1"""),
    "x3_sgd_step": (x3, f"""WITH centroids AS ({views.SQL["centroids"]}), {FLAT}, g AS (SELECT j, sum(x) / (SELECT count(DISTINCT id) FROM flat WHERE x > 0) / 0.05::DOUBLE AS g FROM flat WHERE x > 0 GROUP BY 1)
        SELECT j AS index, round(w * 0.8::DOUBLE + coalesce(g, 0), 6) AS value FROM centroids LEFT JOIN g USING (j) WHERE class = 0"""),
    "x4_dual_step": (x4, """WITH s AS (SELECT event_id AS example, value % 1 AS alpha, value - 10 AS slack, (event_id % 5)::DOUBLE AS sqr FROM events),
        t AS (SELECT *, least(greatest(CASE WHEN sqr > 0 THEN alpha + slack / sqr ELSE alpha END, 0), 1) AS a FROM s) SELECT example, round(a, 6) AS new_alpha, round(a - alpha, 6) + 0 AS change FROM t"""),
    "x5_recompute_weights": (x5, f"WITH {FLAT} SELECT j AS index, round(sum(x * (id % 10) / 10), 6) + 0 AS value FROM flat GROUP BY 1"),
    "x7_current_examples": (x7, """SELECT seq, example, value FROM (SELECT event_id AS seq, user_id AS example, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events) WHERE i = 1 AND event_type <> 'error'"""),
    "x13_evict_sessions": (x13, """SELECT c_custkey AS session FROM customer ORDER BY (c_nationkey % 3 <> 0)::INT, c_custkey * 7919 % 1009, c_custkey LIMIT (SELECT greatest(count(*) - 100, 0) FROM customer)"""),
    "x15_fold_log": (x15, LOG + " SELECT user_id, count(*) AS n, count(*) FILTER (kind = 'click') AS clicks, count(DISTINCT question) AS questions, floor((max(at_ms) - min(at_ms)) / 1000)::BIGINT AS seconds FROM log GROUP BY 1"),
    "session_windows": (gaps, LOG + """, g AS (SELECT user_id, at_ms, CASE WHEN at_ms - lag(at_ms) OVER (PARTITION BY user_id ORDER BY at_ms) < 10800000 THEN 0 ELSE 1 END AS s FROM log), h AS (SELECT user_id, at_ms, sum(s) OVER (PARTITION BY user_id ORDER BY at_ms) AS s FROM g)
        SELECT user_id, min(at_ms) AS first_at, max(at_ms) AS last_at, count(*) AS n FROM h GROUP BY user_id, s"""),
    "r11_scatter_add": (r1, TRACE + ", a AS (SELECT iter AS index, error AS value FROM t UNION ALL SELECT iter % 20 * 10 + iter % 10, dual FROM t) SELECT index, round(sum(value), 6) AS value FROM a GROUP BY 1"),
    "s18_sampled_frames": (s18, "SELECT event_id AS frame, user_id FROM events WHERE event_id % 30 = 29"),
    "k11_detection_text": (k11, cte("boxes") + " SELECT 'o' || object AS name, count(*) AS n, round(max(score), 6) AS score, round(sum((x + w) - x), 3) AS width FROM boxes GROUP BY 1"),
}
