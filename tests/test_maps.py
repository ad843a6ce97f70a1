"""Maps as rows, part models, requests by method."""

import json

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import grids, maps, parts_model
from tessella.streaming.rpc import Methods, Snapshots, definitions


def table(spark, arrays):
    rows = [(i, a.shape[0], a.shape[1], a.shape[2] if a.ndim > 2 else 1, a.ravel().tolist()) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, maps.MAP)


def back(df):
    return {r.id: np.array(r["values"]).reshape((r.height, r.width, r.channels) if r.channels > 1 else (r.height, r.width)) for r in df.collect()}


def test_kernels_over_rows(spark):
    rng = np.random.default_rng(0)
    arrays = [rng.random((8, 10)), rng.random((12, 9))]
    df = table(spark, arrays)
    assert np.allclose(back(maps.spread(df, (0.1, 0.0), (0.2, 0.3)))[1], grids.distance_transform_2d(arrays[1], (0.1, 0.0), (0.2, 0.3))[0])
    assert np.allclose(back(maps.flipped(df))[0], arrays[0][:, ::-1])
    assert back(maps.bordered(df, 2))[0].shape == (12, 14)
    assert np.allclose(back(maps.filtered(df, np.full((3, 3), 1 / 9)))[0][1:-1, 1:-1][0, 0], arrays[0][:3, :3].mean())
    assert back(maps.histograms(df, 4, 6))[0].shape == (2, 2, 6)
    assert np.allclose(back(maps.detected(df, arrays[0][:2, :3]))[0][0, 0], (arrays[0][:2, :3] ** 2).sum())
    assert back(maps.resized(df, 4, 5))[1].shape == (4, 5) and back(maps.probability_maps(df))[0].max() == 1
    assert back(maps.patterns(df))[0].shape == (6, 8)
    colour = table(spark, [np.array([[[255.0, 255.0, 255.0], [0.0, 0.0, 0.0]]])])
    assert np.allclose(back(maps.lab(colour))[0], [[[100, 0, 0], [0, 0, 0]]], atol=0.1)
    assert np.allclose(back(maps.channel(colour, 1))[0], [[255, 0]])


def test_cells_and_maxima(spark):
    rng = np.random.default_rng(1)
    a = rng.permutation(60).reshape(6, 10).astype(float)
    df = table(spark, [a])
    cells = maps.cells(df)
    best = maps.best_responses(cells, "id").first()
    assert (best.y, best.x) == np.unravel_index(a.argmax(), a.shape)
    found = maps.diverse_maxima(df, 5, 2.0, 10.0).collect()
    assert [r.value for r in found] == sorted((r.value for r in found), reverse=True) and found[0].value == 59
    assert all((p.y - q.y) ** 2 + (p.x - q.x) ** 2 > 4 for p in found for q in found if p.place < q.place)
    drawn = maps.sampled_cells(cells, 400, 0.2).collect()
    assert len(drawn) == 400
    mass = np.exp(0.2 * (a - a.max()))
    share = np.mean([a[r.y, r.x] >= 55 for r in drawn])
    assert abs(share - mass[a >= 55].sum() / mass.sum()) < 0.1
    soft = maps.with_evidence(cells.withColumn("part", F.lit(1)), spark.createDataFrame([(0, 1, 3.0, 2.0)], "id long, part int, x double, y double"), 1.0, 50.0, 50.0)
    top = maps.best_responses(soft, "id").first()
    assert (top.y, top.x) == (2, 3)
    given = spark.createDataFrame([(0, 1, 4, 4)], "id long, part int, y int, x int")
    assert maps.placed_only(cells.withColumn("part", F.lit(1)), given).count() == 1
    prior = maps.with_priors(cells, 1.0, {0: 1000.0}, 1, 6, 10)
    top = maps.best_responses(prior, "id").first()
    assert top.y < 3 and top.x < 5


def test_trees_over_rows(spark):
    rng = np.random.default_rng(2)
    unary = {p: rng.normal(size=(4, 5)) for p in (1, 2)}
    springs = {2: (1, 0, (0.1, 0.0), (0.3, 0.2))}
    df = spark.createDataFrame([(7, p, 4, 5, a.ravel().tolist()) for p, a in unary.items()], "id long, part int, height int, width int, values array<double>")
    got = {r.part: (r.y, r.x, r.score) for r in maps.infer_trees(df, {1: [2]}, springs, 1).collect()}
    score, places = grids.tree_max_sum(unary, {1: [2]}, springs, 1)
    assert {p: got[p][:2] for p in got} == places and abs(got[1][2] - score) < 1e-9


def test_part_models(spark):
    w = spark.createDataFrame([("part", 1, [1.0, 2.0]), ("attribute", 0, [5.0]), ("part", 0, [3.0])], "kind string, owner int, values array<double>")
    flat = parts_model.flattened_weights(w, ["part", "attribute"])
    assert [r.value for r in flat.orderBy("index").collect()] == [3.0, 1.0, 2.0, 5.0]
    assert sorted(map(str, parts_model.restored_weights(flat).collect())) == sorted(map(str, w.collect()))
    t = spark.createDataFrame([(1, 2, 0, 5.0, 1.0, 0.5), (1, 2, 1, 7.0, 2.0, 0.9), (2, 3, 0, 1.0, 1.0, 0.1)], "parent int, child int, transition int, dx double, dy double, weight double")
    places = {r.part: (r.x, r.y) for r in parts_model.ideal_places(spark, parts_model.best_offsets(t), 1, 10.0, 10.0, 2.0).collect()}
    assert places == {1: (10.0, 10.0), 2: (24.0, 14.0), 3: (26.0, 16.0)}
    pairs = spark.createDataFrame([(3.0, 1.0, 1.0, 1.0, 7, 0)], "dx double, dy double, ideal_x double, ideal_y double, rotation int, parent_rotation int")
    row = parts_model.pairwise_features(pairs).select("features", parts_model.pairwise_score(F.col("features"), F.array(*[F.lit(1.0)] * 5)).alias("s")).first()
    assert row.features == [-2.0, 0.0, -4.0, 0.0, -1.0] and row.s == -7.0
    poses = spark.createDataFrame([("p", 1, 2.0, 3.0)], "pose string, part int, dx double, dy double")
    assert [tuple(r) for r in parts_model.mirrored(poses, spark.createDataFrame([(1, 4)], "part int, twin int")).collect()] == [("p", 1, 2.0, 3.0), ("p_flipped", 4, -2.0, 3.0)]
    objects = spark.createDataFrame([(1, 1, 1.0, 1.0, 1), (1, 2, 4.0, 6.0, 1), (2, 1, 0.0, 0.0, 1)], "object int, part int, x double, y double, visible int")
    pivot = objects.where("part = 1").select("object", F.col("x").alias("px"), F.col("y").alias("py"))
    assert {r.id: r.vector for r in parts_model.offset_vectors(objects, pivot, -9.0).collect()} == {1: [0.0, 0.0, 3.0, 5.0], 2: [0.0, 0.0, -9.0, -9.0]}
    scores = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, -1.0)], "example int, gt int, attribute int, s double")
    weights = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 0.4), (1, 1, 0.1)], "class int, attribute int, w double")
    assert parts_model.attribute_class_inference(scores, weights).first()["class"] == 1
    cost = spark.createDataFrame([(0, 0, 0.5)], "gt int, pred int, cost double")
    assert parts_model.attribute_class_inference(scores, weights, cost).first()["class"] == 0


def test_methods(spark):
    m = Methods()
    m.register("echo", lambda df: df.withColumn("result", F.col("request.session_id")), "says the session's name")
    assert m.usage() == {"echo": "says the session's name"} and m.find("none") is None
    lines = spark.createDataFrame([('{"id":"1","method":"echo","session_id":"s"}',), ('{"id":"2","method":"nope"}',), ("garbage{",)], "value string")
    got = [json.loads(r.value) for r in m.dispatch(lines).collect()]
    assert {g.get("id"): g.get("result") or g.get("error") for g in got} == {"1": "s", "2": "unknown method nope", None: "parse error"}
    assert m.unregister("echo") and not m.unregister("echo")
    assert list(definitions({"a": spark.range(1), "b": spark.range(1)}, {"a": True})) == ["a"]
    said = []
    s = Snapshots(lambda n, t: said.append((n, t)), 10, 2)
    for t in (1, 11, 15, 25, 90):
        s.tick(t)
    assert said == [(0, 11), (1, 25), (2, 90)]
