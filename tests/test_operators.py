"""Operators against brute force and by their properties."""

import itertools
import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from tessella.functions import numbers, strings
from tessella.functions import vectors as vec
from tessella.operators import boxes, evaluation, game, grids, joins, learning, response_model, windows
from tessella.operators import vectors as ml


def vectors(spark, n=200, d=3, k=3, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(k, d)) * 4
    label = rng.integers(0, k, n)
    x = centre[label] + rng.normal(size=(n, d))
    return x, label, spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(n)], "id long, vector array<double>, label int")


@settings(max_examples=60, deadline=None)
@given(some.lists(some.floats(-20, 20), min_size=1, max_size=25), some.floats(-2, 2), some.floats(0.01, 3))
def test_distance_transform(values, linear, quadratic):
    score = np.array(values)
    n = len(score)
    best, source = grids.distance_transform(score, linear, quadratic)
    want = [max(score[q] - linear * (q - p) - quadratic * (q - p) ** 2 for q in range(n)) for p in range(n)]
    assert np.allclose(best, want)
    step = source - np.arange(n)
    assert np.allclose(score[source] - linear * step - quadratic * step**2, best)


def test_tree_inference():
    rng = np.random.default_rng(1)
    unary = {p: rng.normal(size=(4, 5)) for p in "abc"}
    springs = {"b": (1, 0, (0.1, 0.0), (0.3, 0.2)), "c": (0, -1, (0.0, 0.2), (0.1, 0.4))}
    score, places = grids.tree_max_sum(unary, {"a": ["b"], "b": ["c"]}, springs, "a")
    cells = list(itertools.product(range(4), range(5)))

    def link(child, parent, at):
        dy, dx, linear, quadratic = springs[child]
        y, x = min(max(parent[0] + dy, 0), 3), min(max(parent[1] + dx, 0), 4)
        gy, gx = at[0] - y, at[1] - x
        return -linear[1] * gy - quadratic[1] * gy**2 - linear[0] * gx - quadratic[0] * gx**2

    total = lambda a, b, c: unary["a"][a] + unary["b"][b] + unary["c"][c] + link("b", a, b) + link("c", b, c)
    best = max(total(a, b, c) for a in cells for b in cells for c in cells)
    assert math.isclose(score, best) and math.isclose(total(places["a"], places["b"], places["c"]), best)


def test_image_kernels():
    image = np.zeros((9, 9))
    # one cell above all: each of its neighbours sees it, from the other side
    image[4, 4] = 1
    code, weight = grids.binary_patterns(image)
    seen = {(4, 3): 0, (5, 3): 1, (5, 4): 2, (5, 5): 3, (4, 5): 4, (3, 5): 5, (3, 4): 6, (3, 3): 7}
    assert {(y, x): int(code[y, x]) for y, x in zip(*np.nonzero(weight))} == seen and not code[weight == 0].any()
    # a ramp has several neighbours above each cell
    assert not grids.binary_patterns(np.arange(100.0).reshape(10, 10))[1].any()
    assert not grids.binary_patterns(np.ones((2, 5)))[1].any()
    cells = grids.oriented_histograms(np.random.default_rng(0).random((16, 24)), 8, 9)
    assert cells.shape == (2, 3, 9) and np.allclose(np.linalg.norm(cells, axis=2), 1)
    template = cells[:1, :2]
    scores = grids.slide(cells, template)
    assert scores.shape == (2, 2) and np.isclose(scores[0, 0], (template**2).sum())
    assert grids.min_max(np.array([2.0, 4.0])).tolist() == [0.0, 1.0]


def plain_suppress(rows, overlap):
    left = sorted(rows, key=lambda r: (-r[6], r[1]))
    kept = []
    for r in left:
        if all(plain_iou(r, k) <= overlap for k in kept):
            kept.append(r)
    return {(r[0], r[1]) for r in kept}


def plain_iou(a, b):
    w = max(0.0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
    h = max(0.0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
    union = a[4] * a[5] + b[4] * b[5] - w * h
    return w * h / union if union > 0 else 0.0


def test_suppression(spark, monkeypatch):
    monkeypatch.setattr(boxes, "MANY", 9)
    rng = np.random.default_rng(2)
    rows = [(o, p, *(float(v) for v in rng.integers(0, 30, 2)), *(float(v) for v in rng.integers(1, 30, 2)), float(rng.integers(0, 5))) for o in range(30) for p in range(int(rng.integers(1, 15)))]
    df = spark.createDataFrame(rows, "object long, part long, x double, y double, w double, h double, score double")
    once = boxes.suppress(df, 0.3)
    want = set().union(*(plain_suppress([r for r in rows if r[0] == o], 0.3) for o in range(30)))
    assert {(r.object, r.part) for r in once.collect()} == want
    assert boxes.suppress(once, 0.3).count() == len(want)


def test_kmeans_error_falls_and_finds_clusters(spark):
    x, label, df = vectors(spark, seed=4)
    centres, error = ml.kmeans(df, 3, restarts=3, seed=1)
    gap = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert np.isclose(error, gap.min(1).sum())
    placed = {r.id: r.cluster for r in joins.assign(df, [(i, c.tolist()) for i, c in enumerate(centres)]).collect()}
    agree = [np.bincount(label[[i for i in placed if placed[i] == c]]).max() for c in range(3)]
    assert sum(agree) > 180


def test_mixture_likelihood_rises(spark):
    _, _, df = vectors(spark, seed=5)
    mu, var, weight, trace = ml.mixture(df, 3, rounds=6)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(trace))
    assert np.isclose(weight.sum(), 1) and (var > 0).all()


def test_principal_components(spark):
    x, _, df = vectors(spark, d=4, seed=6)
    mean, components, variance = ml.principal_components(df, 2)
    assert np.allclose(mean, x.mean(0))
    value = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(variance, value[:2])
    flat = np.array([r.vector for r in ml.projected(df, mean, components).orderBy("id").collect()])
    assert np.allclose(flat.var(0, ddof=1), value[:2])


def test_hierarchy(spark):
    _, _, df = vectors(spark, k=4, seed=8)
    planes = ml.hierarchical(df, 2)
    leaves = {r.leaf for r in ml.tree_assign(df, planes, 2).collect()}
    assert leaves <= {0, 1, 2, 3} and len(leaves) >= 3


def test_hierarchy_takes_all_points(spark):
    # 30,000 points by formula at 0, 1 and few at 1000, any one of which a sample may lack
    spot = F.when(F.col("id") == 29_999, 1000.0).otherwise((F.col("id") % 2).cast("double"))
    df = spark.range(30_000).repartition(5).select("id", F.array(spot, F.lit(0.0)).alias("vector"))
    planes = ml.hierarchical(df, 2)
    counts = {r.leaf: r["count"] for r in ml.tree_assign(df, planes, 2).groupBy("leaf").count().collect()}
    assert sorted(counts.values()) == [1, 14_999, 15_000]
    assert (planes == ml.hierarchical(df.repartition(3), 2)).all()
    # centres are the means of all points of either side
    x = np.arange(30_000) % 2 * 1.0
    mean = x[:-1].mean()
    assert np.isclose(abs(planes[0, 0]), 2 * (1000 - mean)) and np.isclose(abs(planes[0, -1]), 1000**2 - mean**2)
    assert ml.hierarchical(df.limit(0), 2).shape == (3, 1)


def test_nearest_with_ties(spark):
    points = spark.createDataFrame([(i, [float(i % 4)], i % 2) for i in range(20)], "id long, vector array<double>, class int")
    got = joins.nearest(points.where("id < 4"), points.repartition(5), 3).collect()
    for q in range(4):
        want = sorted((((i % 4) - q) ** 2, i) for i in range(20) if i != q)[:3]
        assert [(r.distance, r.found) for r in sorted((r for r in got if r.id == q), key=lambda r: r.place)] == [(float(a), b) for a, b in want]


def responses(spark, n=40, classes=4, attributes=6, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.random((classes, attributes))
    rows = []
    for e in range(n):
        c = int(rng.integers(classes))
        rows += [(e, c, a, int(rng.random() < p[c, a]), int(rng.integers(4)), float(rng.random() + 0.5)) for a in range(attributes)]
    return rows, spark.createDataFrame(rows, "example long, class int, attribute int, answer int, certainty int, seconds double")


def test_game_against_plain_loop(spark):
    rows, df = responses(spark)
    model = response_model.response_model(df)
    table = {(r["class"], r.attribute, r.certainty): (r.p, r.weight) for r in model.collect()}
    told = {(e, a): (y, k, s) for e, _, a, y, k, s in rows}
    history = {(r.session, r["round"]): r for r in game.play(df, model, rounds=4).collect()}

    def like(c, a, y, k):
        p, w = table[c, a, k]
        q = p if y else 1 - p
        return q**w if q > 0 else 0.0

    def entropy(p):
        return -sum(v * math.log(v) for v in p if v > 0)

    for e, truth in {(r[0], r[1]) for r in rows if r[0] < 8}:
        prior, asked = [0.25] * 4, []
        for step in range(1, 5):
            gains = []
            for a in range(6):
                if a in asked:
                    continue
                after = mass = 0.0
                for k in range(4):
                    for y in (0, 1):
                        u = [prior[c] * like(c, a, y, k) for c in range(4)]
                        if sum(u):
                            after += sum(u) * entropy([v / sum(u) for v in u])
                            mass += sum(u)
                gains.append((-round(entropy(prior) - after / mass, 9), a))
            best = min(gains)[1]
            asked.append(best)
            y, k, _ = told[e, best]
            prior = [prior[c] * like(c, best, y, k) for c in range(4)]
            prior = [v / sum(prior) for v in prior]
            row = history[e, step]
            assert row.question == best and math.isclose(row.true_p, prior[truth], rel_tol=1e-9)


def test_game_stops_early_and_carries_on(spark):
    _, df = responses(spark, n=20)
    model = response_model.response_model(df)
    history = game.play(df, model, rounds=6, stop_early=True)
    accuracy = {r["round"]: r.accuracy for r in game.accuracy_by_round(history, 1, 6).collect()}
    assert accuracy[6] >= accuracy[1] and len(accuracy) == 7
    last = game.play(df, model, rounds=6, select="order").groupBy("session").agg(F.max("round").alias("n")).collect()
    assert {r.n for r in last} == {6}


def test_posteriors_sum_to_one(spark):
    _, df = responses(spark)
    model = response_model.response_model(df)
    post = game.posterior(df.select(F.col("example").alias("session"), "attribute", "answer", "certainty"), model)
    assert all(math.isclose(r.total, 1.0) for r in post.groupBy("session").agg(F.sum("p").alias("total")).collect())
    weights = response_model.certainty_weights(not_visible=1)
    assert weights[1] == 0 and max(weights) == 1


def test_learner_objective_falls(spark):
    _, label, df = vectors(spark, seed=9)
    learner = learning.Learner(3, 0.1).train(df, 60)
    told = {r.id: r.label for r in learner.predict(df).collect()}
    assert np.mean([told[i] == label[i] for i in told]) > 0.85
    assert learner.objective(df) < learner.trace[0]


def test_trailing_mean_in_blocks(spark):
    values = np.random.default_rng(0).random(257)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "iter long, error double")
    got = {r.iter: r["mean"] for r in windows.bucketed_trailing_mean(df, "error", "iter", 50).collect()}
    assert all(math.isclose(got[i], values[max(0, i - 49) : i + 1].mean()) for i in range(257))


def test_calibration_and_line_search(spark):
    assert math.isclose(evaluation.line_search(lambda g: (math.log(g) - 1) ** 2), math.e, rel_tol=1e-3)
    rng = np.random.default_rng(1)
    rows = []
    for e in range(300):
        s = rng.normal(size=3)
        p = np.exp(3 * s) / np.exp(3 * s).sum()
        t = int(rng.choice(3, p=p))
        rows += [(e, c, t, float(s[c])) for c in range(3)]
    gamma = evaluation.calibrate(spark.createDataFrame(rows, "example long, class int, gt int, score double"))
    assert 2 < gamma < 4.5


def test_spanning_tree():
    pairs = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 2.0), (1, 4, 9.0)]
    assert sorted(joins.spanning_tree(pairs, {1: 9, 2: 5, 3: 5, 4: 1})) == [(1, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize(("path", "base", "want"), [("a/b/c", "a/d", "../b/c"), ("a/b", "a/b", ""), ("x/y", "z", "../x/y")])
def test_relative_path(spark, path, base, want):
    df = spark.createDataFrame([(path, base)], "p string, b string")
    assert df.select(strings.relative_path(F.col("p"), F.col("b")).alias("r")).first().r == want


def test_corrections_and_turns(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.05), (2, 1, 0.01)], "example long, part long, error double")
    got = [(r.example, r.step, r.part) for r in evaluation.correct_worst(df, 0.1, 5).orderBy("step").collect()]
    assert got == [(1, 1, 2), (1, 2, 1)]
    x, y = numbers.rotate(F.lit(1.0), F.lit(0.0), F.lit(math.pi / 2), F.lit(2.0), F.lit(1.0), F.lit(0.0))
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert math.isclose(row.x, 1.0, abs_tol=1e-12) and math.isclose(row.y, 2.0)


def test_unit_vectors_take_one_pass(spark):
    """The length is worked out once a vector: by the component, as it was, these would take minutes."""
    x = np.random.default_rng(2).normal(size=512)
    df = spark.createDataFrame([(0, x.tolist()), (1, [0.0, 0.0]), (2, [3.0, 3.0]), (3, []), (4, None)], "id long, v array<double>")
    began = time.perf_counter()
    got = df.orderBy("id").select(*[f(F.col("v")).alias(n) for n, f in (("unit", vec.unit), ("power", vec.power_unit), ("clipped", vec.clipped_unit), ("minmax", vec.min_max))]).collect()
    assert time.perf_counter() - began < 30
    unit = lambda v: v / np.sqrt((v * v).sum())
    want = [unit(x), unit(np.sign(x) * np.sqrt(np.abs(x))), unit(np.minimum(unit(x), 0.2)), (x - x.min()) / (x.max() - x.min())]
    assert all(np.allclose(a, b, rtol=1e-12) for a, b in zip(got[0], want))
    assert list(got[1]) == [[0.0, 0.0]] * 4 and got[2].minmax == [0.0, 0.0]
    assert list(got[3]) == [[]] * 4 and list(got[4]) == [None] * 4
