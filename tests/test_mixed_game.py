"""The game with questions of all kinds, against a plain loop over one session at a time."""

import itertools
import math

import numpy as np
import pytest

from tessella.operators import mixed_game, response_model
from tests.test_operators import responses

QUESTIONS = [(0, "binary", [0], 1.0), (1, "binary", [1], 3.0), (2, "multiple", [2, 3], 2.0), (3, "batch", [4, 5], 2.0), (4, "click", [], 0.5)]


def entropy(p):
    return -sum(v * math.log(v) for v in p if v > 0)


def plain(e, truth, told, table, click, samples, select, rounds, classes=4):
    def like(c, a, y, k):
        p, w = table[c, a, k]
        q = p if y else 1 - p
        return q**w if q > 0 else 0.0

    def clicked(x, y):
        return [sum(math.exp(-(0.01 * (sx - x) ** 2 + 0.01 * (sy - y) ** 2)) * p[c] for sx, sy, p in samples) for c in range(classes)]

    sure = max(range(4), key=lambda k: table[0, 0, k][1])
    outcomes, answers, seconds = {}, {}, {}
    for q, kind, attributes, _ in QUESTIONS:
        if kind == "binary":
            (a,) = attributes
            outcomes[q] = [[like(c, a, y, k) for c in range(classes)] for k in range(4) for y in (0, 1)]
            y, k, s = told[e, a]
            answers[q], seconds[q] = [like(c, a, y, k) for c in range(classes)], s
        elif kind == "multiple":
            outcomes[q] = [[like(c, a, 1, k) for c in range(classes)] for a in attributes for k in range(4)]
            yes = [a for a in attributes if told[e, a][0]]
            a, y, k = (yes[-1], 1, told[e, yes[-1]][1]) if yes else (attributes[0], 0, 0)
            answers[q], seconds[q] = [like(c, a, y, k) for c in range(classes)], told[e, a][2]
        elif kind == "batch":
            outcomes[q] = [[math.prod(like(c, a, y, sure) for a, y in zip(attributes, ys)) for c in range(classes)] for ys in itertools.product((0, 1), repeat=2)]
            answers[q] = [math.prod(like(c, a, *told[e, a][:2]) for a in attributes) for c in range(classes)]
            seconds[q] = sum(told[e, a][2] for a in attributes)
        else:
            outcomes[q] = [clicked(x, y) for x, y, _ in samples]
            answers[q], seconds[q] = clicked(*click), 1.25
    prior, elapsed, left, out = [1 / classes] * classes, 0.0, [q[0] for q in QUESTIONS], []
    for _ in range(rounds):
        gain = {}
        for q in left:
            after = mass = 0.0
            for t in outcomes[q]:
                u = [p * v for p, v in zip(prior, t)]
                if sum(u) > 0:
                    after += sum(u) * entropy([v / sum(u) for v in u])
                    mass += sum(u)
            gain[q] = entropy(prior) - after / mass
            if select == "time":
                gain[q] /= QUESTIONS[q][3]
        best = min(left, key=lambda q: (-round(gain[q], 9), q))
        left.remove(best)
        prior = [p * v for p, v in zip(prior, answers[best])]
        prior = [p / sum(prior) for p in prior]
        elapsed += seconds[best]
        out.append((best, prior[truth], elapsed))
    return out


@pytest.mark.parametrize("select", ["gain", "time"])
def test_all_kinds_against_a_plain_loop(spark, select):
    rows, df = responses(spark)
    model = response_model.response_model(df)
    table = {(r["class"], r.attribute, r.certainty): (r.p, r.weight) for r in model.collect()}
    told = {(e, a): (y, k, s) for e, _, a, y, k, s in rows}
    rng = np.random.default_rng(4)
    spots = {}
    for e in range(40):
        samples = [(float(x), float(y), p.tolist()) for (x, y), p in zip(rng.random((3, 2)) * 20, rng.dirichlet(np.ones(4), 3))]
        spots[e] = (tuple(map(float, rng.random(2) * 20)), samples)
    clicks = spark.createDataFrame([(e, 4, *at, 1.25, samples) for e, (at, samples) in spots.items()], "example long, question int, x double, y double, seconds double, samples array<struct<x double, y double, p array<double>>>")
    questions = spark.createDataFrame(QUESTIONS, "question int, kind string, attributes array<int>, seconds double")
    got = mixed_game.play_mixed(df, model, questions, 5, select, clicks=clicks).collect()
    history = {(r.session, r["round"]): r for r in got}
    assert len(got) == 40 * 6
    for e, truth in sorted({(r[0], r[1]) for r in rows})[:12]:
        for step, (question, p, elapsed) in enumerate(plain(e, truth, told, table, *spots[e], select, 5), 1):
            r = history[e, step]
            assert r.question == question and np.isclose(r.true_p, p) and np.isclose(r.elapsed, elapsed)
            assert r.kind == QUESTIONS[question][1]


def test_stops_and_refuses(spark):
    _, df = responses(spark)
    model = response_model.response_model(df)
    schema = "question int, kind string, attributes array<int>, seconds double"
    questions = spark.createDataFrame([*QUESTIONS[:4], (9, "click", [], 1.0), (10, "binary", [77], 1.0)], schema)
    got = mixed_game.play_mixed(df, model, questions, 9, "order", stop_early=True).collect()
    # clicks without samples and attributes that the model lacks are never asked
    assert {r.question for r in got} <= {None, 0, 1, 2, 3}
    last = {}
    for r in got:
        last[r.session] = max(last.get(r.session, r), r, key=lambda x: x["round"])
    assert all(r.true_rank == 1 or r["round"] == 4 for r in last.values())
    with pytest.raises(ValueError, match="no known kind"):
        mixed_game.play_mixed(df, model, spark.createDataFrame([(0, "riddle", [0], 1.0)], schema))
