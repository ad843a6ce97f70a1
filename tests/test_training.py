"""Training state, samples, and the learning service."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import maps, training
from tessella.operators.training import DualTrainer, Parameters
from tessella.streaming.learner import LearningService


def points(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, 4)) * 3
    rows = [(i, (centres[i % 3] + rng.normal(size=4)).tolist(), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "id long, vector array<double>, label int")


def test_saved_trainer_goes_on_as_if_unbroken(spark, tmp_path):
    data = points(spark)
    whole = DualTrainer(3, Parameters(regulariser=0.01, parts=3)).start(data).train(4)
    first = DualTrainer(3, Parameters(regulariser=0.01, parts=3)).start(data).train(2)
    first.save(str(tmp_path))
    again = DualTrainer.load(spark, str(tmp_path))
    assert again.rounds == 2 and again.parameters == first.parameters
    again.train(2)
    assert np.allclose(again.weights, whole.weights, atol=1e-12) and np.allclose(again.trace, whole.trace)
    light = DualTrainer.load(spark, str(tmp_path), full=False)
    assert light.state is None and light.predict(data).count() == 120


def test_dual_rises_to_the_primal(spark):
    data = points(spark, 90, 3)
    trainer = DualTrainer(3, Parameters(regulariser=0.05, parts=2)).start(data)
    duals = []
    for _ in range(6):
        duals.append(trainer.train(1).dual())
    assert all(b >= a - 1e-9 for a, b in itertools.pairwise(duals))
    # weights are what the dual weights say
    assert np.allclose(trainer.weights * 0.05 * 90, trainer._share(trainer.state), atol=1e-6)
    rows = data.collect()
    x, y = np.array([r.vector for r in rows]), np.array([r.label for r in rows])
    scores = x @ trainer.weights.T
    slack = (scores - scores[np.arange(90), y][:, None] + (np.arange(3)[None, :] != y[:, None])).max(axis=1)
    primal = slack.mean() + 0.05 / 2 * (trainer.weights**2).sum()
    assert duals[-1] <= primal + 1e-9 and duals[-1] > 0
    assert trainer.errors(data) < 0.1


def test_examples_come_and_go(spark):
    data = points(spark, 60, 5)
    trainer = DualTrainer(3, Parameters(regulariser=0.05, parts=2)).start(data.where("id < 40")).train(2)
    trainer.add(data)
    assert trainer.state.count() == 60
    trainer.train(1).relabel(spark.createDataFrame([(3, 1)], "id long, label int"))
    trainer.remove(data.where("id >= 50").select("id"))
    assert trainer.state.count() == 50 and trainer.state.where("id = 3").first().label == 1
    assert np.allclose(trainer.weights * 0.05 * 50, trainer._share(trainer.state), atol=1e-6)


def best_dual(gram, slack, scale, steps=20):
    """The best dual weights on a grid."""
    grid = [np.array(p) / steps for p in itertools.product(range(steps + 1), repeat=len(slack)) if sum(p) <= steps]
    return max(float(a @ slack - a @ gram @ a / (2 * scale)) for a in grid)


@pytest.mark.parametrize("seed", range(3))
def test_samples_optimised_together(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(3, 5))
    gram, slack, scale = x @ x.T, rng.normal(size=3) + 0.5, 4.0
    alpha = training.ascended(np.zeros(3), slack, gram, scale, 50)
    assert (alpha >= 0).all() and alpha.sum() <= 1 + 1e-9
    value = float(alpha @ slack - alpha @ gram @ alpha / (2 * scale))
    assert value >= best_dual(gram, slack, scale) - 0.05 * abs(best_dual(gram, slack, scale)) - 1e-3


def test_multi_sample_step(spark):
    rows = [(e, s, 0.0, 0.5 + 0.1 * s, [float(e), 1.0, float(s)]) for e in range(5) for s in range(3)]
    df = spark.createDataFrame(rows, "example long, sample long, alpha double, slack double, difference array<double>")
    got = {(r.example, r.sample): r.alpha for r in training.multi_sample_step(df, 0.1, 5, 7).collect()}
    for e in range(5):
        x = np.array([[float(e), 1.0, float(s)] for s in range(3)])
        want = training.ascended(np.zeros(3), np.array([0.5, 0.6, 0.7]), x @ x.T, 0.5, 7)
        assert np.allclose([got[e, s] for s in range(3)], want)


def test_hard_negatives_by_rounds(spark):
    data = points(spark, 120, 7)
    trainer = training.mined_rounds(DualTrainer(3, Parameters(regulariser=0.05, parts=2)), data, 2, 10)
    assert 20 < trainer.state.count() <= 120 and trainer.errors(data) < 0.2


def test_learning_service(spark, tmp_path):
    data = points(spark, 60, 9)
    service = LearningService(spark, DualTrainer(3, Parameters(regulariser=0.05, parts=2)).start(data).train(2), data, {"classes": spark.range(3)})
    vector = data.where("id = 4").first().vector

    def ask(*requests):
        lines = spark.createDataFrame([(json.dumps({"jsonrpc": "2.0", "id": str(k), **r}),) for k, r in enumerate(requests)], "value string")
        return {int(g["id"]): g for g in (json.loads(r.value) for r in service.methods.dispatch(lines).collect())}

    got = ask({"method": "new_session", "session_id": "s"}, {"method": "nope"}, {"method": "evaluate_testset"}, {"method": "plot_stats"})
    assert json.loads(got[0]["result"])["session_id"] == "s" and got[1]["error"] == "unknown method nope"
    assert json.loads(got[2]["result"])["error"] < 0.2 and json.loads(got[3]["result"])["rounds"] == 2
    got = ask({"method": "classify_example", "session_id": "s", "vector": vector}, {"method": "classify_example", "session_id": "s"})
    assert json.loads(got[0]["result"])["label"] == 1 and got[1]["error"] == "no vector"
    assert service.sessions.where("session_id = 's'").first().label == 1
    got = ask({"method": "add_example", "example": 500, "vector": vector, "label": 1}, {"method": "add_example", "example": 501})
    assert json.loads(got[0]["result"]) == {"example": 500} and got[1]["error"]
    got = ask({"method": "relabel_example", "example": 500, "label": 2}, {"method": "remove_example", "example": 7}, {"method": "remove_example", "example": 999})
    assert got[2]["error"] == "unknown example" and service.trainer.state.where("id = 500").first().label == 2
    got = ask({"method": "get_trainset", "start": 58, "most": 5}, {"method": "set_parameter", "name": "C", "value": 50}, {"method": "set_parameter", "name": "x", "value": 1}, {"method": "get_definitions", "tables": {"classes": True}}, {"method": "save", "path": str(tmp_path)})
    assert [e["id"] for e in json.loads(got[0]["result"])["examples"]] == [59, 500]
    assert service.trainer.parameters.regulariser == 0.02 and got[2]["error"] == "no such parameter"
    assert json.loads(got[3]["result"])["tables"] == {"classes": 3} and DualTrainer.load(spark, str(tmp_path)).rounds == service.trainer.rounds
    ask({"method": "shutdown"})
    assert ask({"method": "plot_stats"})[0]["error"] == "shut down"


def test_clicks_add_up_and_draws(spark):
    cells = spark.createDataFrame([(1, 1, y, x, 0.0) for y in range(4) for x in range(4)], "id long, part int, y int, x int, value double")
    clicks = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 1, 3.0, 2.0)], "id long, part int, x double, y double")
    got = {(r.y, r.x): r.value for r in maps.with_evidence(cells, clicks, 0.5, 1.0, 2.0).collect()}
    for (y, x), v in got.items():
        assert np.isclose(v, -0.5 * sum((x - cx) ** 2 + 2 * (y - cy) ** 2 for cx, cy in ((0, 0), (3, 2))))
    many = maps.sampled_cells(cells.withColumn("value", F.when(F.expr("y = 1 and x = 2"), 5.0).otherwise(0.0)), 200).collect()
    assert len(many) == 200 and sum((r.y, r.x) == (1, 2) for r in many) > 150
