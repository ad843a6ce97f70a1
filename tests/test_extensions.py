"""Whole models, codebooks, galleries, and what users plug in."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import extensions as ext
from tessella.operators.training import Parameters
from tessella.sources import datasets


MODEL = {
    "numScales": 3,
    "classes": [{"name": "a", "meta": {"Family": "F"}, "weights": [0.5]}, {"name": "b", "id": 7}],
    "parts": [{"name": "body", "poses": ["p1"]}, {"name": "beak", "parent": "body"}, {"name": "tail", "parent": "nothing"}],
    "poses": [{"name": "p1", "isNotVisible": False}],
    "attributes": [{"name": "colour::red", "part": "beak"}],
    "questions": [{"type": "binary", "attribute": "colour::red"}, {"type": "click", "part": "tail", "numSamples": 9}],
    "spatialTransitions": [{"parent": "body", "parentPose": "p1", "child": "beak", "offsets": [1.0, 2.0]}],
    "features": [{"name": "HOG", "width": 4}],
    "codebooks": [{"name": "words", "numWords": 10}],
}


def test_whole_model(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(MODEL))
    got = datasets.read_model(spark, str(tmp_path / "m.json"))
    assert [r.id for r in got["classes"].orderBy("place").collect()] == [0, 7]
    hog = got["features"].first()
    assert (hog.width, hog.numBlocksX, hog.numBins, hog.normalize) == (4, 1, 9, True)
    assert got["settings"].first().spatialGranularity == 1 and got["codebooks"].first().numWords == 10
    linked = datasets.linked_model(got)
    assert {r.name: r.parent_id for r in linked["parts"].collect()} == {"body": None, "beak": 0, "tail": -1}
    step = linked["spatialTransitions"].first()
    assert (step.parent_id, step.child_id, step.parentPose_id) == (0, 1, 0)
    assert {r.type: (r.attribute_id, r.part_id) for r in linked["questions"].collect()} == {"binary": (0, None), "click": (None, 2)}
    datasets.write_model_document(got, str(tmp_path / "out"))
    again = datasets.read_model(spark, str(tmp_path / "out"))
    for name, df in got.items():
        assert sorted(map(str, again[name].collect())) == sorted(map(str, df.collect())), name


def test_codebook_and_files(spark, tmp_path):
    arrays = {"words": np.arange(6.0).reshape(2, 3), "weights": np.array([0.5, 0.25])}
    datasets.write_codebook(spark, arrays, str(tmp_path / "book"))
    back = datasets.read_codebook(spark, str(tmp_path / "book"))
    assert all((back[k] == v).all() and back[k].shape == v.shape for k, v in arrays.items())
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\n\nthree\n")
    (tmp_path / "t" / "b.txt").write_text("last")
    files = datasets.read_text_files(spark, str(tmp_path / "t"))
    lines = {(r.path[-5:], r.number): r.line for r in datasets.numbered_lines(files).collect()}
    assert lines == {("a.txt", 0): "one", ("a.txt", 1): "", ("a.txt", 2): "three", ("b.txt", 0): "last"}
    assert {r.length for r in datasets.read_binary_files(spark, str(tmp_path / "t")).collect()} == {11, 4}


def test_gallery_and_crops(spark, tmp_path):
    rows = spark.createDataFrame([("b.jpg", "x < y", None, 2.0), ("a.jpg", 'say "hi"', "t.jpg", 1.0)], "image string, caption string, thumb string, loss double")
    page = datasets.gallery(rows, [F.col("loss")], "worst").first().value
    assert page.index("a.jpg") < page.index("b.jpg") and "x &lt; y" in page and 'src="t.jpg"' in page and "&quot;hi&quot;" in page
    line = {"x": {"imagename": "d/full/a.jpg", "width": 100, "height": 80}, "y": {"objects": [{"part_locations": [{"part": "p", "x": 15.0, "y": 30.0}], "bounding_box": {"x": 10, "y": 20, "width": 40, "height": 30}}]}}
    bare = {"x": {"imagename": "d/full/b.jpg", "width": 10, "height": 8}, "y": {"objects": [{"part_locations": [{"part": "p", "x": 1.0, "y": 2.0}]}]}}
    (tmp_path / "e.jsonl").write_text(json.dumps(line) + "\n" + json.dumps(bare) + "\n")
    got = {r.x.imagename: r for r in datasets.cropped(datasets.read_examples(spark, str(tmp_path / "e.jsonl")), "full", "cut").collect()}
    a, b = got["d/cut/a.jpg"], got["d/cut/b.jpg"]
    assert (a.x.width, a.x.height, a.y.objects[0].part_locations[0].x, a.y.objects[0].part_locations[0].y, a.y.objects[0].bounding_box.x) == (40, 30, 5.0, 10.0, 0)
    assert (b.x.width, b.y.objects[0].part_locations[0].x, b.y.objects[0].bounding_box) == (10, 1.0, None)


class Labelled(ext.StructuredModel):
    """Three labels; the joint features are the vector, at its label's place."""

    parameters = Parameters(regulariser=0.05)

    def __init__(self, points):
        self.points = points

    def scores(self, examples, weights):
        flat = examples.select("example", "gt", F.posexplode("vector").alias("j", "x")).withColumn("label", F.explode(F.array(*map(F.lit, range(3)))))
        joined = flat.join(weights, flat["label"] * 4 + flat["j"] == weights["index"], "left")
        out = joined.groupBy("example", "gt", "label").agg(F.sum(F.col("x") * F.coalesce("value", F.lit(0.0))).alias("score"))
        return out.withColumn("loss", (F.col("label") != F.col("gt")).cast("double"))

    def features(self, samples):
        return samples.join(self.points, "example").select("example", "label", F.posexplode("vector").alias("j", "value")).select("example", "label", (F.col("label") * 4 + F.col("j")).alias("index"), "value")


def test_structured_model(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(3, 4)) * 3
    points = spark.createDataFrame([(i, i % 3, (centres[i % 3] + rng.normal(size=4)).tolist()) for i in range(60)], "example long, gt int, vector array<double>")
    model = Labelled(points)
    weights = model.train(points, spark.createDataFrame([], "index int, value double"), 4)
    told = model.inferred(points, weights).join(points, "example")
    assert told.where("label = gt").count() >= 54
    assert model.importance_samples(points, weights).count() == 60 and model.initial_samples(points, weights) is None


def test_registries(spark):
    book = ext.Registry("thing")
    book.register("a", 1)
    with pytest.raises(KeyError, match="already"):
        book.register("a", 2)
    book.register("a", 2, replace=True)
    with pytest.raises(KeyError, match="known: a"):
        book.find("b")
    assert book.find("a") == 2 and book.unregister("a") and not book.unregister("a") and book.names() == []
    assert ext.QUESTIONS.names() == ["batch", "binary", "multiple"] and ext.FEATURES.names() == ["histogram", "patterns", "plain"]
    image = np.random.default_rng(0).random((16, 16))
    assert all(ext.FEATURES.find(n).compute(image).shape[2] == ext.FEATURES.find(n).channels for n in ext.FEATURES.names())
    got = spark.range(1).select(*[ext.distance(n, F.array(F.lit(1.0), F.lit(4.0)), F.array(F.lit(2.0), F.lit(2.0))).alias(n) for n in ("l1", "l2_squared")]).first()
    assert (got.l1, got.l2_squared) == (3.0, 5.0)
    responses = spark.createDataFrame([(1, 0, 1, 2, 1.0), (1, 1, 1, 3, 2.0)], "example int, attribute int, answer int, certainty int, seconds double")
    asked = spark.createDataFrame([(0, 0, 0), (0, 1, 1)], "question int, attribute int, position int")
    assert ext.QUESTIONS.find("multiple").told(responses, asked).first().answer == 1
    assert ext.QUESTIONS.find("binary").told(responses, asked).count() == 2


def test_codebooks_are_built_and_used(spark, tmp_path):
    from tessella.operators import codebooks

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 6)) * 5
    rows = [(i % 12, i // 12, i % 7, (centres[i % 4] + rng.normal(size=6) * 0.1).tolist()) for i in range(480)]
    points = spark.createDataFrame(rows, "image int, y int, x int, vector array<double>")
    ids = points.select(F.xxhash64("image", "y", "x").alias("id"), "vector", (F.col("y") * 12 + F.col("image")).alias("n"))
    for book in (codebooks.word_codebook(points, 4, 10, 20), codebooks.word_codebook(points, 4, 10, 20, depth=2)):
        datasets.write_codebook(spark, book, str(tmp_path / "b"))
        told = codebooks.words_of(ids, datasets.read_codebook(spark, str(tmp_path / "b"))).join(ids, "id")
        kinds = told.groupBy("word").agg(F.countDistinct(F.col("n") % 4).alias("k")).collect()
        assert len(kinds) == 4 and all(r.k == 1 for r in kinds)
    fisher = codebooks.fisher_codebook(points, 3, 2, 10, 20)
    assert fisher["components"].shape[-1] in (2, 6) and fisher["mu"].shape == (3, 2) and np.isclose(fisher["weight"].sum(), 1)


def test_progress_is_said_now_and_then(spark):
    from tessella.streaming.rpc import Progress

    times, said = iter([0.0, 10.0, 61.0, 62.0, 130.0]), []
    progress = Progress(lambda *x: said.append(x), 60.0, lambda: next(times))
    for k in range(4):
        progress(spark.range(5), k)
    assert said == [(1, 10, 61.0), (3, 20, 130.0)]
