"""Round trips of files, and streams against batches."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import learning, response_model, sessions
from tessella.operators.annotations import answers_of, objects_of, part_rows
from tessella.sources import datasets, folders
from tessella.sources import vectors as sparse
from tessella.streaming import sessions as streams

LINE = {
    "x": {"imagename": "a.jpg", "width": 100},
    "y": {"objects": [{"class": "001.Foo", "part_locations": [{"part": "beak", "x": 10.0, "y": 12.0, "visible": True}], "users": [{"attribute_responses": ["1,3,2.5", "0,2,1.0"]}]}, {"class": "no", "isValid": False}]},
}
OLD = {"x": {"imagename": "b.jpg"}, "y": {"class": "002.Bar", "part_locations": []}}


def test_examples_round_trip(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text(json.dumps(LINE) + "\n\n" + json.dumps(OLD) + "\n")
    df = datasets.with_defaults(datasets.read_examples(spark, str(tmp_path / "in.jsonl")))
    assert sorted((r.x.imagename, r.x.width, r.x.height, r.x.image_scale) for r in df.collect()) == [("a.jpg", 100, -1, 1.0), ("b.jpg", -1, -1, 1.0)]
    objects = objects_of(df)
    assert sorted(r.object["class"] for r in objects.collect()) == ["001.Foo", "002.Bar"]
    datasets.write_examples(df, str(tmp_path / "out"))
    datasets.write_examples(df.limit(1), str(tmp_path / "out"), append=True)
    assert datasets.read_examples(spark, str(tmp_path / "out")).count() == 3
    parts = spark.createDataFrame([(0, "beak"), (1, "tail")], "id int, name string")
    keyed = objects.select(F.col("x.imagename").alias("key"), F.col("object.part_locations").alias("locations"))
    got = {(r.key, r.name): r.location for r in part_rows(keyed, parts).collect()}
    assert got["a.jpg", "beak"].x == 10.0 and got["a.jpg", "tail"] is None and len(got) == 4
    users = objects.select(F.col("x.imagename").alias("key"), F.explode("object.users").alias("u")).select("key", F.col("u.attribute_responses").alias("codes"))
    assert [(r.attribute, r.answer, r.certainty, r.seconds) for r in answers_of(users, 2).orderBy("attribute").collect()] == [(0, 1, 3, 2.5), (1, 0, 2, 1.0)]
    with pytest.raises(Exception, match="as many answers"):
        answers_of(users, 3).collect()


def test_bad_line_fails(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text(json.dumps(LINE) + "\n{nonsense\n")
    with pytest.raises(Exception):  # noqa: B017
        datasets.read_examples(spark, str(tmp_path / "bad.jsonl")).collect()


def test_model_and_predictions(spark, tmp_path):
    model = {"numScales": 3, "classes": [{"name": "a", "id": 0, "meta": {"Family": "F"}}], "questions": [{"id": 0, "type": "binary", "attribute": "x"}], "parts": [{"name": "p", "id": 0}]}
    (tmp_path / "m.json").write_text(json.dumps(model, indent=1))
    got = datasets.read_model(spark, str(tmp_path / "m.json"))
    assert got["settings"].first().numScales == 3 and got["settings"].first().gammaClass == 1
    assert got["questions"].first().numSamples == 500 and got["classes"].first().meta == {"Family": "F"} and got["attributes"].count() == 0
    datasets.write_model(got, str(tmp_path / "saved"))
    assert spark.read.parquet(f"{tmp_path}/saved/parts").first().name == "p"
    told = spark.createDataFrame([(1, 2, 0.5, 3, 0.25, 1.0), (0, 1, 1.0, 1, 1.0, 0.0)], "example int, pred int, score double, gt int, gt_score double, loss double")
    datasets.write_predictions(told, str(tmp_path / "p"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "p")).collect()]
    assert {"predicted": {"y": 2, "score": 0.5}, "ground_truth": {"y": 3, "score": 0.25}, "loss": 1.0} in lines


def test_sparse_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1 0:1.5 7:-2\n3 2:0.25\n\n")
    df = sparse.read_sparse_text(spark, str(tmp_path / "t.txt"))
    rows = sorted((r["class"], r.features) for r in df.collect())
    assert rows == [(1, {0: 1.5, 7: -2.0}), (3, {2: 0.25})]
    assert tuple(sparse.sizes(df).first()) == (8, 3)
    sparse.write_sparse_text(df, str(tmp_path / "w"))
    assert sorted((r["class"], r.features) for r in sparse.read_sparse_text(spark, str(tmp_path / "w")).collect()) == rows
    raw = sparse.encode_sparse(rows) + struct.pack("<iii", 2, 1, 1) + np.array([0.0, 4.0]).tobytes()
    (tmp_path / "b.bin").write_bytes(raw)
    want = [*rows, (2, {1: 4.0})]
    assert [(r["class"], r.features) for r in sparse.read_sparse_binary(spark, str(tmp_path / "b.bin")).collect()] == want
    spark.dataSource.register(sparse.SparseFiles)
    assert [(r["class"], r.features) for r in spark.read.format("sparse_binary").load(str(tmp_path)).collect()] == want
    (tmp_path / "bad.txt").write_text("0 1:1\n")
    with pytest.raises(Exception, match="not a class"):
        sparse.read_sparse_text(spark, str(tmp_path / "bad.txt")).collect()


def test_arrays(spark, tmp_path):
    a, b = np.arange(6, dtype=np.float32).reshape(2, 3), np.arange(4, dtype=np.int32)
    (tmp_path / "a.bin").write_bytes(sparse.encode_arrays({"acc": ("float", a), "n": ("int", b)}))
    rows = sparse.read_arrays(spark, str(tmp_path / "a.bin")).collect()
    assert {(r.name, r.i, r.j): r.value for r in rows if r.name == "acc"} == {("acc", i, j): float(a[i, j]) for i in range(2) for j in range(3)}
    assert [r.value for r in rows if r.name == "n"] == [0, 1, 2, 3]


def test_bird_tables(spark, tmp_path):
    for folder in ("parts", "attributes"):
        (tmp_path / folder).mkdir()
    files = {
        "classes.txt": "1 001.A\n2 002.B\n", "parts/parts.txt": "1 beak\n2 left wing\n", "attributes/attributes.txt": "1 has_bill::long\n", "attributes/certainties.txt": "1 not visible\n2 guessing\n",
        "images.txt": "1 a/x.jpg\n2 b/y.jpg\n", "bounding_boxes.txt": "1 1.0 2.0 3.0 4.0\n2 0 0 5 5\n", "image_class_labels.txt": "1 1\n2 2\n", "train_test_split.txt": "1 1\n2 0\n",
        "parts/part_locs.txt": "1 1 5 6 1\n1 2 0 0 0\n2 1 7 8 1\n2 2 1 1 1\n", "parts/part_click_locs.txt": "1 1 5 6 1 2.5\n", "attributes/image_attribute_labels.txt": "1 1 1 2 3.5\n2 1 0 1 1.5\n",
        "attributes/class_attribute_labels_continuous.txt": "100 50\n0 25\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    t = folders.bird_tables(spark, str(tmp_path))
    rows = {r.image_id: r for r in folders.bird_examples(t).collect()}
    assert rows[1]["class"] == "001.A" and [p.part for p in rows[1].parts] == ["beak", "left wing"] and rows[2].is_train == 0
    assert folders.checked_ids(t["images"], "image_id").first().dense
    w = {(r.class_id, r.attribute_id): r.w for r in folders.class_attribute_weights(spark, f"{tmp_path}/attributes/class_attribute_labels_continuous.txt").collect()}
    assert w == {(1, 1): 1.0, (1, 2): 0.0, (2, 1): -1.0, (2, 2): -0.5}
    model = response_model.response_model(folders.bird_responses(t), betas=(4.0, 2.0))
    assert model.count() == 4


def test_class_folders(spark, tmp_path):
    for cls in "ab":
        (tmp_path / cls).mkdir()
        for i in range(4):
            (tmp_path / cls / f"{i}.jpg").write_bytes(b"x")
        (tmp_path / cls / "note.txt").write_text("n")
    got = folders.class_folders(spark, str(tmp_path), ".jpg", ["a/0.jpg"], train_each=2).collect()
    assert len(got) == 7
    assert {c: sum(r.split == 0 for r in got if r["class"] == c) for c in "ab"} == {"a": 2, "b": 2}


def test_session_logs(spark, tmp_path):
    place = tmp_path / "u1" / "img"
    place.mkdir(parents=True)
    log = {"start_session": {"imageName": "i", "time": "1000"}, "questions": [{"id": "4", "time": "1500", "stage": "start"}, {"id": "4", "time": "2600", "stage": "end"}], "removals": [{"class": "c", "time": "2000"}], "end_session": {"time": "9000", "selection": "c"}}
    (place / "log_1.txt").write_text(json.dumps({"start_session": {"time": "1"}}))
    (place / "log_2.txt").write_text(json.dumps(log))
    logs = folders.session_logs(spark, str(tmp_path))
    assert [(r.user, r.image, r.version) for r in logs.collect()] == [("u1", "img", 2)]
    events = [(r.at, r.kind, r.what) for r in sessions.timeline(logs).orderBy("at").collect()]
    assert events == [(1000, "start", "i"), (1500, "question_start", "4"), (2000, "removal", "c"), (2600, "question_end", "4"), (9000, "end", "c")]


def test_study_and_requests(spark, tmp_path):
    (tmp_path / "ann.txt").write_text("1 control A/x.jpg\n2 free B/y.jpg\n")
    study = folders.study_files(spark, str(tmp_path))
    results = spark.createDataFrame([("ann", 1, 2.5), ("ann", 2, 9.0)], "user string, image_no int, loss double")
    assert [(r.user, r.score) for r in folders.study_scores(study, results).collect()] == [("ann", 2.5)]
    lines = spark.createDataFrame([('{"jsonrpc":"2.0","id":"7","method":"next_question"}',), ("{oops",), ('{"id":"1"}',)], "value string")
    got = folders.parsed_requests(lines)
    assert [r.error for r in got.collect()] == [None, "parse error", "no method"]
    assert json.loads(folders.responses(got.limit(1), F.lit("ok")).first().value)["id"] == "7"


def test_retraction_in_many_batches(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(20)), seq, str(rng.choice(["add", "relabel", "remove"])), str(rng.choice(["x", "y"])), float(rng.integers(9))) for seq in range(120)]
    schema = "example long, seq long, action string, label string, value double"
    for k in range(0, 120, 30):
        spark.createDataFrame(rows[k : k + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = streams.run_to_end(streams.class_counts(stream)).groupBy("label").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
    batch = learning.current_examples(spark.createDataFrame(rows, schema)).groupBy("label").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert sorted(map(tuple, changes.collect())) == sorted(map(tuple, batch.collect()))


def test_training_on_a_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    schema = "id long, vector array<double>, label int"
    for k in range(3):
        data = [(100 * k + i, (rng.normal(size=2) + 4 * (i % 2)).tolist(), i % 2) for i in range(60)]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    learner = learning.Learner(2, 0.1)
    streams.train_on_stream(stream.selectExpr("id", "concat(vector, array(1D)) vector", "label"), learner, 40).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [r for _, r, _ in learner.history] == [60, 60, 60]
    assert learner.history[-1][2] <= 6


def test_scratch_tables_are_deleted(spark):
    from pathlib import Path

    from tessella.session import materialize, scratch

    kept = materialize(spark.range(3), "kept")
    with scratch():
        gone = materialize(kept, "gone")
        files = gone.inputFiles()
        assert gone.count() == 3
    assert kept.count() == 3 and not any(Path(f.removeprefix("file://")).exists() for f in files)
