"""Training state: cached samples, dual coordinate ascent over many examples at once, saving and resuming."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.learning import MOST_WEIGHTS
from tessella.session import materialize, ship


def created_samples(scores: DataFrame) -> DataFrame:
    """(example, label, loss, score, slack): a sample for every label but the true one.

    ``scores``: example, gt, label, score, loss, a row for each label.  slack is
    how far the label's score with its loss is above the true label's score.
    """
    truth = scores.where("label = gt").select(F.col("example").alias("of_example"), F.col("score").alias("gt_score"))
    wrong = scores.where("label <> gt")
    slack = F.col("score") + F.col("loss") - F.col("gt_score")
    return wrong.join(truth, wrong["example"] == truth["of_example"]).select("example", "label", "loss", "score", slack.alias("slack"))


def most_violated(scores: DataFrame) -> DataFrame:
    """(example, label, loss, score, slack): the one sample of each example with the highest score and loss together, the true label's own among them; ties go to the smaller label."""
    reach = F.round(F.col("score") + F.col("loss"), 9)
    best = F.max(F.struct(reach.alias("reach"), (-F.col("label")).alias("tie"), "label", "loss", "score"))
    out = scores.groupBy("example").agg(best.alias("best"), F.max(F.when(F.col("label") == F.col("gt"), F.col("score"))).alias("gt_score"))
    return out.select("example", "best.label", "best.loss", "best.score", (F.col("best.score") + F.col("best.loss") - F.col("gt_score")).alias("slack"))


def merged_samples(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sample sets of two rounds (example, label, alpha, score): the later score, and the dual weight that a sample has already; new ones have 0."""
    both = old.withColumn("late", F.lit(0)).unionByName(new.withColumn("late", F.lit(1)).withColumn("alpha", F.lit(0.0)).select(*old.columns, "late"))
    return both.groupBy("example", "label").agg(F.sum("alpha").alias("alpha"), F.max_by("score", "late").alias("score"))


def latent_values(candidates: DataFrame) -> DataFrame:
    """(example, latent, score): of the latent values that fit an example's label (allowed) the highest scored; ties go to the smaller.

    ``candidates``: example, latent, score, allowed.  An example without any is left out.
    """
    best = F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("latent")).alias("tie"), "latent"))
    return candidates.where("allowed").groupBy("example").agg(best.alias("best")).select("example", "best.latent", "best.score")


def one_example_step(weights: DataFrame, example: DataFrame, gt: int, violated: int, regulariser: float, step: int) -> DataFrame:
    """(class, j, value) after a subgradient step on one example (j, x) whose most violated label is ``violated``."""
    rate = 1.0 / (regulariser * step)
    moved = example.select(F.explode(F.array(F.struct(F.lit(gt).alias("class"), F.lit(rate).alias("f")), F.struct(F.lit(violated).alias("class"), F.lit(-rate).alias("f")))).alias("m"), "j", "x")
    moved = moved.select("m.class", "j", (F.col("m.f") * F.col("x")).alias("value"))
    kept = weights.select("class", "j", (F.col("value") * (1 - 1 / step)).alias("value"))
    return kept.unionByName(moved).groupBy("class", "j").agg(F.sum("value").alias("value"))


def ascended(alpha: np.ndarray, slack: np.ndarray, gram: np.ndarray, scale: float, rounds: int) -> np.ndarray:
    """Dual weights of one example's samples after ``rounds`` passes of coordinate ascent, over samples and pairs of them, each kept at 0 or more and their sum at 1 at most.

    ``gram``: inner products of the samples' feature differences; ``slack``:
    score and loss above the truth at the present weights; ``scale``: lambda n.
    """
    alpha, slack = alpha.astype(float).copy(), slack.astype(float).copy()
    for _ in range(rounds):
        for i in range(len(alpha)):
            if gram[i, i] <= 0:
                continue
            free = 1.0 - (alpha.sum() - alpha[i])
            change = min(max(alpha[i] + slack[i] * scale / gram[i, i], 0.0), max(free, 0.0)) - alpha[i]
            alpha[i] += change
            slack -= change * gram[i] / scale
        # where the sum is at its bound, weight goes from one sample to another
        for i in range(len(alpha) if alpha.sum() > 1 - 1e-12 else 0):
            for j in range(i):
                bend = gram[i, i] + gram[j, j] - 2 * gram[i, j]
                if bend > 0:
                    change = min(max((slack[i] - slack[j]) * scale / bend, -alpha[i]), alpha[j])
                    alpha[i] += change
                    alpha[j] -= change
                    slack -= change * (gram[i] - gram[j]) / scale
    return alpha


def multi_sample_step(samples: DataFrame, regulariser: float, n: int, rounds: int = 10) -> DataFrame:
    """(example, sample, alpha, change) after each example's samples have been optimised together.

    ``samples``: example, sample, alpha, slack, difference array<double> (the
    sample's features less the true label's).  An example's samples, of which
    there are a bounded number (see ``ordering.condensed``), are gathered in
    one row; examples do not see one another's changes.
    """
    ship(samples.sparkSession)
    row = F.struct("sample", "alpha", "slack", "difference")
    sets = samples.groupBy("example").agg(F.sort_array(F.collect_list(row)).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for example, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.array([r["difference"] for r in rows], float)
                alpha = np.array([r["alpha"] for r in rows], float)
                new = ascended(alpha, np.array([r["slack"] for r in rows], float), x @ x.T, regulariser * n, rounds)
                out += [(example, r["sample"], float(a), float(a - b)) for r, a, b in zip(rows, new, alpha)]
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["example", "sample", "alpha", "change"])

    sets = sets.select(F.col("example").cast("long").alias("example"), "s")
    return sets.mapInArrow(run, "example long, sample long, alpha double, change double")


@dataclass
class Parameters:
    """What training can be told; defaults are those that a new model gets."""

    regulariser: float = 1e-3
    method: str = "multi_sample_with_cache"
    most_samples: int = 50
    sample_rounds: int = 10
    parts: int = 8

    def set(self, name: str, value: float) -> None:
        """One parameter by name; C stands for 1 / lambda."""
        if name.lower() == "c":
            name, value = "regulariser", 1.0 / float(value)
        if not hasattr(self, name):
            raise KeyError(name)
        setattr(self, name, type(getattr(self, name))(value))


@dataclass
class DualTrainer:
    """A multiclass linear model by dual coordinate ascent, which can be saved and carried on at any round.

    Examples are dealt by a hash of their ids into ``parts``; each part takes
    its examples in turn against its own copy of the weights, and the parts'
    changes are averaged, so that the dual objective never falls.  The state is
    the weights, the number of rounds, and a table of each example's dual
    weights, one a class.  Rounds depend on nothing else: a trainer that was
    saved and loaded goes on as if it had never stopped.
    """

    classes: int
    parameters: Parameters = field(default_factory=Parameters)
    rounds: int = 0
    weights: np.ndarray | None = None
    state: DataFrame | None = None
    trace: list[float] = field(default_factory=list)

    def start(self, points: DataFrame) -> DualTrainer:
        """``points``: id, vector array<double>, label; ids are unique.  Forgets all that was learned."""
        width = points.select(F.max(F.size("vector"))).first()[0] or 0
        if width * self.classes > MOST_WEIGHTS:
            raise ValueError("the model is too large to be sent to each worker")
        part = F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(self.parameters.parts)).cast("int")
        rows = points.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.col("label").cast("int").alias("label"), part.alias("part"))
        self.state = materialize(rows.withColumn("alpha", F.array_repeat(F.lit(0.0), self.classes)), "trainer")
        self.weights, self.rounds, self.trace = np.zeros((self.classes, width)), 0, []
        return self

    def _pass(self) -> tuple[DataFrame, np.ndarray, float]:
        spark, n = self.state.sparkSession, self.state.count()
        ship(spark)
        held = spark.sparkContext.broadcast(self.weights)
        scale, parts, classes = self.parameters.regulariser * max(n, 1), self.parameters.parts, self.classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, at, gain = held.value.copy(), None, 0.0

            def close() -> pa.RecordBatch:
                change = (w - held.value).ravel()
                none = lambda t: pa.array([None], t)
                columns = [none(pa.int64()), pa.array([change.tolist()], pa.list_(pa.float64())), none(pa.int32()), none(pa.int32()), pa.array([[gain]], pa.list_(pa.float64()))]
                return pa.RecordBatch.from_arrays(columns, names)

            for batch in batches:
                if not batch.num_rows:
                    continue
                part = batch.column(3).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                y = batch.column(2).to_numpy(zero_copy_only=False)
                alpha = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).copy()
                for i in range(batch.num_rows):
                    if part[i] != at:
                        if at is not None:
                            yield close()
                        w, at, gain = held.value.copy(), part[i], 0.0
                    square = 2 * float(x[i] @ x[i])
                    if square <= 0:
                        continue
                    score = w @ x[i]
                    slack = score - score[y[i]] + (np.arange(classes) != y[i])
                    k = int(slack.argmax())
                    gain += slack[k]
                    # the most violated label, and labels that have a weight already
                    for c in {k, *np.flatnonzero(alpha[i]).tolist()} - {int(y[i])}:
                        slack_c = float(w[c] @ x[i] - w[y[i]] @ x[i] + 1)
                        free = 1.0 - (alpha[i].sum() - alpha[i, c])
                        step = min(max(alpha[i, c] + slack_c * scale / square, 0.0), max(free, 0.0)) - alpha[i, c]
                        alpha[i, c] += step
                        w[c] -= step * x[i] / scale
                        w[y[i]] += step * x[i] / scale
                lists = pa.array(list(alpha), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], names)
            if at is not None:
                yield close()

        names = ["id", "vector", "label", "part", "alpha"]
        dealt = self.state.repartition(parts, "part").sortWithinPartitions("part", "id")
        out = materialize(dealt.mapInArrow(run, self.state.schema), "round")
        rows = out.where("id is null").select("vector", "alpha").collect()
        change = sum((np.array(r.vector) for r in sorted(rows, key=lambda r: r.vector)), np.zeros(self.weights.size)) / parts
        new = out.where("id is not null")
        old = self.state.select(F.col("id").alias("old_id"), F.col("alpha").alias("old"))
        # averaged like the weights
        mean = F.zip_with("old", "alpha", lambda a, b: a + (b - a) / parts)
        moved = new.join(old, new["id"] == old["old_id"]).select("id", "vector", "label", "part", mean.alias("alpha"))
        return materialize(moved, "trainer"), change.reshape(self.weights.shape), sum(r.alpha[0] for r in rows) / max(n, 1)

    def train(self, rounds: int) -> DualTrainer:
        for _ in range(rounds):
            self.state, change, slack = self._pass()
            self.trace.append(slack + self.parameters.regulariser / 2 * float((self.weights**2).sum()))
            self.weights = self.weights + change
            self.rounds += 1
        return self

    def dual(self) -> float:
        """The dual objective, which rounds raise: the mean of the dual weights less half lambda times the squared length of the weights."""
        mean = self.state.agg(F.avg(F.aggregate("alpha", F.lit(0.0), lambda a, v: a + v))).first()[0] or 0.0
        return mean - self.parameters.regulariser / 2 * float((self.weights**2).sum())

    def add(self, points: DataFrame) -> DualTrainer:
        """More examples, without any dual weight yet; those whose id is known are left out.  The weights shrink as the number grows."""
        before = self.state.count()
        known = self.state.select(F.col("id").alias("known_id"))
        part = F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(self.parameters.parts)).cast("int")
        rows = points.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.col("label").cast("int").alias("label"), part.alias("part"))
        rows = rows.join(known, rows["id"] == known["known_id"], "left_anti").withColumn("alpha", F.array_repeat(F.lit(0.0), self.classes))
        return self._replaced(self.state.unionByName(rows), before)

    def remove(self, ids: DataFrame) -> DualTrainer:
        """Without the examples in ``ids`` (id), whose share of the weights is taken back."""
        gone = ids.select(F.col("id").cast("long").alias("gone_id")).distinct()
        return self._replaced(self.state.join(gone, self.state["id"] == gone["gone_id"], "left_anti"), self.state.count(), self.state.join(gone, self.state["id"] == gone["gone_id"], "left_semi"))

    def relabel(self, labels: DataFrame) -> DualTrainer:
        """Examples (id, label) under another label: their share of the weights is taken back, and they start anew."""
        new = labels.select(F.col("id").cast("long").alias("new_id"), F.col("label").cast("int").alias("new_label"))
        joined = self.state.join(new, self.state["id"] == new["new_id"], "left")
        told = F.col("new_id").isNotNull()
        rows = joined.select("id", "vector", F.coalesce("new_label", "label").alias("label"), "part", F.when(told, F.array_repeat(F.lit(0.0), self.classes)).otherwise(F.col("alpha")).alias("alpha"))
        return self._replaced(rows, self.state.count(), self.state.join(new, self.state["id"] == new["new_id"], "left_semi"))

    def _replaced(self, rows: DataFrame, before: int, gone: DataFrame | None = None) -> DualTrainer:
        taken = self._share(gone) if gone is not None else 0.0
        self.state = materialize(rows, "trainer")
        after = self.state.count()
        lam = self.parameters.regulariser
        self.weights = (self.weights * (lam * before) - taken) / (lam * max(after, 1))
        return self

    def _share(self, rows: DataFrame) -> np.ndarray:
        """Sum of dual weights times feature differences of some examples."""
        flat = rows.select("label", F.posexplode("alpha").alias("class", "a"), "vector").where("a <> 0")
        both = flat.select("class", (-F.col("a")).alias("a"), "vector").unionByName(flat.select(F.col("label").alias("class"), "a", "vector"))
        sums = both.select("class", "a", F.posexplode("vector").alias("j", "x")).groupBy("class", "j").agg(F.sum(F.col("a") * F.col("x")).alias("v"))
        out = np.zeros(self.weights.shape)
        for r in sums.collect():
            out[r["class"], r.j] = r.v
        return out

    def predict(self, points: DataFrame) -> DataFrame:
        """(id, label, score) of the best class; ties go to the smaller."""
        from tessella.operators.learning import Learner

        learner = Learner(self.classes)
        learner.weights = self.weights
        return learner.predict(points)

    def errors(self, points: DataFrame) -> float | None:
        """Share of ``points`` (id, vector, label) whose label is not the best class; null without any."""
        told = self.predict(points).withColumnRenamed("label", "told")
        return told.join(points.select(F.col("id").alias("of"), "label"), F.col("id") == F.col("of")).agg(F.avg((F.col("told") != F.col("label")).cast("double"))).first()[0]

    def save(self, path: str, full: bool = True) -> None:
        """The model as one JSON row under <path>/model; with ``full`` also the training state under <path>/state."""
        spark = self.state.sparkSession
        head = {"classes": self.classes, "parameters": asdict(self.parameters), "rounds": self.rounds, "weights": self.weights.tolist(), "trace": self.trace}
        spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
        if full:
            self.state.write.mode("overwrite").parquet(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str, full: bool = True) -> DualTrainer:
        head = json.loads(spark.read.text(f"{path}/model", wholetext=True).first().value)
        out = cls(head["classes"], Parameters(**head["parameters"]), head["rounds"], np.array(head["weights"]), None, head["trace"])
        if full:
            out.state = materialize(spark.read.parquet(f"{path}/state"), "trainer")
        return out


def mined_rounds(trainer: DualTrainer, points: DataFrame, rounds: int, most: int) -> DualTrainer:
    """Hard negatives: start from part of the examples, then add, round by round, the ``most`` others that the model gets most wrong."""
    first = points.where(F.pmod(F.xxhash64("id"), F.lit(4)) == 0)
    trainer.start(first).train(1)
    for _ in range(rounds):
        told = trainer.predict(points).withColumnsRenamed({"id": "of", "label": "told"})
        known = trainer.state.select(F.col("id").alias("known"))
        wrong = points.join(told, (points["id"] == told["of"]) & (points["label"] != told["told"])).join(known, points["id"] == F.col("known"), "left_anti")
        trainer.add(wrong.orderBy(F.col("score").desc(), "id").limit(most).select("id", "vector", "label")).train(1)
    return trainer


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("latest_place", F.row_number().over(last)).where("latest_place = 1").drop("latest_place")
