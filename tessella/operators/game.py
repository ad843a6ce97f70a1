"""The question game: likelihoods, choice of questions by information gain, posteriors, whole sessions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.probability import entropy, normalise, powered
from tessella.operators.ordering import unit_of
from tessella.session import ship


def likelihood(p: Column, answer: Column, weight: Column, gamma: float = 1.0) -> Column:
    """Probability of an answer: p or 1 - p, to the power gamma times the certainty's weight."""
    return powered(F.when(answer == 1, p).otherwise(1 - p), F.lit(gamma) * weight)


def binary_answers(priors: DataFrame, model: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(session, attribute, certainty, answer, class, u): joint weight of each answer to each yes-no question and class.

    ``priors``: session, class, p; ``model``: class, attribute, certainty, weight, p.
    """
    told = model.select("class", "attribute", "certainty", "weight", F.col("p").alias("q"), F.explode(F.array(F.lit(0), F.lit(1))).alias("answer"))
    joined = priors.join(told, "class")
    return joined.select("session", "attribute", "certainty", "answer", "class", (F.col("p") * likelihood(F.col("q"), F.col("answer"), F.col("weight"), gamma)).alias("u"))


def choice_answers(priors: DataFrame, model: DataFrame, choices: DataFrame, gamma: float = 1.0) -> DataFrame:
    """The same for multiple choice: only 'yes' to one of the attributes of each question.  ``choices``: question, attribute."""
    joined = priors.join(model.withColumnRenamed("p", "q"), "class").join(choices, "attribute")
    u = F.col("p") * powered(F.col("q"), F.lit(gamma) * F.col("weight"))
    return joined.select("session", "question", "certainty", F.col("attribute").alias("answer"), "class", u.alias("u"))


def expected_entropy(joint: DataFrame, *question: str, answer: tuple[str, ...] = ("certainty", "answer")) -> DataFrame:
    """Mean entropy over classes after each question's answer, weighted by the answers' probabilities.

    From sums of u and of u ln u by answer: H = ln(U) - sum(u ln u) / U; one shuffle by answer, one by question.
    """
    by_answer = joint.groupBy(*question, *answer).agg(F.sum("u").alias("mass"), F.sum(F.when(F.col("u") > 0, F.col("u") * F.ln("u")).otherwise(F.lit(0.0))).alias("ulnu"))
    h = F.when(F.col("mass") > 0, F.col("mass") * F.ln("mass") - F.col("ulnu")).otherwise(F.lit(0.0))
    return by_answer.groupBy(*question).agg((F.sum(h) / F.sum("mass")).alias("expected_entropy"))


def select_question(gains: DataFrame, asked: DataFrame | None = None, seconds: DataFrame | None = None) -> DataFrame:
    """The question of the largest gain (or gain a second) of each session; ties to the lower number.

    ``gains``: session, attribute, gain; ``asked``: session, attribute; ``seconds``: attribute, seconds.
    """
    free = gains if asked is None else gains.join(asked, ["session", "attribute"], "left_anti")
    if seconds is not None:
        free = free.join(seconds, "attribute").withColumn("gain", F.col("gain") / F.col("seconds"))
    best = F.max(F.struct(F.round("gain", 9).alias("gain"), (-F.col("attribute")).alias("minus")))
    return free.groupBy("session").agg(best.alias("best")).select("session", (-F.col("best.minus")).alias("attribute"), F.col("best.gain").alias("gain"))


def posterior(answers: DataFrame, model: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(session, class, p) after all of a session's answers, from equal priors.

    ``answers``: session, attribute, answer, certainty.  Logarithms are summed,
    with a flag for factors of 0.
    """
    joined = answers.join(model, ["attribute", "certainty"])
    told = likelihood(F.col("p"), F.col("answer"), F.col("weight"), gamma)
    terms = joined.groupBy("session", "class").agg(F.sum(F.when(told > 0, F.ln(told)).otherwise(F.lit(0.0))).alias("logit"), F.max((told <= 0).cast("int")).alias("none"))
    top = F.max(F.when(F.col("none") == 0, F.col("logit"))).over(Window.partitionBy("session"))
    mass = F.when(F.col("none") == 0, F.exp(F.col("logit") - top)).otherwise(F.lit(0.0))
    return terms.withColumn("mass", mass).select("session", "class", normalise(F.col("mass"), "session").alias("p"))


def ranked(probabilities: DataFrame) -> DataFrame:
    """Classes of each session from the most probable one, ties by class."""
    order = Window.partitionBy("session").orderBy(F.round("p", 9).desc(), "class")
    return probabilities.withColumn("rank", F.row_number().over(order))


def verified(probabilities: DataFrame, verdicts: DataFrame) -> DataFrame:
    """After a user has confirmed (that class alone stays) or rejected a class (it goes, the rest is normalised).

    ``verdicts``: session, verified_class, confirmed.
    """
    joined = probabilities.join(verdicts, "session", "left")
    same = F.col("class") == F.col("verified_class")
    mass = F.when(F.col("confirmed").isNull(), F.col("p")).when(F.col("confirmed"), same.cast("double")).otherwise(F.when(same, F.lit(0.0)).otherwise(F.col("p")))
    return joined.withColumn("mass", mass).select("session", "class", normalise(F.col("mass"), "session").alias("p"))


def session_entropy(probabilities: DataFrame) -> DataFrame:
    return probabilities.groupBy("session").agg(entropy(F.col("p")).alias("entropy"))


class Model:
    """A response model as arrays: p by class and attribute, weights of certainties."""

    def __init__(self, rows: list, gamma: float):
        self.classes = sorted({r["class"] for r in rows})
        self.attributes = sorted({r["attribute"] for r in rows})
        certainties = sorted({r["certainty"] for r in rows})
        self.p = np.zeros((len(self.classes), len(self.attributes)))
        self.weight = np.zeros(max(certainties) + 1)
        for r in rows:
            self.p[self.classes.index(r["class"]), self.attributes.index(r["attribute"])] = r["p"]
            self.weight[r["certainty"]] = r["weight"]
        exponent = gamma * self.weight[:, None, None]
        yes = np.where(self.p > 0, np.exp(exponent * np.log(np.where(self.p > 0, self.p, 1))), 0.0)
        no = np.where(self.p < 1, np.exp(exponent * np.log(np.where(self.p < 1, 1 - self.p, 1))), 0.0)
        self.told = np.stack([no, yes])  # answer, certainty, class, attribute
        flat = self.told.transpose(2, 0, 1, 3).reshape(len(self.classes), -1)
        self._flat, self._inner = flat, np.where(flat > 0, flat * np.log(np.where(flat > 0, flat, 1)), 0.0)

    def gains(self, prior: np.ndarray) -> np.ndarray:
        """Information gain of each attribute's question, in nats, for each row of ``prior`` (sessions, classes).

        With u = p t the sum of u ln u over classes is (p ln p) t + p (t ln t), so that all is three matrix products.
        """
        rows = np.atleast_2d(prior)
        plogp = np.where(rows > 0, rows * np.log(np.where(rows > 0, rows, 1)), 0.0)
        shape = (len(rows), -1, len(self.attributes))
        mass = (rows @ self._flat).reshape(shape)
        inner = (plogp @ self._flat + rows @ self._inner).reshape(shape)
        after = (np.where(mass > 0, mass * np.log(np.where(mass > 0, mass, 1)), 0.0) - inner).sum(axis=1)
        total = mass.sum(axis=1)
        out = -plogp.sum(axis=1)[:, None] - after / np.where(total > 0, total, 1)
        return out if prior.ndim > 1 else out[0]


#: A model of at most so many rows (classes times attributes times certainties) is sent to each worker.
MOST_CELLS = 2_000_000


def play(responses: DataFrame, model: DataFrame, rounds: int = 20, select: str = "gain", stop_early: bool = False, gamma: float = 1.0) -> DataFrame:
    """Every session of recorded answers, question by question.

    ``responses``: example, class, attribute, answer, certainty, seconds; one
    answer an attribute.  Returns session, round (0 before any answer),
    question, answer, certainty, elapsed seconds, rank and probability of the
    true class, and the top class.  ``select``: gain, time (gain a second) or
    order.  With ``stop_early`` a top class that is wrong is struck out, and a
    session ends when it is right.

    Sessions do not meet: answers are gathered by session in one shuffle, and
    all rounds of a session are played where it lies.  The model, classes by
    attributes, is bounded by ``MOST_CELLS``.
    """
    spark = responses.sparkSession
    ship(spark)
    rows = [r.asDict() for r in model.select("class", "attribute", "certainty", "weight", "p").limit(MOST_CELLS + 1).collect()]
    if len(rows) > MOST_CELLS:
        raise ValueError("the response model is too large to be sent to each worker")
    held = spark.sparkContext.broadcast(Model(rows, gamma))
    times = {}
    if select == "time":
        times = {r.attribute: r.seconds for r in responses.groupBy("attribute").agg(F.avg("seconds").alias("seconds")).collect()}
    told = F.sort_array(F.collect_list(F.struct("attribute", "answer", "certainty", "seconds")))
    sessions = responses.groupBy(F.col("example").alias("session"), "class").agg(told.alias("told"))
    names = ["session", "class", "round", "question", "answer", "certainty", "elapsed", "true_rank", "true_p", "top_class"]
    kinds = ["long", "int", "int", "int", "int", "int", "double", "int", "double", "int"]

    def history(part: pa.RecordBatch) -> pa.RecordBatch:
        m = held.value
        place = {a: i for i, a in enumerate(m.attributes)}
        wait = np.array([max(times.get(a, 1.0), 1e-9) for a in m.attributes])
        rows = part.to_pylist()
        n, c, a = len(rows), len(m.classes), len(m.attributes)
        y, k, seconds = np.full((n, a), -1), np.zeros((n, a), int), np.zeros((n, a))
        for i, row in enumerate(rows):
            for t in row["told"]:
                if t["attribute"] in place:
                    j = place[t["attribute"]]
                    y[i, j], k[i, j], seconds[i, j] = t["answer"], t["certainty"], t["seconds"]
        number = {v: i for i, v in enumerate(m.classes)}
        truth = np.array([number.get(row["class"], -1) for row in rows])
        session, cls = np.array([row["session"] for row in rows]), np.array([row["class"] for row in rows])
        prior, free, elapsed = np.full((n, c), 1.0 / c), y >= 0, np.zeros(n)
        out: list[list] = [[] for _ in names]

        def record(at: np.ndarray, step: int, asked: np.ndarray | None) -> np.ndarray:
            order = np.argsort(-np.round(prior[at], 9), axis=1, kind="stable")
            known = truth[at] >= 0
            rank = (order == truth[at][:, None]).argmax(axis=1) + 1
            chance = prior[at, np.maximum(truth[at], 0)]
            none = [None] * len(at)
            columns = (
                session[at].tolist(), cls[at].tolist(), [step] * len(at), none if asked is None else np.array(m.attributes)[asked].tolist(),
                none if asked is None else y[at, asked].tolist(), none if asked is None else k[at, asked].tolist(), elapsed[at].tolist(),
                [int(r) if ok else None for r, ok in zip(rank, known)], [float(p) if ok else None for p, ok in zip(chance, known)], np.array(m.classes)[order[:, 0]].tolist(),
            )
            for held_column, new in zip(out, columns):
                held_column.extend(new)
            return order[:, 0]

        record(np.arange(n), 0, None)
        for step in range(1, rounds + 1):
            at = np.flatnonzero(free.any(axis=1))
            if not len(at):
                break
            if select == "order":
                pick = free[at].argmax(axis=1)
            else:
                gain = m.gains(prior[at])
                gain = np.round(gain / wait if select == "time" else gain, 9)
                pick = np.where(free[at], gain, -np.inf).argmax(axis=1)
            free[at, pick] = False
            elapsed[at] += seconds[at, pick]
            mass = prior[at] * m.told[y[at, pick], k[at, pick], :, pick]
            total = mass.sum(axis=1, keepdims=True)
            prior[at] = np.where(total > 0, mass / np.where(total > 0, total, 1), mass)
            top = record(at, step, pick)
            if stop_early:
                right = top == truth[at]
                free[at[right]] = False
                wrong = at[~right]
                prior[wrong, top[~right]] = 0.0
                total = prior[wrong].sum(axis=1, keepdims=True)
                prior[wrong] = np.where(total > 0, prior[wrong] / np.where(total > 0, total, 1), prior[wrong])
        arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        return pa.RecordBatch.from_arrays([pa.array(col, arrow[kind]) for col, kind in zip(out, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                yield history(batch.slice(low, 512))

    return sessions.mapInArrow(run, ", ".join(f"{n} {kind}" for n, kind in zip(names, kinds)))


def accuracy_by_round(history: DataFrame, window: int = 1, rounds: int = 20) -> DataFrame:
    """(round, accuracy, sessions): how often the truth is within the first ``window`` ranks; ended sessions keep their last state."""
    last = history.groupBy("session").agg(F.max_by(F.struct("true_rank"), "round").alias("last"), F.max("round").alias("ends"))
    full = last.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    joined = full.join(history.select("session", "round", "true_rank"), ["session", "round"], "left")
    rank = F.coalesce("true_rank", "last.true_rank")
    return joined.groupBy("round").agg(F.avg((rank <= window).cast("double")).alias("accuracy"), F.count("*").alias("sessions"))


def batch_answers(priors: DataFrame, model: DataFrame, questions: DataFrame, samples: int = 500, seed: int = 0) -> DataFrame:
    """(session, question, sample, class, u) for batches of yes-no questions, by ``samples`` joint draws.

    ``questions``: question, attribute (one row a member), asked at the most
    certain level.  Each draw takes for each member an answer by its marginal
    probability; u is the class's probability times its ratios for the answers
    drawn, over the number of samples.  Draws depend on session, question,
    sample and attribute only.
    """
    sure = model.groupBy("attribute", "class").agg(F.max_by("p", "weight").alias("q"), F.max("weight").alias("weight"))
    known = priors.join(sure, "class").join(questions, "attribute")
    yes = powered(F.col("q"), F.col("weight"))
    no = powered(1 - F.col("q"), F.col("weight"))
    known = known.withColumns({"yes": yes, "no": no})
    by = Window.partitionBy("session", "question", "attribute")
    share = F.sum(F.col("p") * F.col("yes")).over(by) / (F.sum(F.col("p") * (F.col("yes") + F.col("no"))).over(by))
    drawn = known.withColumn("share", share).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    drawn = drawn.withColumn("answer", (unit_of("session", "question", "sample", "attribute", seed=seed) < F.col("share")).cast("int"))
    factor = F.when(F.col("answer") == 1, F.col("yes") / F.col("share")).otherwise(F.col("no") / (1 - F.col("share")))
    mass = drawn.groupBy("session", "question", "sample", "class").agg(F.first("p").alias("p"), F.exp(F.sum(F.when(factor > 0, F.ln(factor)))).alias("ratio"), F.max((factor <= 0).cast("int")).alias("none"))
    return mass.select("session", "question", "sample", "class", (F.when(F.col("none") == 1, F.lit(0.0)).otherwise(F.col("p") * F.col("ratio")) / samples).alias("u"))


def click_answers(samples: DataFrame, clicks: DataFrame, gamma: float, weights: tuple[float, float]) -> DataFrame:
    """Class probabilities by click: location samples weighed by exp(-gamma * spring) of their distance to each click.

    ``samples``: session, sample, x, y, class, p; ``clicks``: session, click, x, y.  Pairs stay within a session.
    """
    near = samples.join(clicks.withColumnsRenamed({"x": "cx", "y": "cy"}), "session")
    spring = F.lit(weights[0]) * F.pow(F.col("x") - F.col("cx"), 2) + F.lit(weights[1]) * F.pow(F.col("y") - F.col("cy"), 2)
    k = F.exp(-F.lit(gamma) * spring)
    out = near.groupBy("session", "click", "class").agg(F.sum(k * F.col("p")).alias("u"))
    return out.withColumn("p", normalise(F.col("u"), "session", "click"))
