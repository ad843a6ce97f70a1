"""The question game with questions of all kinds: yes-no, multiple choice, batches and clicks."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.game import MOST_CELLS, Model
from tessella.session import ship

#: Members of a batch at most: all of their joint answers are weighed.
MOST_MEMBERS = 10
KINDS = ("binary", "multiple", "batch", "click")


class Questions:
    """Questions over a response model: the likelihood of each possible answer for each class, end to end."""

    def __init__(self, model: Model, rows: list[dict]):
        self.model, self.rows = model, rows
        self.place = {a: i for i, a in enumerate(model.attributes)}
        sure = int(model.weight.argmax())
        blocks = []
        for q in rows:
            at = [self.place[a] for a in q["attributes"]]
            if q["kind"] == "binary":
                block = model.told[:, :, :, at[0]].reshape(-1, len(model.classes))
            elif q["kind"] == "multiple":
                block = np.concatenate([model.told[1, :, :, a] for a in at])
            elif q["kind"] == "batch":
                block = np.array([np.prod([model.told[y, sure, :, a] for y, a in zip(answer, at)], axis=0) for answer in itertools.product((0, 1), repeat=len(at))])
            else:
                block = np.zeros((0, len(model.classes)))
            blocks.append(block)
        self.bounds = np.cumsum([0, *map(len, blocks)])
        self.table = np.concatenate(blocks)

    def gains(self, prior: np.ndarray, clicks: dict[int, np.ndarray]) -> np.ndarray:
        """Information gain of each question, in nats; ``clicks``: likelihoods (click, class) of those that ask for one."""
        sizes = np.diff(self.bounds)
        out = np.full(len(self.rows), -np.inf)
        before = -float((prior[prior > 0] * np.log(prior[prior > 0])).sum())

        def after(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            u = table * prior
            mass = u.sum(axis=1)
            safe = lambda x: np.where(x > 0, x * np.log(np.where(x > 0, x, 1)), 0.0)
            return safe(mass) - safe(u).sum(axis=1), mass

        if len(self.table):
            left, mass = after(self.table)
            full = np.flatnonzero(sizes)
            total = np.add.reduceat(mass, self.bounds[:-1][full])
            out[full] = before - np.add.reduceat(left, self.bounds[:-1][full]) / np.where(total > 0, total, 1)
        for k, table in clicks.items():
            left, mass = after(table)
            out[k] = before - left.sum() / mass.sum() if mass.sum() > 0 else 0.0
        return out

    def told(self, k: int, said: dict[int, dict]) -> tuple[np.ndarray, int | None, float] | None:
        """What a session's recorded answers (by attribute) say to question k: likelihood by class, the answer as a number, seconds; None where they say nothing."""
        q, m = self.rows[k], self.model
        known = [a for a in q["attributes"] if a in said]
        if not known:
            return None
        like = lambda a, y, c: m.told[y, c, :, self.place[a]]
        if q["kind"] == "binary":
            s = said[known[0]]
            return like(known[0], s["answer"], s["certainty"]), s["answer"], s["seconds"]
        if q["kind"] == "multiple":
            yes = [a for a in known if said[a]["answer"] == 1]
            if yes:
                s = said[yes[-1]]
                return like(yes[-1], 1, s["certainty"]), yes[-1], s["seconds"]
            return like(known[0], 0, 0), None, said[known[0]]["seconds"]
        out = np.prod([like(a, said[a]["answer"], said[a]["certainty"]) for a in known], axis=0)
        return out, sum(said[a]["answer"] << i for i, a in enumerate(known)), sum(said[a]["seconds"] for a in known)


def click_table(x: np.ndarray, y: np.ndarray, p: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, spring: tuple[float, float]) -> np.ndarray:
    """Likelihoods (click, class) of clicks at some places, out of samples of a part's place with class probabilities each (sample, class)."""
    near = np.exp(-(spring[0] * (x[None, :] - at_x[:, None]) ** 2 + spring[1] * (y[None, :] - at_y[:, None]) ** 2))
    return near @ p


def play_mixed(
    responses: DataFrame, model: DataFrame, questions: DataFrame, rounds: int = 60, select: str = "gain", stop_early: bool = False, gamma: float = 1.0,
    clicks: DataFrame | None = None, spring: tuple[float, float] = (0.01, 0.01),
) -> DataFrame:
    """Every session of recorded answers, with questions of all kinds.

    ``questions``: question, kind (see ``KINDS``), attributes array<int> in
    order (empty for clicks), seconds.  ``responses``: as in ``game.play``, of
    the first user.  ``clicks``: example, question, x, y, seconds, and samples
    array<struct<x, y, p array<double>>> of the part's place, with class
    probabilities in order of the classes.

    A question's gain is that of all its possible answers: yes or no with each
    certainty, one choice with each, each joint answer of a batch at the most
    certain level, or a click at each sampled place.  ``select``: gain, time
    (gain a second) or order.  Recorded answers come as test examples give
    them: of a choice the last that is there, and without any a no to the
    first, least certain; of a batch all that are known.  Returns session,
    class, round (0 before any answer), question, kind, answer (a choice's
    attribute, a batch's answers as bits, null for clicks), elapsed, true_rank,
    true_p, top_class.

    Sessions do not meet: a session's answers are gathered in one row and
    played where it lies.  Model and questions are bounded by ``MOST_CELLS``.
    """
    spark = responses.sparkSession
    ship(spark)
    rows = [r.asDict() for r in model.select("class", "attribute", "certainty", "weight", "p").limit(MOST_CELLS + 1).collect()]
    asked = [r.asDict() for r in questions.select("question", "kind", "attributes", "seconds").orderBy("question").limit(MOST_CELLS + 1).collect()]
    if len(rows) > MOST_CELLS or len(asked) > MOST_CELLS:
        raise ValueError("the model or its questions are too large to be sent to each worker")
    known = {r["attribute"] for r in rows}
    for q in asked:
        if q["kind"] not in KINDS or (q["kind"] != "click") != bool(q["attributes"]) or len(q["attributes"] or []) > MOST_MEMBERS * (1 + (q["kind"] != "batch") * 1000):
            raise ValueError(f"question {q['question']} is of no known kind, or has no attributes, or too many")
        q["attributes"] = [a for a in q["attributes"] or [] if a in known]
    asked = [q for q in asked if q["attributes"] or q["kind"] == "click"]
    held = spark.sparkContext.broadcast((Model(rows, gamma), asked))
    said = F.collect_list(F.struct("attribute", "answer", "certainty", "seconds"))
    sessions = responses.groupBy(F.col("example").cast("long").alias("session"), F.col("class").cast("int").alias("class")).agg(F.sort_array(said).alias("said"))
    spot = "array<struct<question int, x double, y double, seconds double, samples array<struct<x double, y double, p array<double>>>>>"
    if clicks is not None:
        where = clicks.groupBy(F.col("example").cast("long").alias("of_session")).agg(F.collect_list(F.struct(*[F.col(c) for c in ("question", "x", "y", "seconds", "samples")])).alias("clicks"))
        sessions = sessions.join(where, sessions["session"] == where["of_session"], "left").drop("of_session")
    else:
        sessions = sessions.withColumn("clicks", F.lit(None).cast(spot))
    names = ["session", "class", "round", "question", "kind", "answer", "elapsed", "true_rank", "true_p", "top_class"]
    kinds = ["long", "int", "int", "int", "string", "int", "double", "int", "double", "int"]

    def history(row: dict, questions: Questions) -> Iterator[tuple]:
        m, asked = questions.model, questions.rows
        said = {s["attribute"]: s for s in row["said"] if s["attribute"] in questions.place}
        spots, tables = {}, {}
        for c in row["clicks"] or []:
            k = next((i for i, q in enumerate(asked) if q["question"] == c["question"] and q["kind"] == "click"), None)
            if k is not None and c["samples"]:
                x, y, p = (np.array([s[n] for s in c["samples"]], float) for n in ("x", "y", "p"))
                tables[k] = click_table(x, y, p, x, y, spring)
                spots[k] = (click_table(x, y, p, np.array([c["x"]]), np.array([c["y"]]), spring)[0], None, c["seconds"])
        answers = {k: spots.get(k) if q["kind"] == "click" else questions.told(k, said) for k, q in enumerate(asked)}
        free = [k for k, a in answers.items() if a is not None]
        prior, elapsed = np.full(len(m.classes), 1 / len(m.classes)), 0.0
        truth = m.classes.index(row["class"]) if row["class"] in m.classes else None

        def state(step: int, k: int | None) -> tuple:
            order = np.argsort(-np.round(prior, 9), kind="stable")
            rank = int(np.flatnonzero(order == truth)[0]) + 1 if truth is not None else None
            q = asked[k] if k is not None else {"question": None, "kind": None}
            return (row["session"], row["class"], step, q["question"], q["kind"], answers[k][1] if k is not None else None, elapsed, rank, float(prior[truth]) if truth is not None else None, int(m.classes[order[0]]))

        yield state(0, None)
        for step in range(1, rounds + 1):
            if not free:
                return
            if select == "order":
                k = free[0]
            else:
                gain = questions.gains(prior, {k: t for k, t in tables.items() if k in free})
                if select == "time":
                    gain = gain / np.array([max(q["seconds"] or 1.0, 1e-9) for q in asked])
                k = min(free, key=lambda i: (-round(float(gain[i]), 9), i))
            free.remove(k)
            like, _, seconds = answers[k]
            mass = prior * like
            prior = mass / mass.sum() if mass.sum() > 0 else mass
            elapsed += float(seconds or 0.0)
            out = state(step, k)
            yield out
            if stop_early:
                if out[-1] == row["class"]:
                    return
                prior = np.where(np.arange(len(prior)) == m.classes.index(out[-1]), 0.0, prior)
                prior = prior / prior.sum() if prior.sum() > 0 else prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, asked = held.value
        questions = Questions(model, asked)
        arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                out = [r for row in batch.slice(low, 256).to_pylist() for r in history(row, questions)]
                columns = list(zip(*out)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, t in zip(columns, kinds)], names)

    return sessions.select("session", "class", "said", "clicks").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, kinds)))
