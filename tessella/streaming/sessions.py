"""Streams: question sessions as keyed state, examples with retraction, windowed statistics."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.game import MOST_CELLS, Model
from tessella.session import shared_folder, ship

REPLY = "session_id string, seq long, method string, ok boolean, question int, top_class int, top_p double, asked int, elapsed double"


def question_sessions(requests: DataFrame, model: DataFrame, gamma: float = 1.0, idle_minutes: int | None = 120) -> DataFrame:
    """Replies to requests, session by session: initialize_20q, next_question, answer_question, verify_class.

    ``requests`` (a stream): session_id, seq, method, question_id, answer,
    certainty, response_time, class, verified.  State a session: posterior,
    questions asked, seconds.  A request before initialize_20q, to an unknown
    question, or asked already, is answered with ok = false and changes nothing.
    The state of a session that has been idle for ``idle_minutes`` is dropped;
    a stream that ends with its input (available now) takes None, as it would
    wait for idle sessions for ever.
    The model is bounded as in ``game.play``.
    """
    ship(requests.sparkSession)
    rows = [r.asDict() for r in model.select("class", "attribute", "certainty", "weight", "p").limit(MOST_CELLS + 1).collect()]
    if len(rows) > MOST_CELLS:
        raise ValueError("the response model is too large to be sent to each worker")
    held = requests.sparkSession.sparkContext.broadcast(Model(rows, gamma))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        m = held.value
        prior, asked, elapsed = (json.loads(state.get[0]) if state.exists else (None, [], 0.0))
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").to_dict("records"):
            method, ok, question = row["method"], True, None
            p = np.array(prior) if prior is not None else None
            if method == "initialize_20q":
                p, asked, elapsed = np.full(len(m.classes), 1 / len(m.classes)), [], 0.0
            elif p is None:
                ok = False
            elif method == "answer_question":
                q, a, c = row["question_id"], row["answer"], row["certainty"]
                ok = q in m.attributes and q not in asked and a in (0, 1) and 0 <= (c if c == c else -1) < len(m.weight)
                if ok:
                    p = p * m.told[int(a), int(c), :, m.attributes.index(q)]
                    p = p / p.sum() if p.sum() > 0 else p
                    asked, elapsed = [*asked, int(q)], elapsed + float(row["response_time"] or 0)
            elif method == "verify_class":
                ok = row["class"] in m.classes
                if ok:
                    at = m.classes.index(row["class"])
                    p = np.eye(len(p))[at] if row["verified"] else np.where(np.arange(len(p)) == at, 0, p)
                    p = p / p.sum() if p.sum() > 0 else p
            elif method != "next_question":
                ok = False
            if p is not None:
                gain = np.round(m.gains(p), 9)
                gain[[m.attributes.index(q) for q in asked]] = -np.inf
                question = m.attributes[int(gain.argmax())] if len(asked) < len(m.attributes) else None
                prior = p.tolist()
            top = int(np.lexsort((np.arange(len(p)), -np.round(p, 9)))[0]) if p is not None else None
            out.append((key[0], row["seq"], method, ok, question, m.classes[top] if top is not None else None, float(p[top]) if top is not None else None, len(asked), elapsed))
        state.update((json.dumps([prior, asked, elapsed]),))
        if idle_minutes is not None:
            state.setTimeoutDuration(idle_minutes * 60_000)
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in REPLY.split(", ")])
        yield frame.astype({"question": "Int32", "top_class": "Int32"})

    return requests.groupBy("session_id").applyInPandasWithState(step, REPLY, "state string", "append", GroupStateTimeout.NoTimeout if idle_minutes is None else GroupStateTimeout.ProcessingTimeTimeout)


def class_counts(events: DataFrame) -> DataFrame:
    """Changes of (label, n, total) as examples are added, relabelled and removed.

    ``events`` (a stream): example, seq, action, label, value.  The state of an
    example is its present contribution, which is taken back before a new one
    counts; sums of the changes by label are the current totals.
    """

    ship(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        first = old
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            old = None if row.action == "remove" else (str(row.label), float(row.value))
        if old is None:
            if state.exists:
                state.remove()
        else:
            state.update(old)
        out = [(label, sign, sign * value) for part, sign in ((first, -1), (old, 1)) if part is not None for label, value in [part]]
        yield pd.DataFrame(out, columns=["label", "n", "total"]).astype({"label": "object", "n": "int64", "total": "float64"})

    return events.groupBy("example").applyInPandasWithState(step, "label string, n long, total double", "label string, value double", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, minutes: int = 60, late_minutes: int = 120) -> DataFrame:
    """(window start, kind, n, total) in event time; events later than the watermark are left out."""
    return (
        events.withWatermark("ts", f"{late_minutes} minutes")
        .groupBy(F.window("ts", f"{minutes} minutes"), "kind")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "kind", "n", "total")
    )


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream over files yields now, written to the shared folder in micro-batches and read back."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/tessella-stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def event_stream(spark: SparkSession, sf_dir: str, per_batch: int = 1) -> DataFrame:
    """The table of events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def train_on_stream(stream: DataFrame, learner, rounds: int = 3):
    """Each micro-batch (id, vector, label) carries the learner on, after a progressive test on it; returns the query's writer.

    ``learner.history`` gets (batch, rows, errors before training on it).
    """
    learner.history = []

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            rows = batch.count()
            if rows:
                errors = None
                if learner.weights is not None:
                    told = learner.predict(batch).withColumnRenamed("label", "told").join(batch.select("id", "label"), "id")
                    errors = told.where("told <> label").count()
                learner.history.append((number, rows, errors))
                learner.train(batch, rounds)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(step)
