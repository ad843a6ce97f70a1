"""A model that learns while it is asked: the methods of a learning server over batches of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.sessions import MOST_SESSIONS
from tessella.operators.training import DualTrainer, latest_by
from tessella.session import materialize
from tessella.streaming.rpc import Methods, definitions

_SESSION = "session_id string, started long, label int, score double"
_BODY = "session_id string, example long, vector array<double>, label int, name string, value double, path string, start int, most int, tables map<string,boolean>"


def _result(**columns: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))


class LearningService:
    """Sessions, examples and a trainer behind named methods; ``methods`` serves batches or, by foreachBatch, streams.

    new_session, classify_example, add_example, remove_example,
    relabel_example, get_trainset, plot_stats, evaluate_testset, set_parameter,
    save, get_definitions and shutdown.  A batch's requests of one method are
    answered together: all examples that it adds are one table, trained on
    together.  At most ``MOST_SESSIONS`` sessions are kept; the oldest go first.
    """

    def __init__(self, spark: SparkSession, trainer: DualTrainer, testset: DataFrame | None = None, tables: dict[str, DataFrame] | None = None, rounds: int = 1):
        self.spark, self.trainer, self.testset, self.tables, self.rounds = spark, trainer, testset, tables or {}, rounds
        self.sessions = spark.createDataFrame([], _SESSION)
        self.running, self.clock = True, 0
        self.methods = Methods()
        for name, handler, usage in (
            ("new_session", self.new_session, "start a session, or the one named by session_id anew"),
            ("classify_example", self.classify, "label and score of a vector, kept in the session"),
            ("add_example", self.add, "example, vector, label: learn from one more example"),
            ("remove_example", self.remove, "example: take an example back"),
            ("relabel_example", self.relabel, "example, label: learn an example under another label"),
            ("get_trainset", self.trainset, "start, most: a page of the examples, by id"),
            ("plot_stats", self.stats, "the objective after each round"),
            ("evaluate_testset", self.evaluate, "share of errors on the test set"),
            ("set_parameter", self.set_parameter, "name, value: lambda, C or another parameter"),
            ("save", self.save, "path: write the model and its state"),
            ("get_definitions", self.defined, "tables: a map of names to true"),
            ("shutdown", self.shutdown, "answer no further requests"),
        ):
            self.methods.register(name, self._guarded(handler), usage)

    def _guarded(self, handler: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        """``handler`` over the requests' own fields, or an error for each once the service is shut down."""

        def run(requests: DataFrame) -> DataFrame:
            asked = materialize(requests.withColumn("body", F.from_json("value", _BODY)), "requests")
            if not self.running:
                return asked.withColumn("error", F.lit("shut down")).withColumn("result", F.lit(None).cast("string"))
            return asked.withColumn("result", F.lit(None).cast("string")) if asked.isEmpty() else handler(asked)

        return run

    def new_session(self, asked: DataFrame) -> DataFrame:
        self.clock += 1
        named = asked.withColumn("sid", F.coalesce("body.session_id", F.expr("uuid()")))
        named = materialize(named, "named")
        fresh = named.select(F.col("sid").alias("session_id"), F.lit(self.clock).cast("long").alias("started"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("score")).distinct()
        kept = self.sessions.join(fresh.select("session_id"), "session_id", "left_anti").unionByName(fresh)
        self.sessions = materialize(kept.orderBy(F.col("started").desc(), "session_id").limit(MOST_SESSIONS), "sessions")
        return named.withColumn("result", _result(session_id=F.col("sid")))

    def _vectors(self, asked: DataFrame) -> DataFrame:
        return asked.withColumn("row", F.monotonically_increasing_id())

    def classify(self, asked: DataFrame) -> DataFrame:
        rows = materialize(self._vectors(asked), "asked")
        told = self.trainer.predict(rows.where("body.vector is not null").select(F.col("row").alias("id"), F.col("body.vector").alias("vector")))
        joined = materialize(rows.join(told, rows["row"] == told["id"], "left"), "told")
        seen = joined.where("body.session_id is not null and label is not null").select(F.col("body.session_id").alias("of"), F.col("label").alias("new_label"), F.col("score").alias("new_score"), "row")
        seen = latest_by(seen, "of", "row")
        sessions = self.sessions.join(seen, self.sessions["session_id"] == seen["of"], "left")
        self.sessions = materialize(sessions.select("session_id", "started", F.coalesce("new_label", "label").alias("label"), F.coalesce("new_score", "score").alias("score")), "sessions")
        return joined.withColumn("error", F.when(F.col("label").isNull(), "no vector").otherwise(F.col("error"))).withColumn("result", F.when(F.col("label").isNotNull(), _result(label=F.col("label"), score=F.round("score", 6))))

    def add(self, asked: DataFrame) -> DataFrame:
        good = asked.where("body.example is not null and body.vector is not null and body.label is not null")
        points = latest_by(good.select(F.col("body.example").alias("id"), "body.vector", "body.label").withColumn("row", F.monotonically_increasing_id()), "id", "row").drop("row")
        points = materialize(points, "points")
        if not points.isEmpty():
            (self.trainer.add(points) if self.trainer.state is not None else self.trainer.start(points)).train(self.rounds)
        whole = F.col("body.example").isNotNull() & F.col("body.vector").isNotNull() & F.col("body.label").isNotNull()
        return asked.withColumn("error", F.when(~whole, "example, vector and label are needed").otherwise(F.col("error"))).withColumn("result", F.when(whole, _result(example=F.col("body.example"))))

    def _known(self, asked: DataFrame) -> DataFrame:
        known = self.trainer.state.select(F.col("id").alias("known_id"))
        joined = asked.join(known, F.col("body.example") == F.col("known_id"), "left")
        return materialize(joined.withColumn("error", F.when(F.col("known_id").isNull(), "unknown example").otherwise(F.col("error"))).withColumn("result", F.when(F.col("known_id").isNotNull(), _result(example=F.col("known_id")))), "known")

    def remove(self, asked: DataFrame) -> DataFrame:
        told = self._known(asked)
        self.trainer.remove(told.where("known_id is not null").select(F.col("known_id").alias("id")))
        return told

    def relabel(self, asked: DataFrame) -> DataFrame:
        told = self._known(asked.where("true"))
        new = latest_by(told.where("known_id is not null and body.label is not null").select(F.col("known_id").alias("id"), "body.label").withColumn("row", F.monotonically_increasing_id()), "id", "row").drop("row")
        self.trainer.relabel(new).train(self.rounds)
        return told

    def trainset(self, asked: DataFrame) -> DataFrame:
        rows = []
        for r in asked.select("body.start", "body.most").distinct().collect():
            start, most = r.start or 0, min(r.most or 100, 1000)
            ids = [(x.id, x.label) for x in self.trainer.state.select("id", "label").orderBy("id").offset(start).limit(most).collect()]
            rows.append((r.start, r.most, ids))
        pages = self.spark.createDataFrame(rows, "page_start int, page_most int, examples array<struct<id:long,label:int>>")
        joined = asked.join(pages, F.col("body.start").eqNullSafe(F.col("page_start")) & F.col("body.most").eqNullSafe(F.col("page_most")))
        return joined.withColumn("result", F.to_json(F.struct("examples")))

    def stats(self, asked: DataFrame) -> DataFrame:
        return asked.withColumn("result", _result(rounds=F.lit(self.trainer.rounds), objective=F.array(*[F.lit(round(v, 9)) for v in self.trainer.trace]).cast("array<double>")))

    def evaluate(self, asked: DataFrame) -> DataFrame:
        error = self.trainer.errors(self.testset) if self.testset is not None else None
        return asked.withColumn("result", _result(error=F.lit(error).cast("double")))

    def set_parameter(self, asked: DataFrame) -> DataFrame:
        bad = []
        for r in asked.select("body.name", "body.value").distinct().collect():
            try:
                self.trainer.parameters.set(r.name or "", r.value)
            except (KeyError, TypeError, ZeroDivisionError):
                bad.append(r.name or "")
        wrong = F.coalesce("body.name", F.lit("")).isin(bad) if bad else F.lit(False)
        return asked.withColumn("error", F.when(wrong, "no such parameter").otherwise(F.col("error"))).withColumn("result", F.when(~wrong, _result(name=F.col("body.name"), value=F.col("body.value"))))

    def save(self, asked: DataFrame) -> DataFrame:
        for r in asked.where("body.path is not null").select("body.path").distinct().collect():
            self.trainer.save(r.path)
        return asked.withColumn("result", F.when(F.col("body.path").isNotNull(), _result(path=F.col("body.path"))))

    def defined(self, asked: DataFrame) -> DataFrame:
        named = asked.where("body.tables is not null").select(F.explode("body.tables").alias("name", "is_wanted")).where("is_wanted").select("name").distinct()
        wanted = {r.name: True for r in named.where(F.col("name").isin(list(self.tables))).collect()}
        counts = {name: df.count() for name, df in definitions(self.tables, wanted).items()}
        whole = F.create_map(*[F.lit(v) for kv in counts.items() for v in kv]) if counts else F.create_map().cast("map<string,int>")
        asked_for = F.coalesce("body.tables", F.create_map().cast("map<string,boolean>"))
        return asked.withColumn("result", _result(tables=F.map_filter(whole, lambda k, _: F.coalesce(F.try_element_at(asked_for, k), F.lit(False)))))

    def shutdown(self, asked: DataFrame) -> DataFrame:
        self.running = False
        return asked.withColumn("result", _result(ok=F.lit(True)))
