"""Session logs and the table of open sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_SESSIONS = 20


def timeline(logs: DataFrame) -> DataFrame:
    """(session, at, kind, what) of nested logs: starts, questions, results, removals, views and ends, as one table.

    ``logs``: session, start_session, questions, results, removals, detail_views, end_session; the six parts are
    made one array of events and exploded, so that each log is read once.
    """

    def events(column: str, kind: Column | str, what: str) -> Column:
        name = kind if isinstance(kind, Column) else F.lit(kind)
        return F.transform(F.coalesce(F.col(column), F.array()), lambda e: F.struct(e["time"].cast("long").alias("at"), name.alias("kind"), e[what].cast("string").alias("what")))

    start = F.struct(F.col("start_session.time").cast("long").alias("at"), F.lit("start").alias("kind"), F.col("start_session.imageName").alias("what"))
    end = F.struct(F.col("end_session.time").cast("long").alias("at"), F.lit("end").alias("kind"), F.col("end_session.selection").alias("what"))
    asked = F.transform(
        F.coalesce(F.col("questions"), F.array()), lambda e: F.struct(e["time"].cast("long").alias("at"), F.concat(F.lit("question_"), e["stage"]).alias("kind"), e["id"].cast("string").alias("what"))
    )
    every = F.concat(F.array(start), asked, events("results", "results", "classes"), events("removals", "removal", "class"), events("detail_views", "view", "class"), F.array(end))
    return logs.select("session", F.explode(every).alias("e")).select("session", "e.*").where(F.col("at").isNotNull())


def folded(events: DataFrame) -> DataFrame:
    """One row a user: counts by kind, first and last time, and whole seconds between."""
    out = events.groupBy("user_id").agg(
        F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count_if(F.col("kind") == "click").alias("clicks"), F.countDistinct("question").alias("questions")
    )
    return out.withColumn("seconds", F.floor((F.col("last_at") - F.col("first_at")) / 1000))


def evicted(sessions: DataFrame, most: int = MOST_SESSIONS) -> DataFrame:
    """Sessions (session, stamp, finished) with a column evicted: beyond ``most``, finished ones go first, then the oldest."""
    order = F.struct((~F.col("finished")).cast("int"), F.col("stamp"), F.col("session"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order))
    total = F.count("*").over(Window.partitionBy(F.lit(0)))
    return sessions.withColumn("evicted", rank <= F.greatest(total - most, F.lit(0)))


def latest_version(logs: DataFrame) -> DataFrame:
    """Of each user's and image's logs the one of the highest version."""
    return logs.groupBy("user", "image").agg(F.max_by(F.struct(*[c for c in logs.columns if c not in ("user", "image")]), "version").alias("last")).select("user", "image", "last.*")


def gap_sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """(user_id, first_at, last_at, n): runs of events without a pause of ``gap_seconds`` or more.

    A pause of just ``gap_seconds`` parts two runs, which ``session_window``
    would join.  Events without a time are one run of
    their user, and those without a user have runs like any other.
    """
    by_time = Window.partitionBy("user_id").orderBy(F.col("at").asc_nulls_last())
    begins = F.when(F.col("at") - F.lag("at").over(by_time) < gap_seconds * 1000, 0).otherwise(1)
    runs = events.select("user_id", "at", begins.alias("begins")).withColumn("run", F.sum("begins").over(by_time))
    return runs.groupBy("user_id", "run").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n")).drop("run")


def session_documents(events: DataFrame) -> DataFrame:
    """(user_id, document): each session's events (user_id, at, event_id, kind, question, value) as one JSON text, with an array for each kind, in order of time.

    A session's events are bounded by what one person does; they meet in one row.
    """
    row = F.struct("at", "event_id", "question", "value")
    by_kind = events.groupBy("user_id", "kind").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    pairs = F.sort_array(F.collect_list(F.struct("kind", F.transform("rows", lambda r: F.struct(r["question"].alias("id"), r["at"].cast("string").alias("time"))).alias("rows"))))
    return by_kind.groupBy("user_id").agg(F.to_json(F.map_from_entries(pairs)).alias("document"))


def found_or_created(sessions: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """The table of sessions (session_id, started) with those that are asked for by name and not there yet, begun now."""
    known = sessions.select(F.col("session_id").alias("known_id"))
    new = asked.select("session_id").where("session_id is not null").distinct()
    return sessions.unionByName(new.join(known, F.col("session_id") == F.col("known_id"), "left_anti").withColumn("started", F.lit(now).cast("long")).select(*sessions.columns))
