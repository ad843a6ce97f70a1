"""Queries that run streams over the table of events to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.plans.game_queries import model_of
from tessella.streaming import sessions as st

C = F.col


def x8(spark, d):
    e = st.event_stream(spark, d).select(
        C("user_id").alias("example"), C("event_id").alias("seq"), F.when(C("event_type") == "error", "remove").when(C("event_type") == "view", "relabel").otherwise("add").alias("action"),
        C("event_type").alias("label"), "value",
    )
    changes = st.run_to_end(st.class_counts(e))
    return changes.groupBy("label").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


def x12(spark, d):
    e = st.event_stream(spark, d).select(C("ts").cast("timestamp").alias("ts"), C("event_type").alias("kind"), "value")
    out = st.run_to_end(st.windowed(e))
    return out.groupBy("kind").agg(F.count("*").alias("windows"), F.sum("n").alias("n"))


def x14(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    n = F.when(C("event_type") == "signup", "initialize_20q").when(C("event_type") == "purchase", "verify_class").when(C("event_type") == "error", "next_question").otherwise("answer_question")
    e = st.event_stream(spark, d).select(
        C("user_id").cast("string").alias("session_id"), C("event_id").alias("seq"), n.alias("method"), (k % 24).alias("question_id"), (C("event_id") % 2).cast("int").alias("answer"),
        (C("event_id") % 4).cast("int").alias("certainty"), C("value").alias("response_time"), (k % 10).alias("class"), F.lit(False).alias("verified"),
    )
    replies = st.run_to_end(st.question_sessions(e, model_of(spark, d), idle_minutes=None))
    return replies.groupBy("session_id").agg(F.count("*").alias("requests"), F.sum(C("ok").cast("int")).alias("done"), F.max("asked").alias("most_asked"))


QUERIES = {
    "x8_stream_relabel": (
        x8,
        """SELECT event_type AS label, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events)
        WHERE i = 1 AND event_type <> 'error' GROUP BY 1""",
    ),
    "x12_stream_windows": (
        x12,
        """WITH w AS (SELECT event_type AS kind, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT kind, count(*) AS windows, sum(n)::BIGINT AS n FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1""",
    ),
    "x14_stream_sessions": (x14, None),
}
