"""Queries on state with limits: a queue of jobs over two rounds, and tokens that expire. SQL states the queue's rows;
the token machines depend on all events before each one, and tests hold them against the stream and worked cases."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarryline.operators import queue as Q
from quarryline.operators.durable import shared_folder
from quarryline.streaming import tokens as T
from quarryline.streaming.logs import windowed_counts

from .common import table


def queue_rounds(spark, d):
    """Orders as jobs. In the first round memory is short, and the job that runs yields after half of its budget; in the
    second one there is room, and the kind that has used least goes first."""
    k = F.col("o_orderkey") % 7
    jobs = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(k < 3, "training").when(k < 5, "research").otherwise("proposal").alias("kind"),
        F.when(k == 0, "none").when(k < 3, "train").when(k < 5, "look").otherwise("say").alias("adapter"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("created"))
    adapters = spark.createDataFrame([("train", "training", True, 1024), ("look", "research", True, 0), ("say", "proposal", True, 0)], "name string, kind string, ready boolean, gpu_mb int")
    settings = Q.Settings(adapters, {"research": 60, "training": 120, "proposal": 60})
    own = Q.Queue(spark, f"{shared_folder(spark)}/queue-{uuid.uuid4().hex}")
    own.submit(jobs)
    first = own.claim(settings, Q.Memory(1000))
    if first.job:
        own.settle(settings, first.job["id"], Q.AGAIN, 30.0)
    own.claim(settings, Q.Memory(24000))
    return own.jobs().select("id", "kind", "status", "reason", "elapsed")


def _tokens(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), "event_id", "ts", F.col("event_id").alias("n"), "value")


def approvals_held(spark, d):
    """Events as approvals of a user, of one token in four; two thirds ask and one answers."""
    e = _tokens(spark, d).select("key", "event_id", "ts", F.when(F.col("n") % 3 == 0, "answer").otherwise("ask").alias("kind"),
                                 F.concat(F.lit("t"), (F.floor(F.abs("value")) % 4).cast("string")).alias("token"), F.lit("search").alias("purpose"), F.lit(100).alias("size"))
    return T.settled(e, T.Approvals(seconds=86_400, most=3)).groupBy("key", "verdict").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))


def cancellations_held(spark, d):
    """Events as requests of a user: starts, cancels and ends of six requests."""
    kind = F.when(F.col("n") % 4 < 2, "cancel").when(F.col("n") % 4 == 2, "start").otherwise("finish")
    e = _tokens(spark, d).select("key", "event_id", "ts", kind.alias("kind"), F.md5((F.floor(F.abs("value")) % 6).cast("string").cast("binary")).alias("token"))
    return T.settled(e, T.Cancellations(seconds=86_400, most=2)).groupBy("key", "verdict").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))


def windowed_events(spark, d):
    """Events of each kind by the hour, by the plan that a stream of them has."""
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("event"))
    return windowed_counts(e).withColumn("start", F.date_format("start", "yyyy-MM-dd HH"))


QUERIES = {f.__name__: f for f in (queue_rounds, approvals_held, cancellations_held, windowed_events)}

ORACLES = {
    "windowed_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type AS event, count(*) AS n FROM events GROUP BY ALL",
    "queue_rounds": """
WITH j AS (SELECT o_orderkey::VARCHAR AS id, o_orderkey % 7 AS k, epoch(o_orderdate) AS created FROM orders),
  f AS (SELECT *, CASE WHEN k < 3 THEN 'training' WHEN k < 5 THEN 'research' ELSE 'proposal' END AS kind,
    row_number() OVER (PARTITION BY k IN (3, 4) ORDER BY created, id) AS r, row_number() OVER (PARTITION BY k IN (1, 2) ORDER BY created, id) AS t FROM j)
SELECT id, kind, CASE WHEN k IN (1, 2) AND t = 1 THEN 'running' WHEN k IN (1, 2, 3, 4) THEN 'queued' ELSE 'blocked' END AS status,
  CASE WHEN k = 0 THEN 'adapter not ready' WHEN k > 4 THEN 'publication disabled' WHEN k IN (3, 4) AND r = 1 THEN 'checkpoint yielded' ELSE '' END AS reason,
  CASE WHEN k IN (3, 4) AND r = 1 THEN 30.0 ELSE 0.0 END::DOUBLE AS elapsed FROM f""",
}
