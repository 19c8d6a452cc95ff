"""Job queues, event logs and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_usage(jobs: DataFrame, budgets: DataFrame) -> DataFrame:
    """Elapsed time of each kind against its budget: kind, used, share."""
    used = jobs.groupBy("kind").agg(F.round(F.sum("elapsed"), 4).alias("used"))
    return budgets.join(used, "kind", "left").select("kind", F.coalesce("used", F.lit(0.0)).alias("used"),
                                                     F.round(F.coalesce("used", F.lit(0.0)) / F.col("budget"), 6).alias("share"))


def fair_next(queued: DataFrame, usage: DataFrame) -> DataFrame:
    """The queued job of the kind that has used least of its budget, the oldest of these."""
    return queued.join(usage.select("kind", "share"), "kind").orderBy("share", "created", "id").limit(1)


def poison_sums(steps: DataFrame, key: str, columns: list[str], scope: str) -> DataFrame:
    """Sums in which one unknown value makes the total unknown, and the common scope or "mixed"."""
    sums = [F.when(F.count(c) == F.count("*"), F.round(F.sum(c), 4)).alias(c) for c in columns]
    common = F.when(F.countDistinct(scope) == 1, F.min(scope)).otherwise("mixed")
    return steps.groupBy(key).agg(F.count("*").alias("n_steps"), *sums, common.alias("scope"))


def folded(events: DataFrame, key: str) -> DataFrame:
    """Two-event logs folded to a state: finished_at is null and the state incomplete without a
    terminal event."""
    return events.groupBy(key).agg(
        F.min(F.when(F.col("event") == "attempted", F.col("ts"))).alias("attempted_at"),
        F.max(F.when(F.col("event") == "finished", F.col("ts"))).alias("finished_at")).withColumn(
        "state", F.when(F.col("attempted_at").isNull(), "unopened").when(F.col("finished_at").isNull(), "incomplete").otherwise("finished"))
