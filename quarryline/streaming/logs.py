"""Event logs and resumable work as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarryline.operators.ledger import folded


def fold_to(events: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Folds a stream of two-event logs (key, event, ts) as far as there are events now. Each batch
    writes the states that it changed to a folder of its own below path, so a batch that runs again
    replaces its own output; current() reads the latest state of each key."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return folded(events, key).writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(states: DataFrame, key: str) -> DataFrame:
    """The newest state of each key among those that fold_to() wrote."""
    fields = [c for c in states.columns if c not in (key, "batch")]
    newest = states.groupBy(key).agg(F.max_by(F.struct(*fields), "batch").alias("x"))
    return newest.select(key, "x.*")


def pending(plan: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Planned work without a committed record; a record that the plan lacks is an error."""
    from quarryline.operators.selection import require_empty

    require_empty(done.join(plan, key, "left_anti").select(key), "records outside the plan")
    return plan.join(done.select(key), key, "left_anti")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events of each kind in tumbling windows, with late rows dropped behind the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), "event", "n")
