"""Logs of experiments: a folder for each, with a file of JSON events that may have lost its tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.parsers import strict_json_error

#: Bytes that a log has at most, and the states that a finished one may record.
LARGEST = 1 << 20
ENDS = ("incomplete", "succeeded", "failed", "timed_out", "interrupted", "recording_failed")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """A row for each root/*/events.jsonl: id (the folder's name), status, n_events, torn (the last line
    was not ended and is left out), fault. Larger logs are not read. A log is one attempted event,
    then at most one finished event with its status; success needs the exit code 0. Where there is a
    fault, status is null. Folders without the file, or with one of no bytes (which Spark's source passes
    over), have no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "events.jsonl").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -2).alias("id")
    # The length filter reaches the source, so the contents of larger files are not read.
    logs = files.where(F.col("length") <= LARGEST).select("path", name, F.try_validate_utf8(F.col("content").cast("string")).alias("text"), F.lit(False).alias("_large"))
    logs = logs.union(files.where(F.col("length") > LARGEST).select("path", name, F.lit(None).cast("string"), F.lit(True)))
    whole = F.slice(F.split("text", "\n"), 1, F.greatest(F.size(F.split("text", "\n")) - 1, F.lit(0)))
    logs = logs.select("path", "id", (F.col("text") != "").alias("_some"), F.endswith("text", F.lit("\n")).alias("_ended"), "_large", F.col("text").isNull().alias("_no_text"), whole.alias("_lines"))
    each = logs.select("path", F.posexplode("_lines").alias("at", "line")).select(
        "path", "at", F.get_json_object("line", "$.event").alias("event"), F.get_json_object("line", "$.status").alias("status"),
        F.get_json_object("line", "$.exit_code").alias("code"), strict_json_error("line").alias("fault"))
    # A log is bounded, so are its events.
    events = each.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "event", "status", "code", "fault"))).alias("e"))
    j = logs.join(events, "path", "left")
    e, n = F.col("e"), F.coalesce(F.array_size("e"), F.lit(0))
    first, last = F.get(e, 0), F.get(e, 1)
    status = F.when(n == 1, "incomplete").otherwise(last["status"])
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    fault = F.when(F.col("_large"), "too large").when(F.col("_no_text"), "no UTF-8").when(F.exists(e, lambda x: x["fault"].isNotNull()), "no strict JSON object").when(
        bad(first["event"] == "attempted") | (n > 2), "bad sequence").when((n == 2) & bad(last["event"] == "finished"), "bad end").when(
        bad(status.isin(*ENDS)), "unknown status").when((status == "succeeded") & bad(last["code"] == "0"), "success without exit code 0")
    return j.select("id", F.when(fault.isNull(), status).alias("status"), n.cast("long").alias("n_events"),
                    F.coalesce(F.col("_some") & ~F.col("_ended"), F.lit(False)).alias("torn"), fault.alias("fault"))
