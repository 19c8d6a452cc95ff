"""Contracts of rows as violation tables: what breaks them is reported, never dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.expressions import stripped

#: Label types.
LABELS = ("pins", "value", "refuse", "view", "view_reply", "view_refuse")


def gold_faults(rows: DataFrame) -> DataFrame:
    """id, fault of gold rows (id, messages, gold): ids are trimmed, without # and unique; labels are
    of a known type with their field, pins distinct; messages, where there are any, alternate and
    give one assistant turn to each label."""
    bad_label = F.exists("gold", lambda x: F.coalesce(~x["type"].isin(*LABELS), F.lit(True)) | ((x["type"] == "value") & (F.coalesce(F.length(stripped(x["value"])), F.lit(0)) == 0)) | (
        (x["type"] == "pins") & (x["pins"].isNull() | (F.size(x["pins"]) != F.size(F.array_distinct(x["pins"]))))) | ((x["type"] == "view") & x["name"].isNull()))
    talk = F.filter("messages", lambda m: m["role"] != "system")
    order = F.transform(talk, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    turns = F.size(F.filter("messages", lambda m: m["role"] == "assistant"))
    fault = F.when(F.col("id").isNull() | (F.col("id") == "") | (stripped(F.col("id")) != F.col("id")) | F.col("id").contains("#"), "bad id").when(
        F.col("gold").isNull() | (F.size("gold") == 0), "no labels").when(bad_label, "bad label").when(
        F.col("messages").isNotNull() & ~F.forall(order, lambda x: x), "roles do not alternate").when(
        F.col("messages").isNotNull() & (turns != F.size("gold")), "labels and turns differ")
    found = rows.select("id", fault.alias("fault")).where("fault is not null")
    repeated = rows.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("fault"))
    return found.union(repeated)


def record_faults(records: DataFrame) -> DataFrame:
    """key, fault of benchmark records (key, status, attempted, output, finish_reason, error): a
    success was attempted, says something and stopped; a failure says nothing and has an error."""
    good = F.col("attempted") & (F.length("output") > 0) & (F.col("finish_reason") == "stop") & F.col("error").isNull()
    bad = (F.col("output") == "") & F.col("error").isNotNull() & (F.col("finish_reason") != "stop")
    fault = F.when(~F.col("status").isin("success", "failure") | F.col("status").isNull(), "unknown status").when(
        (F.col("status") == "success") & ~F.coalesce(good, F.lit(False)), "unsound success").when(
        (F.col("status") == "failure") & ~F.coalesce(bad, F.lit(False)), "unsound failure")
    return records.select("key", fault.alias("fault")).where("fault is not null")


def round_trip_faults(made: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of one table and not of the other, as bags, with the side that has them."""
    return made.exceptAll(found).withColumn("side", F.lit("made")).union(found.exceptAll(made).withColumn("side", F.lit("found")))
