"""Strict JSON Lines: one object to a line, no repeated field, no non-finite number, nothing behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarryline.functions.parsers import strict_json_error
from quarryline.operators.selection import require_empty


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, ordinal (increasing within a file) and line of each line."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("ordinal"), F.col("value").alias("line"))


def faults(found: DataFrame) -> DataFrame:
    """path, ordinal, fault of the lines that are no strict JSON object; every line goes through
    the Arrow check once."""
    return found.select("path", "ordinal", strict_json_error("line").alias("fault")).where("fault is not null")


def read(spark: SparkSession, path: str, schema: StructType | str, key: str | None = None) -> DataFrame:
    """Rows of a strict file in a fixed schema. Any fault, an empty file, or a repeated key is an
    error; nothing is dropped or inferred. The rows are read from the file again after it was
    checked, so it must not change while they are in use."""
    found = lines(spark, path)
    require_empty(faults(found), f"{path} is no strict JSON Lines")
    if not found.limit(1).count():
        raise ValueError(f"{path} is empty")
    out = found.select("ordinal", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("ordinal", "r.*")
    if key:
        require_empty(out.groupBy(key).count().where("count > 1"), f"{path} repeats a {key}")
    return out


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold rows (id, gold labels as JSON) after validation; see operators.validation."""
    from quarryline.operators.validation import gold_faults

    rows = read(spark, path, "id string, messages array<struct<role:string,content:string>>, gold array<struct<type:string,value:string,"
                "pins:array<string>,query:string,net:string,name:string,label:string>>", "id")
    require_empty(gold_faults(rows), f"{path} has bad gold rows")
    return rows


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """key and output, both strings, keys unique."""
    rows = read(spark, path, "key string, output string", "key")
    require_empty(rows.where("key is null or output is null"), f"{path} lacks a key or output")
    return rows
