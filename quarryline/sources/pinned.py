"""Files that are checked and read in one go: rows come from the bytes whose digest was compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions.expressions import final_answer, stripped
from quarryline.functions.parsers import strict_json_error
from quarryline.operators.durable import settled
from quarryline.operators.selection import dealt, require_empty

from . import images


def pinned(spark: SparkSession, path: str, expected: str | DataFrame | None = None) -> DataFrame:
    """path, sha256, ordinal (from 1), line of every line of the files under path that is not blank. Each file is read
    once: its digest and its lines are of the same bytes, so a change after the check is not seen by the rows.

    expected: the digest that all files must have, or a table (path, sha256) of all of them; else an error. Files are
    rows of their own, up to 2 GB each; larger datasets come in parts."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    lines = files.select(images.plain(F.col("path")).alias("path"), F.sha2("content", 256).alias("sha256"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    found = settled(lines.select("path", "sha256", (F.col("at") + 1).cast("long").alias("ordinal"), F.rtrim(F.replace("line", F.lit("\r"), F.lit(""))).alias("line")))
    own = found.select("path", "sha256").distinct()
    if isinstance(expected, str):
        require_empty(own.where(F.col("sha256") != expected), f"{path} changed since it was checked")
    elif expected is not None:
        then = expected.select(images.plain(F.col("path")).alias("path"), F.col("sha256").alias("then"))
        both = own.join(then, "path", "full_outer")
        require_empty(both.where(~F.col("sha256").eqNullSafe(F.col("then"))), f"{path} changed since it was checked")
    return found.where(stripped(F.col("line")) != "")


ROW = "id string, messages array<struct<role:string,content:array<struct<type:string,text:string,image:string>>>>"


def training_fault(row: Column) -> Column:
    """Why a row (id, messages) can't be trained on, or null: it needs an id, two messages or more, a system message at most
    in front, then user and assistant in turns up to an assistant's; content that is a list of texts that are not blank
    and of users' images; text in every message of an assistant or the system; and an image."""
    m = row["messages"]
    text = lambda p: F.coalesce((p["type"] == "text") & (F.length(stripped(p["text"])) > 0), F.lit(False))
    image = lambda p, x: F.coalesce((p["type"] == "image") & (x["role"] == "user"), F.lit(False))
    talk = F.when(F.get(m, 0)["role"] == "system", F.slice(m, 2, F.size(m))).otherwise(m)
    order = F.forall(F.transform(talk, lambda x, i: F.coalesce(x["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"), F.lit(False))), lambda ok: ok)
    empty = F.exists(m, lambda x: x["content"].isNull() | (F.size(x["content"]) == 0))
    odd = F.exists(m, lambda x: F.exists(x["content"], lambda p: ~text(p) & ~image(p, x)))
    mute = F.exists(m, lambda x: x["role"].isin("assistant", "system") & ~F.exists(x["content"], text))
    seen = F.exists(m, lambda x: F.exists(x["content"], lambda p: image(p, x)))
    return F.when(F.coalesce(row["id"], F.lit("")) == "", "no id").when(m.isNull() | (F.size(m) < 2), "no conversation").when(~order, "roles do not alternate").when(
        empty, "no content").when(odd, "neither text nor a user's image").when(mute, "no text").when(F.element_at(m, -1)["role"] != "assistant", "no final answer").when(~seen, "no image")


def training_faults(found: DataFrame) -> DataFrame:
    """path, ordinal, fault of pinned() lines that are no strict JSON object or no sound row, or that repeat an id of their file."""
    own = found.select("path", "ordinal", strict_json_error("line").alias("_json"), F.from_json("line", ROW).alias("_r"))
    own = own.select("path", "ordinal", F.col("_r.id").alias("id"), F.coalesce("_json", training_fault(F.col("_r"))).alias("fault"))
    again = own.where("fault is null").groupBy("path", "id").agg(F.min("ordinal").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = own.where("fault is null").join(again, ["path", "id"]).where("ordinal > first").select("path", "ordinal", F.lit("repeated id").alias("fault"))
    return own.where("fault is not null").select("path", "ordinal", "fault").unionAll(repeated)


def training_rows(spark: SparkSession, path: str, expected: str | DataFrame | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, ordinal, id, messages of all rows; the images that they refer to, as images.resolved() has them) of a
    training dataset. A fault of any line or image is an error, and so is a dataset without rows. folder: where images lie,
    if not beside the dataset's files."""
    found = pinned(spark, path, expected)
    require_empty(training_faults(found), f"{path} has unsound rows")
    rows = found.select("path", "ordinal", F.from_json("line", ROW).alias("r")).select("path", "ordinal", "r.*")
    if rows.isEmpty():
        raise ValueError(f"{path} is empty")
    asked = images.references(rows.select(F.struct("path", "id").alias("row"), "messages"), "row").select(F.col("row.path").alias("dataset"), "row.id", "message", "block", "reference")
    root = folder or path.rstrip("/").rpartition("/")[0]
    used = settled(images.resolved(asked, images.scan(spark, root), "dataset"))
    require_empty(used.where("fault is not null"), f"{path} refers to images that can't be used")
    return rows, used


#: Places of a conversation's gold row and of keys that name no turn, before its turns.
GOLD, NO_TURN = -1, -2

RECORD = "key string, output string, status string, attempted boolean, finish_reason string, error struct<code:string,caused_by:string>"


def chain_faults(records: DataFrame, gold: DataFrame, generated: bool, n_rows: int | None = None) -> DataFrame:
    """key, fault of benchmark records (RECORD) held against gold rows (id, n_turns), as they were recorded: nothing is
    filled in. A key is <id>#<turn>, from 0. n_rows: about how many records there are, to deal them to as many parts.

    Each turn has one record and no other key has one. A success was attempted, is a complete answer (without reasoning or
    white space around it) and stopped; a failure says nothing and has an error. A turn that ran and failed says
    "generation_failed" and ended with "error". With generated history the turns behind a conversation's first failure were
    not attempted, ended with "dependency_failed", and name that failure's key as their cause; no other turn may say so."""
    said = F.col("output")
    sound = F.col("attempted") & (F.length(said) > 0) & (final_answer(said) == said) & (F.col("finish_reason") == "stop") & F.col("error").isNull()
    form = F.when(F.col("key").isNull() | said.isNull() | F.col("attempted").isNull(), "no key, output or attempt").when(
        F.col("status") == "success", F.when(~F.coalesce(sound, F.lit(False)), "unsound success")).when(
        F.col("status") == "failure", F.when((said != "") | F.col("error").isNull(), "unsound failure")).otherwise("unknown status")
    # A conversation's gold row stands before its records, which a window passes in order; a key that names no turn stands in front.
    number = F.substring_index("key", "#", -1)
    turn = F.when(F.contains("key", F.lit("#")) & number.rlike(r"^(0|[1-9][0-9]{0,9})\z"), F.expr("try_cast(substring_index(key, '#', -1) as int)"))
    name = F.when(F.col("_turn") < 0, F.col("key")).otherwise(F.substr("key", F.lit(1), F.length("key") - F.length(F.substring_index("key", "#", -1)) - 1))
    error, none = F.col("error"), F.lit(None)
    blocked = (F.col("status") == "failure") & ~F.col("attempted") & (F.col("finish_reason") == "dependency_failed") & (error["code"] == "dependency_failed")
    failed = F.col("attempted") & (F.col("finish_reason") == "error") & (error["code"] == "generation_failed")
    # Of a failure's cause only its turn is kept, and of others nothing.
    caused = F.substring_index(error["caused_by"], "#", -1)
    own = records.withColumn("_turn", F.coalesce(turn, F.lit(NO_TURN))).withColumn("_id", name)
    cause = F.when(F.coalesce(blocked & (error["caused_by"] == F.concat("_id", F.lit("#"), caused)), F.lit(False)), caused)
    own = own.select("_id", "_turn", none.cast("int").alias("_n"), form.alias("_form"), F.coalesce(F.col("status") == "failure", F.lit(False)).alias("_fails"),
                     F.coalesce(failed, F.lit(False)).alias("_failed"), cause.alias("_cause"))
    head = gold.where("n_turns > 0").select(F.col("id").alias("_id"), F.lit(GOLD).alias("_turn"), F.col("n_turns").cast("int").alias("_n"), none.cast("string").alias("_form"),
                                            F.lit(False).alias("_fails"), F.lit(False).alias("_failed"), none.cast("string").alias("_cause"))
    order = Window.partitionBy("_id").orderBy("_turn")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = own.unionAll(head)
    rows = (dealt(both, n_rows, "_id") if n_rows else both).withColumns({
        "_n": F.max("_n").over(so_far), "_first": F.min(F.when(F.col("_fails") & (F.col("_turn") >= 0), F.col("_turn"))).over(so_far), "_before": F.lag("_turn").over(order), "_next": F.lead("_turn").over(order)})
    is_turn = (F.col("_turn") >= 0) & F.coalesce(F.col("_turn") < F.col("_n"), F.lit(False))
    behind = F.lit(generated) & F.coalesce(F.col("_turn") > F.col("_first"), F.lit(False))
    chain = F.when(behind & ~F.coalesce(F.col("_cause") == F.col("_first").cast("string"), F.lit(False)), "not blocked by its cause").when(
        ~behind & F.col("_fails") & ~F.col("_failed"), "unsound generation failure")
    record = F.col("_turn") != GOLD
    at = lambda turn, fault: F.struct(turn.alias("turn"), fault.alias("fault"))
    said = F.array(
        at(F.col("_turn"), F.when(is_turn, F.coalesce("_form", chain))), at(F.col("_turn"), F.when(record & (F.col("_turn") == F.col("_before")), "repeated key")),
        at(F.col("_turn"), F.when(record & ~is_turn, "no such turn")))
    # The turns between a row and the next one, or the conversation's end, have no record.
    low, high = F.greatest(F.col("_turn") + 1, F.lit(0)), F.least(F.coalesce("_next", "_n"), F.col("_n")) - 1
    gap = F.when((F.col("_turn") >= GOLD) & (low <= high), F.transform(F.sequence(low, high), lambda k: at(k, F.lit("no record"))))
    faults = F.concat(F.filter(said, lambda x: x["fault"].isNotNull()), F.coalesce(gap, F.array().cast("array<struct<turn:int,fault:string>>")))
    found = rows.select("_id", F.explode_outer(faults).alias("x")).where("x is not null")
    key = F.when(F.col("x.turn") < 0, F.col("_id")).otherwise(F.concat("_id", F.lit("#"), F.col("x.turn").cast("string")))
    return found.select(key.alias("key"), "x.fault", "_id").distinct().select("key", "fault")


def benchmark_records(spark: SparkSession, path: str, gold: DataFrame, generated: bool, expected: str | None = None) -> DataFrame:
    """RECORD columns of a file of predictions, read once with its digest; a fault of any line or chain is an error."""
    found = pinned(spark, path, expected)
    require_empty(found.select("ordinal", strict_json_error("line").alias("fault")).where("fault is not null"), f"{path} is no strict JSON Lines")
    rows = found.select(F.from_json("line", RECORD).alias("r")).select("r.*")
    require_empty(chain_faults(rows, gold, generated), f"{path} is not what a run would record")
    return rows

