"""Saved benchmark runs: a dataset, and for each run its predictions, metadata and report, checked against each other.

Everything that is read is bounded: files to 16 MiB, JSON to a depth and a number of values that are counted while it
is scanned, lines to a length and a number. So the two sidecars of a run are small documents; predictions and turns
are tables.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarryline.functions.expressions import stripped
from quarryline.functions.parsers import strict_error
from quarryline.operators.conversations import compared
from quarryline.operators.durable import settled
from quarryline.operators.selection import require_empty

from .pinned import RECORD, chain_faults, pinned

#: Bounds of what is imported.
BYTES, DEPTH, VALUES, LINES, LINE, LABELS = 16 * 1024 * 1024, 40, 100_000, 5000, 1_000_000, 64
#: Settings of a run that a comparison shows and holds equal.
SETTINGS = ("max_seq", "max_image_size", "max_tokens", "seed", "four_bit", "agent_tools")
TOKEN = re.compile(r"\"(?:[^\"\\]|\\.)*\"|[\[\]{}:,]|[^\s\[\]{}:,\"]+", re.S)
DIGEST = re.compile(r"[a-f0-9]{64}")


def bounded_error(text: str | None, depth: int = DEPTH, values: int = VALUES) -> str | None:
    """Why a text is no strict JSON object within the bounds, or null. Depth and values are counted token by token, and
    the scan ends where a bound is passed, before anything is built."""
    inside = found = 0
    for token in TOKEN.finditer(text or ""):
        c = token[0]
        if c in "]}":
            inside -= 1
            continue
        # A name counted as a value is taken back at its colon.
        found += -1 if c == ":" else c != ","
        if inside > depth and c not in ":,":
            return "too deep"
        if found > values:
            return "too many values"
        inside += c in "[{"
    return strict_error(text)


@F.pandas_udf(StringType())
def bounded_json_error(line: pd.Series) -> pd.Series:
    return line.map(bounded_error)


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The lines of a file, and its digest."""
    long = spark.read.format("binaryFile").load(path).where((F.col("length") > BYTES) | (F.col("length") == 0)).select("path")
    require_empty(long, f"{path} is empty or longer than {BYTES} bytes")
    found = pinned(spark, path)
    n = found.agg(F.count("*").alias("n"), F.max(F.length("line")).alias("most"), F.min("sha256").alias("sha")).first()
    if not 1 <= n.n <= LINES or n.most > LINE:
        raise ValueError(f"{path} must have 1 to {LINES} records of at most {LINE} characters")
    require_empty(found.select("ordinal", bounded_json_error("line").alias("fault")).where("fault is not null"), f"{path} is no strict JSON Lines")
    return found, n.sha


def _document(spark: SparkSession, path: str) -> dict:
    found = spark.read.format("binaryFile").load(path).where(F.col("length") <= BYTES).select(F.decode("content", "UTF-8").alias("t")).collect()
    if len(found) != 1 or (fault := bounded_error(found[0].t)):
        raise ValueError(f"{path} is no strict JSON object of at most {BYTES} bytes" + (f": {fault}" if found else ""))
    return json.loads(found[0].t)


@dataclass(frozen=True)
class Cases:
    """A dataset's turns: key, id, turn, type, question, reference, history (role, text of what was said before), images (all
    that the conversation has shown so far, in order of their first use)."""
    turns: DataFrame
    sha256: str
    conversations: int
    images: frozenset[str]


TEXTS = "array<struct<type:string,text:string,image:string>>"
ROW = f"id string, messages array<struct<role:string,content:{TEXTS},plain:string>>, gold array<struct<type:string>>"


def turn_cases(rows: DataFrame) -> DataFrame:
    """The turns of rows (id, messages with role, texts, images; gold), as Cases has them."""
    first = F.when(F.get("messages", 0)["role"] == "system", 1).otherwise(0)
    made = rows.withColumn("s", first).select("*", F.posexplode("gold").alias("turn", "g"))
    user, answer = F.get("messages", F.col("s") + 2 * F.col("turn")), F.get("messages", F.col("s") + 2 * F.col("turn") + 1)
    before = F.slice("messages", 1, F.col("s") + 2 * F.col("turn"))
    shown = F.array_distinct(F.flatten(F.transform(F.slice("messages", 1, F.col("s") + 2 * F.col("turn") + 1), lambda m: m["images"])))
    return made.select(
        F.concat("id", F.lit("#"), F.col("turn").cast("string")).alias("key"), "id", "turn", F.col("g.type").alias("type"), user["text"].alias("question"),
        answer["text"].alias("reference"), F.transform(before, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("history"), shown.alias("images"))


def _row_faults(rows: DataFrame) -> DataFrame:
    """id, fault of rows that are no conversations with a typed label for each answer."""
    m, n = F.col("messages"), F.size("gold")
    first = F.when(F.get(m, 0)["role"] == "system", 1).otherwise(0)
    talk = F.slice(m, first + 1, F.size(m))
    order = F.forall(F.transform(talk, lambda x, i: F.coalesce(x["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"), F.lit(False))), lambda ok: ok)
    mute = F.exists(talk, lambda x: F.coalesce(stripped(x["text"]) == "", F.lit(True)))
    pictured = F.exists(m, lambda x: (x["role"] != "user") & (F.size(x["images"]) > 0))
    fault = F.when(F.coalesce((F.col("id") == "") | (stripped(F.col("id")) != F.col("id")) | F.col("id").contains("#"), F.lit(True)), "bad id").when(
        F.col("gold").isNull() | m.isNull() | ~n.between(1, LABELS), "no labels or conversation").when(F.size(m) != first + 2 * n, "labels and turns differ").when(
        ~order, "roles do not alternate").when(F.exists("gold", lambda g: ~F.coalesce(g["type"].rlike(r"^[a-z_]{1,40}\z"), F.lit(False))), "bad label").when(
        F.exists(m, lambda x: x["text"].isNull()), "neither text nor image").when(mute, "no text").when(pictured, "image that no user shows")
    again = rows.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("fault"))
    return rows.select("id", fault.alias("fault")).where("fault is not null").unionAll(again)


def dataset(spark: SparkSession, path: str) -> Cases:
    """The cases of a dataset; a row that is not sound is an error."""
    found, sha = _lines(spark, path)
    raw = F.from_json("line", "id string, gold array<struct<type:string>>, messages array<struct<role:string,content:string>>")
    blocks = lambda m: F.from_json(m["content"], TEXTS)
    listed = lambda m: m["content"].rlike(r"^\s*\[")
    known = lambda m: F.forall(blocks(m), lambda b: F.coalesce(((b["type"] == "text") & b["text"].isNotNull()) | ((b["type"] == "image") & (F.length(b["image"]) > 0)), F.lit(False)))
    text = lambda m: F.when(~listed(m), m["content"]).when(known(m), F.array_join(F.transform(F.filter(blocks(m), lambda b: b["type"] == "text"), lambda b: b["text"]), "\n"))
    pictures = lambda m: F.when(listed(m), F.transform(F.filter(blocks(m), lambda b: b["type"] == "image"), lambda b: b["image"])).otherwise(F.array().cast("array<string>"))
    message = lambda m: F.struct(m["role"].alias("role"), text(m).alias("text"), pictures(m).alias("images"))
    rows = settled(found.select(raw.alias("r")).select("r.id", "r.gold", F.transform("r.messages", message).alias("messages")))
    require_empty(_row_faults(rows), f"{path} has unsound rows")
    turns = settled(turn_cases(rows))
    if turns.count() > LINES:
        raise ValueError(f"{path} has more than {LINES} turns")
    images = turns.select(F.explode("images").alias("i")).distinct().collect()
    return Cases(turns, sha, rows.count(), frozenset(r.i for r in images))


@dataclass(frozen=True)
class Run:
    """One run: its records, and what its metadata and report say."""
    records: DataFrame
    meta: dict
    report: dict

    @property
    def settings(self) -> dict:
        own = {"agent_tools": False, **self.meta["deployment"]["settings"]}
        return {k: own.get(k) for k in SETTINGS}


def _whole(x, least: int = 0) -> bool:
    return type(x) is int and x >= least


def _sound_meta(meta: dict, report: dict, cases: Cases, sha: str) -> None:
    def ensure(fits: bool, what: str) -> None:
        if not fits:
            raise ValueError(what)

    ensure(meta.get("schema_version") == report.get("schema_version") == 1 and meta.get("runner") == "failure-accounted-benchmark", "only runs of version 1 are known")
    ensure(meta.get("dataset_sha256") == cases.sha256 and report.get("predictions_sha256") == sha and report.get("provenance") == meta,
           "dataset, predictions, metadata and report are not of one run")
    ensure(meta.get("history") in ("gold", "generated") and bool(re.fullmatch(r"[a-z0-9-]{1,50}", str(meta.get("profile")))) and report.get("profile") == meta["profile"]
           and _whole(meta.get("max_tokens"), 1) and type(meta.get("temperature")) in (int, float) and math.isfinite(meta["temperature"]), "bad settings or history")
    images = meta.get("images_sha256")
    ensure(isinstance(images, dict) and set(images) == cases.images and all(isinstance(h, str) and DIGEST.fullmatch(h) for h in images.values()), "images differ from the dataset's")
    deployment = meta.get("deployment")
    ensure(isinstance(deployment, dict) and all(isinstance(deployment.get(k), dict) for k in ("model", "settings", "packages"))
           and bool(DIGEST.fullmatch(str(deployment["model"].get("sha256")))) and isinstance(deployment["model"].get("files"), list), "no identity of the model")
    s = {"agent_tools": False, **deployment["settings"]}
    ensure(all(_whole(s.get(k), 1) for k in ("max_seq", "max_image_size")) and s.get("max_tokens") == meta["max_tokens"] and type(s.get("seed")) is int
           and type(s.get("four_bit")) is bool and type(s["agent_tools"]) is bool, "settings are missing")
    metrics, counts = report.get("metrics"), report.get("counts")
    ensure(isinstance(metrics, dict) and isinstance(counts, dict) and set(metrics) == set(counts) and all(
        re.fullmatch(r"[a-z0-9_.-]{1,60}", k) and type(v) in (int, float) and 0 <= v <= 1 and _whole(counts[k], 1) and counts[k] <= report.get("turns", 0) for k, v in metrics.items()),
        "bad scores")


def run(spark: SparkSession, path: str, cases: Cases) -> Run:
    """The run whose predictions are at path, with path.meta.json and path.report.json beside it. The three must name each
    other's digests and the dataset's, records must be what such a run would record, and the report's totals theirs."""
    found, sha = _lines(spark, path)
    meta, report = _document(spark, f"{path}.meta.json"), _document(spark, f"{path}.report.json")
    _sound_meta(meta, report, cases, sha)
    more = "elapsed_seconds double, model_fingerprint string, usage map<string,bigint>"
    rows = settled(found.select(F.from_json("line", f"{RECORD}, {more}").alias("r")).select("r.*"))
    odd = (F.col("elapsed_seconds") < 0) | F.exists(F.map_values("usage"), lambda n: n.isNull() | (n < 0)) | ~F.col("model_fingerprint").rlike(r"^[a-f0-9]{64}\z")
    require_empty(rows.where(F.coalesce(odd, F.lit(False))).select("key"), f"{path} has bad telemetry")
    gold = cases.turns.groupBy("id").agg(F.count("*").alias("n_turns"))
    require_empty(chain_faults(rows.select(*(c.split(" ")[0] for c in ("key", "output", "status", "attempted", "finish_reason", "error"))), gold, meta["history"] == "generated"),
                  f"{path} is not what a run would record")
    t = rows.agg(F.count("*").alias("turns"), F.count_if("attempted").alias("attempted"), F.count_if(F.col("status") == "failure").alias("failed"),
                 F.countDistinct("model_fingerprint").alias("models")).first()
    totals = {"turns": t.turns, "conversations": cases.conversations, "attempted_turns": t.attempted, "failed_turns": t.failed, "successful_turns": t.turns - t.failed,
              "failure_rate": t.failed / t.turns}
    if any(report.get(k) != v for k, v in totals.items()) or t.models > 1:
        raise ValueError(f"{path}: totals or models of the report are not the records'")
    return Run(rows, meta, report)


#: What two runs must have in common to be compared, besides their settings.
SAME = ("dataset_sha256", "images_sha256", "profile", "history", "max_tokens", "temperature")


def pairs(a: Run, b: Run, cases: Cases) -> DataFrame:
    """The turns of two runs side by side: the case's columns, a_status, b_status, a_output, b_output and kind, see
    conversations.compared(). Runs of other settings are refused."""
    unlike = [k for k in SAME if a.meta.get(k) != b.meta.get(k)] + [k for k in SETTINGS if a.settings[k] != b.settings[k]]
    if unlike:
        raise ValueError(f"the runs differ in {unlike}")
    both = compared(a.records, b.records)
    return cases.turns.join(both, "key")
