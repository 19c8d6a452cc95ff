"""Turns, prefixes, probes, dependency blocking, rates and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turn_windows(key: str = "conv_id", turn: str = "turn"):
    return Window.partitionBy(key).orderBy(turn)


def user_turns(conversations: DataFrame) -> DataFrame:
    """One record for each user turn: conv_id, n (0-based), key "id#n", turn, question, output (the
    reply that follows at once, else empty) and failed (no reply)."""
    w = turn_windows()
    nxt = conversations.withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)}).where("role = 'user'")
    answered = F.coalesce((F.col("next_role") == "assistant") & (F.length("next_text") > 0), F.lit(False))
    n = (F.row_number().over(w) - 1).cast("long")
    return nxt.select("conv_id", n.alias("n"), "turn", F.col("text").alias("question"),
                      F.when(answered, F.col("next_text")).otherwise("").alias("output"), (~answered).alias("failed")).withColumn(
        "key", F.concat_ws("#", F.col("conv_id").cast("string"), F.col("n").cast("string")))


def blocked(turns: DataFrame) -> DataFrame:
    """turns with caused_by, the first failed key before a turn, and status: success, failure, or
    dependency_failed for turns behind a failure."""
    before = turn_windows(turn="n").rowsBetween(Window.unboundedPreceding, -1)
    cause = F.first(F.when(F.col("failed"), F.col("key")), ignorenulls=True).over(before)
    t = turns.withColumn("caused_by", cause)
    return t.withColumn("status", F.when(F.col("caused_by").isNotNull(), "dependency_failed").when(F.col("failed"), "failure").otherwise("success"))


def alternation_faults(conversations: DataFrame) -> DataFrame:
    """Turns that break strict alternation: a role that repeats, a system turn that is not first, or
    a dialogue that starts with the assistant."""
    w = turn_windows()
    prev = conversations.withColumn("previous", F.lag("role").over(w))
    fault = F.when(F.col("role") == F.col("previous"), "repeated role").when(
        (F.col("role") == "system") & F.col("previous").isNotNull(), "system not first").when(
        (F.col("role") == "assistant") & (F.col("previous").isNull() | (F.col("previous") == "system")), "starts with assistant")
    return prev.withColumn("fault", fault).where("fault is not null").select("conv_id", "turn", "role", "fault")


def prefixes(conversations: DataFrame) -> DataFrame:
    """Each growing history: conv_id, turn, n_messages and the messages joined by newlines. A history
    is as long as its conversation, which bounds the rows' size."""
    w = turn_windows().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    return conversations.select("conv_id", "turn", F.count("*").over(w).alias("n_messages"),
                                F.array_join(F.collect_list(line).over(w), "\n").alias("history"))


def probes(turns: DataFrame) -> DataFrame:
    """Three probes for the last turn of each conversation with two turns or more: alone, with the
    first question named, and in context."""
    size = turns.withColumns({"size": F.count("*").over(Window.partitionBy("conv_id")),
                              "opening": F.first("question").over(turn_windows(turn="n"))})
    last = size.where("size >= 2 and n = size - 1")
    variants = F.array(
        F.struct(F.lit("standalone").alias("variant"), F.col("question").alias("prompt"), F.lit(1).cast("long").alias("n_turns")),
        F.struct(F.lit("explicit").alias("variant"), F.concat_ws("\n", "opening", "question").alias("prompt"), F.lit(1).cast("long").alias("n_turns")),
        F.struct(F.lit("contextual").alias("variant"), F.col("question").alias("prompt"), F.col("size").alias("n_turns")))
    return last.select("conv_id", "key", "status", F.inline(variants))


def rates(df: DataFrame, keys: list[str], flags: dict[str, str], required: bool = False) -> DataFrame:
    """Numerator, denominator and rate of each flag, a SQL expression that is null where it does not
    apply: keys, metric, correct, total, rate. A flag without any case has total 0 and no rate; if
    rates are required, that is an error. Groups without rows have none."""
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.expr(e).alias("hit")) for m, e in flags.items()))
    long = df.select(*keys, F.inline(cells)).groupBy(*keys, "metric").agg(F.count_if("hit").alias("correct"), F.count("hit").alias("total"))
    none = F.raise_error(F.concat(F.lit("no evidence for "), "metric")).cast("double") if required else F.lit(None).cast("double")
    return long.withColumn("rate", F.when(F.col("total") == 0, none).otherwise(F.round(F.col("correct") / F.col("total"), 6)))


def qualified(candidate: DataFrame, baseline: DataFrame, floors: DataFrame) -> DataFrame:
    """Candidate rates against floors and a baseline: metric, rate, floor, base_rate, verdict."""
    c = candidate.select("metric", "rate")
    j = floors.join(c, "metric", "left").join(baseline.select("metric", F.col("rate").alias("base_rate")), "metric", "left")
    verdict = F.when(F.col("rate").isNull() | F.isnan("rate"), "no evidence").when(F.col("rate") < F.col("floor"), "below floor").when(
        F.col("rate") < F.col("base_rate"), "regression").otherwise("pass")
    return j.select("metric", "rate", "floor", "base_rate", verdict.alias("verdict"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of two runs by key: key, a_status, b_status and the first filter that fits. A key that one
    run lacks is kept and named."""
    x = a.select("key", F.col("status").alias("a_status"), F.col("output").alias("a_output"))
    y = b.select("key", F.col("status").alias("b_status"), F.col("output").alias("b_output"))
    ok = lambda s: F.col(s) == "success"
    kind = F.when(F.col("a_status").isNull(), "not in a").when(F.col("b_status").isNull(), "not in b").when(~ok("a_status") & ~ok("b_status"), "both fail").when(~ok("a_status"), "a fails").when(~ok("b_status"), "b fails").when(
        F.col("a_output") != F.col("b_output"), "texts differ").otherwise("same")
    return x.join(y, "key", "full").withColumn("kind", kind)
