"""Reports over records: budgets, lookups, cardinalities, grading, series, caps and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import expressions as X
from quarryline.functions import parsers as P

from .selection import first_of


def running_budget(rows: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """rows with kept, the part of text that the group's budget of characters still covers when texts
    are taken in order, and truncated. A null text takes nothing and stays null."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0), F.lit(budget) - F.coalesce(F.sum(F.length(text)).over(before), F.lit(0))).cast("int")
    return rows.withColumn("_left", left).withColumns(
        {"kept": F.substring(F.col(text), F.lit(1), F.col("_left")), "truncated": F.length(text) > F.col("_left")}).drop("_left")


def prioritised(asked: DataFrame, name: str, tables: list[DataFrame]) -> DataFrame:
    """asked with rank and id of its name in the first of tables (name, id) that has it, the least id
    of equals; letter case is ignored, and both are null where no table has the name."""
    pool = None
    for i, t in enumerate(tables):
        own = t.select(F.upper("name").alias("_n"), F.lit(i).alias("rank"), F.col("id").cast("string").alias("id"))
        pool = own if pool is None else pool.union(own)
    best = pool.groupBy("_n").agg(F.min(F.struct("rank", "id")).alias("_x"))
    return asked.join(best, F.upper(name) == F.col("_n"), "left").select(*asked.columns, "_x.rank", "_x.id")


def matches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with matches: none, one or several rows of right under its key."""
    n = right.groupBy(key).agg(F.count("*").alias("_n"))
    found = F.when(F.col("_n").isNull(), "none").when(F.col("_n") == 1, "one").otherwise("several")
    return left.join(n, key, "left").withColumn("matches", found).drop("_n")


def agreement(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Two views by key: keys and verdict, one of "a only", "b only", "same" and "differs"."""
    x, y = (v.select(*keys, F.struct(*fields).alias(n)) for v, n in ((a, "_a"), (b, "_b")))
    verdict = F.when(F.col("_b").isNull(), "a only").when(F.col("_a").isNull(), "b only").when(
        F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("differs")
    return x.join(y, keys, "full_outer").select(*keys, verdict.alias("verdict"))


def aligned(conversations: DataFrame) -> DataFrame:
    """The n-th answer of each conversation beside its n-th question: conv_id, n, question, answer."""
    talk = conversations.where(F.col("role").isin("user", "assistant"))
    numbered = talk.withColumn("n", (F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")) - 1).cast("long"))
    said = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    both = numbered.groupBy("conv_id", "n").agg(said("user").alias("question"), said("assistant").alias("answer"),
                                                F.count_if(F.col("role") == "assistant").alias("_a"))
    return both.where("_a > 0").drop("_a")


def graded(turns: DataFrame) -> DataFrame:
    """turns (type, output, value, pins, query, net) with metric and score by the type of their label;
    labels of another type have neither."""
    said = X.final_answer(F.col("output"))
    kind = F.col("type")
    metric = F.when(kind == "value", "value_exact").when(kind == "pins", "pins_f1").when(kind == "refuse", "refuse_acc")
    score = F.when(kind == "value", X.states_value(said, F.col("value")).cast("double")).when(
        kind == "refuse", X.refuses(said).cast("double")).when(
        kind == "pins", X.pin_f1(X.pins(said), F.col("pins"), said, F.col("query"), F.col("net")))
    return turns.withColumns({"metric": metric, "score": score})


def view_graded(answers: DataFrame) -> DataFrame:
    """answers (output, function, label, box, min_iou) with score: 1 if the answer makes exactly one
    call, of the right function, whose label is the same but for letter case or whose box overlaps
    the expected one by min_iou; functions without either need no more than the call."""
    form = "array<struct<arguments:struct<box:array<int>,label:string>,name:string>>"
    calls = F.from_json("_calls", form)
    made = answers.withColumn("_calls", P.parsed_calls(F.col("output"))["calls"]).withColumn("_one", F.when(F.size(calls) == 1, F.element_at(calls, 1)))
    corners = lambda c: [F.get(c, i) for i in range(4)]
    found = F.col("_one.arguments")
    fits = F.when(F.col("function") == "show_label", P.same_label(found["label"], F.col("label"))).when(
        F.col("function") == "show_region", X.iou(corners(found["box"]), corners(F.col("box"))) >= F.col("min_iou")).otherwise(True)
    right = F.coalesce((F.col("_one.name") == F.col("function")) & fits, F.lit(False))
    return made.withColumn("score", right.cast("double")).drop("_calls", "_one")


def series(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Number, least, greatest and last value of each series."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"),
                               F.max_by(value, F.struct(*order)).alias("last"))


def capped(df: DataFrame, keys: list[str], order: list[Column], n: int, text: str, chars: int) -> DataFrame:
    """A report of the first n rows of each key, with text cut to chars and marked if it was longer."""
    top = first_of(df, keys, order, n)
    return top.withColumns({"truncated": F.length(text) > chars, text: F.substring(text, 1, chars)})


def token_states(events: DataFrame, key: str, at: str, tie: str, seconds: int) -> DataFrame:
    """events with state: used if the key's next event follows within seconds, expired if later, else open."""
    after = F.lead(at).over(Window.partitionBy(key).orderBy(at, tie))
    state = F.when(after.isNull(), "open").when(after <= F.col(at) + F.expr(f"INTERVAL {seconds} SECONDS"), "used").otherwise("expired")
    return events.withColumn("state", state)


#: Fixed value: the exit code by which a job asks to run again.
AGAIN = 75


def job_state(code: Column) -> Column:
    """State after a run: no exit code yet is running, AGAIN goes back to the queue."""
    return F.when(code.isNull(), "running").when(code == 0, "completed").when(code == AGAIN, "queued").otherwise("failed")


def steps(n_rows: Column, batch: int, accumulation: int, epochs: int, most: int) -> Column:
    """Optimiser steps of a training run, each epoch's last step partly filled."""
    return F.least(F.lit(most), epochs * F.ceil(n_rows / (batch * accumulation))).cast("long")


def turned(x: Column, y: Column, angle: Column, mirrored: Column) -> tuple[Column, Column]:
    """A point turned by angle degrees, then mirrored at the y axis."""
    t = F.radians(angle)
    side = F.when(mirrored, -1.0).otherwise(1.0)
    return side * (x * F.cos(t) - y * F.sin(t)), x * F.sin(t) + y * F.cos(t)


def calculated(op: Column, a: Column, b: Column) -> Column:
    """a op b for add, sub, mul and div; null where the result is no finite number."""
    out = F.when(op == "add", a + b).when(op == "sub", a - b).when(op == "mul", a * b).when(op == "div", F.try_divide(a, b))
    return F.when(F.abs(out) < F.lit(float("inf")), out)
