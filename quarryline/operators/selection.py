"""Splits, leakage checks, duplicates and seeded selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.expressions import seeded

from .durable import settled


def crossing(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in more than one split: key, n_splits, n_rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.countDistinct(split).alias("n_splits"), F.count("*").alias("n_rows")).where("n_splits > 1")


def overlap(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """For each field, how many of its distinct values left and right share; nulls share nothing."""
    def long(df: DataFrame) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
        return df.select(F.inline(pairs)).where("value is not null").distinct()

    shared = long(left).join(long(right), ["field", "value"], "left_semi").groupBy("field").agg(F.count("*").alias("n_shared"))
    names = left.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    return names.join(shared, "field", "left").select("field", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


def disagreement(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: key, side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).union(
        b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


#: Rows of a part of dealt(), and its parts at most: up to 200 are written straight to files, more are sorted in memory first.
TASK_ROWS, PARTS = 100_000, 200


def dealt(rows: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """rows of a table of n_rows, rows of equal keys together, in parts of TASK_ROWS. What groups by the keys needs no other
    shuffle, and sorts no more than a part. Of tables of over TASK_ROWS * PARTS rows the parts grow instead of their number,
    since tasks that deal to more parts would hold all their rows."""
    return rows.repartition(min(n_rows // TASK_ROWS + 1, PARTS), *keys)


def first_of(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order; the window is cut to n before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def representative(df: DataFrame, keys: list[str], member: str, seed: int) -> DataFrame:
    """For each group the member with the least seeded digest, and the members' number."""
    pick = seeded(seed, *(F.col(k) for k in keys), F.col(member))
    return df.groupBy(*keys).agg(F.min_by(member, pick).alias("representative"), F.count("*").alias("n_members"))


def seeded_top(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k distinct keys in seeded order: key, place."""
    own = df.select(key).where(F.col(key).isNotNull()).distinct().select(key, seeded(seed, F.col(key)).alias("_d"))
    top = own.orderBy("_d", key).limit(k)  # k is the feature: a report of k rows
    return top.withColumn("place", F.row_number().over(Window.orderBy("_d", key))).drop("_d")


def without_groups(df: DataFrame, keys: list[str], flagged: DataFrame) -> DataFrame:
    """df without every group of which one member is flagged."""
    return df.join(flagged.select(*keys).distinct(), keys, "left_anti")


def first_distinct(df: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """The first n distinct values by first appearance, letter case ignored: value, first_at."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(F.lower(value).alias("_f")).agg(
        F.min(order).alias("first_at"), F.min_by(value, order).alias(value))
    return firsts.orderBy("first_at").limit(n).select(value, "first_at")


def equally_spaced(df: DataFrame, key: str, c: int) -> DataFrame:
    """c rows at equal distances in order of key, both ends included: place round(i (n-1) / (c-1)),
    halves to even. Ranks come from partition counts, so no task holds all rows."""
    ordered = ranked(df.select(key), [F.col(key)])
    n = df.count()
    i = F.explode(F.sequence(F.lit(0), F.lit(max(c - 1, 0)))).alias("i")
    places = df.sparkSession.range(1).select(i).select(
        F.bround(F.col("i").cast("double") * (n - 1) / max(c - 1, 1)).cast("long").alias("rank")).distinct()
    return ordered.join(F.broadcast(places), "rank").select(key, "rank")


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with rank, its 0-based place in the given order, by range partitions and their counts."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Written out: a partition computed again after a loss could lie between other borders.
    placed = settled(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_part": F.shiftrightunsigned("_at", 33), "_in": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_in")).drop("_at", "_part", "_in", "_start")


def coverage(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Full outer accounting of keys: one row with matched, missing and extra."""
    g, p = gold.select(key, F.lit(True).alias("_g")).distinct(), pred.select(key, F.lit(True).alias("_p")).distinct()
    j = g.join(p, key, "full_outer")
    return j.agg(F.count_if(F.col("_g") & F.col("_p")).alias("matched"), F.count_if(F.col("_p").isNull()).alias("missing"),
                 F.count_if(F.col("_g").isNull()).alias("extra"))


def require_empty(violations: DataFrame, message: str) -> None:
    """Raises if there is a violation. An assertion column that nothing reads would be pruned."""
    found = violations.limit(3).collect()
    if found:
        raise ValueError(f"{message}: {found}")
