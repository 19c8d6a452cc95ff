"""Shards along a Hilbert curve over quantised metadata.

Language, source and size are quantised to a few bits each and joined to one index on a Hilbert
curve, on which neighbours in all dimensions stay close. Names are quantised by their order: a name's
coordinate says what share of the rows has lesser names, so ranges of names are ranges of coordinates and
frequent names have room. Rows in order of the index, cut into equal runs, give shards whose files a reader can
skip by the least and greatest value of any dimension.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bits of each quantised dimension: half steps of the order of magnitude of any 64-bit size fit.
BITS = 7


def hilbert_index(dims: list[np.ndarray], bits: int) -> np.ndarray:
    """The place on a Hilbert curve of points with coordinates under 2**bits, by Skilling's
    transform: undo excess work from the top bit down, Gray-decode, then interleave the bits."""
    x = [d.astype(np.int64) for d in dims]
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(x[i] & q, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ turn) >> b & 1)
    return out


def on_curve(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """df with the column hilbert, the index of the point that dims give. The transform works on
    Arrow batches: written out as one expression it would grow as two to the number of its steps."""
    @F.pandas_udf("long")
    def index(points: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([points[c].to_numpy() for c in dims], bits))

    return df.withColumn("hilbert", index(F.struct(*dims)))


def steps(df: DataFrame, name: str, bits: int = BITS) -> list[tuple[int, str]]:
    """(coordinate, least name that has it) in order, 2**bits at most, for the names of df, a column
    without nulls. Names are counted first and put in order over all tasks; a name whose lesser names
    have the share s of the rows has the coordinate s * 2**bits, rounded down."""
    counted = df.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
    parts = df.sparkSession.sparkContext.defaultParallelism
    # Written once: a range partitioning chosen anew need not cut alike.
    placed = cut(counted.repartitionByRange(parts, "name").withColumn("part", F.spark_partition_id()))
    # One row for each partition.
    every = Window.orderBy("part")
    starts = placed.groupBy("part").agg(F.sum("n").alias("all")).select(
        "part", (F.sum("all").over(every) - F.col("all")).alias("start"), F.sum("all").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    own = Window.partitionBy("part").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.join(F.broadcast(starts), "part").withColumn("less", F.col("start") + F.coalesce(F.sum("n").over(own), F.lit(0)))
    at = F.expr(f"(less * {1 << bits}) div total").alias("at")
    return [(r["at"], r["name"]) for r in before.groupBy(at).agg(F.min("name").alias("name")).orderBy("at").collect()]


def coordinate(name: Column, found: list[tuple[int, str]]) -> Column:
    """The coordinate of a name by steps()."""
    if not found:
        return F.lit(0).cast("long")
    least = F.array(*(F.lit(n) for _, n in found))
    return F.element_at(F.array(*(F.lit(c).cast("long") for c, _ in found)), F.size(F.filter(least, lambda x: x <= name)))


def magnitude(size: Column) -> Column:
    """The binary order of magnitude of a size, in half steps (at most 125)."""
    return F.floor(2 * F.log2(size.cast("double")))


def shards(documents: DataFrame, n_shards: int = 8) -> DataFrame:
    """For each row of documents (doc_id, text, lang, source): doc_id, size (UTF-8 bytes of the text
    plus 1), text_crc32, law, shard, slot (place in the shard, gapless from 0), grown_shard,
    hilbert.

    The law is ``rows``: shards are runs of the Hilbert order with counts at most one apart. Ties
    on the curve go by doc_id, then by text_crc32; rows equal in all of these are interchangeable.
    A null text has size 1 and the checksum of no bytes; null lang or source count as empty names;
    a null doc_id comes first. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    df = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), name("lang"), name("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    x, y = (coordinate(F.col(c), steps(df, c)) for c in ("lang", "source"))
    df = df.select("doc_id", "size", "text_crc32", x.alias("x"), y.alias("y"), magnitude(F.col("size")).alias("z"))
    df = on_curve(df, ["x", "y", "z"], BITS).select("doc_id", "size", "text_crc32", "hilbert")
    parts = documents.sparkSession.sparkContext.defaultParallelism * 4
    # Written once, as a range partitioning chosen anew on a second run need not cut alike.
    placed = cut(df.repartitionByRange(parts, "hilbert", "doc_id", "text_crc32").sortWithinPartitions(
        "hilbert", "doc_id", "text_crc32").withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumns({"part": part, "within": within})
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    # One row for each partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(every).alias("total"))
    ranked = placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("within"))
    ranked = ranked.withColumn("shard", F.expr(f"(rank * {n_shards}) div total"))
    # The first rank of a shard s is the least r with r * n_shards >= s * total.
    first = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                         (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")
