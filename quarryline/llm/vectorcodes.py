"""Compression of vectors by product codes.

Components become integers and vectors are cut into parts. Equal parts of one position are counted
once: a table of distinct parts with their weights stands for all vectors, and Lloyd's algorithm
runs on it, with sums of weight times component taken in the tasks and added up by Spark. Only
codebooks, parts x entries x width integers, pass through the driver. At the end distinct parts get
their entry and error, and a join takes these to the vectors that hold the parts.

A part that many vectors share is one row of the table; in the join it meets as many rows as there
are vectors, and Spark splits those over tasks, since the other side has one row for each part.
"""

from __future__ import annotations

import decimal
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, interim

#: A component's integer lies within this distance of 0, so that squares of differences add up in a long.
BOUND = 2**24
#: Rows that a task holds as numbers at a time.
STEP = 10_000
#: Weights are multiplied in two pieces of so many bits, so that sums of STEP products fit a long.
BITS = 20


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest index of the nearest entry, squared distance) for each row of x."""
    far = np.stack([((x - entry) ** 2).sum(1) for entry in book], 1)
    found = far.argmin(1)
    return found, far[np.arange(len(x)), found]


def _matrices(batch: pa.RecordBatch):
    """(position, places in the batch, rows of integers) for each position, STEP rows at most."""
    for at in range(0, batch.num_rows, STEP):
        some = batch.slice(at, STEP)
        pos = some.column("pos").to_numpy(zero_copy_only=False)
        x = some.column("part").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(some.num_rows, -1)
        for p in np.unique(pos).tolist():
            own = np.flatnonzero(pos == p)
            yield p, at + own, x[own]


def _sums(distinct: DataFrame, books: np.ndarray) -> list:
    """Rows (pos, entry, j, total) over all distinct parts: the sum of weight times component j, and of weights at j = -1."""
    def each(batches):
        sums: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            for p, own, x in _matrices(batch):
                w = weight[own]
                entry, _ = _nearest(x, books[p])
                x = np.concatenate([x, np.ones((len(x), 1), np.int64)], 1)
                high, low = (w >> BITS)[:, None] * x, (w & (1 << BITS) - 1)[:, None] * x
                for e in np.unique(entry).tolist():
                    mine = entry == e
                    found = [(a << BITS) + b for a, b in zip(high[mine].sum(0).tolist(), low[mine].sum(0).tolist(), strict=True)]
                    old = sums.get((p, e))
                    sums[p, e] = found if old is None else [a + b for a, b in zip(old, found, strict=True)]
        out = [(p, e, j if j + 1 < len(s) else -1, decimal.Decimal(v)) for (p, e), s in sums.items() for j, v in enumerate(s)]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["pos", "entry", "j", "total"])

    found = distinct.mapInArrow(each, "pos int, entry int, j int, total decimal(38,0)")
    return found.groupBy("pos", "entry", "j").agg(F.sum("total").alias("total")).collect()


def _assigned(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """distinct (pos, part) with entry and error."""
    def each(batches):
        for batch in batches:
            entry, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, own, x in _matrices(batch):
                entry[own], error[own] = _nearest(x, books[p])
            yield pa.RecordBatch.from_arrays(
                [batch.column("pos"), batch.column("part"), pa.array(entry), pa.array(error)], ["pos", "part", "entry", "error"])

    return distinct.select("pos", "part").mapInArrow(each, "pos int, part array<int>, entry int, error long")


def parted(embeddings: DataFrame, parts: int, scale: float) -> DataFrame:
    """vec_id, label, vector (array of parts, each an array of int) of all rows whose vector and
    components are neither null nor non-finite. vector is null where vectors can't be compared: the
    length is not the table's (the most frequent one that parts divides, the shorter of equals), or
    a component's integer is beyond BOUND."""
    own = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"))
    own = own.where("x is not null and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    length = F.size("x")
    common = own.where((length > 0) & (length % parts == 0)).groupBy(length.alias("n")).count().orderBy(F.desc("count"), "n").first()
    n = common["n"] if common else parts
    width = n // parts
    fits = (length == n) & F.expr(f"forall(x, v -> abs(v) <= double({BOUND} / {scale}))")
    ints = F.expr(f"transform(x, v -> cast(floor(v * double({scale})) as int))")
    cutting = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("i", p * width + 1, F.lit(width)))
    return own.select("vec_id", "label", F.when(fits, ints).alias("i")).select("vec_id", "label", F.when(F.col("i").isNotNull(), cutting).alias("vector"))


def _started(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The vectors of the smallest vec_ids, one for each id: the smallest. No id comes after all ids."""
    fit = vectors.where("vector is not null")
    order = (F.col("vec_id").isNull(), F.col("vec_id"))
    ids = [r[0] for r in fit.select("vec_id").distinct().orderBy(*order).limit(entries).collect()]
    among = F.col("vec_id").isin([i for i in ids if i is not None]) | (F.col("vec_id").isNull() if None in ids else F.lit(False))
    first = fit.where(among).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(*order).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    return np.array([r.vector for r in first], np.int64).transpose(1, 0, 2)


def compress(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error for each kept row; codebooks by part and entry).

    embeddings has vec_id, embedding, label; other columns are ignored. Rows go whose vector is null
    or has null or non-finite components. Each component x becomes floor(scale * x). A codebook's
    entries are at first the parts of the smallest vec_ids, fewer if there are fewer; in each round
    every part goes to its nearest entry, the lower index of equals, and an entry becomes the floor
    of its parts' mean, or stays if it has none. code is the array of entries' indexes after the last round,
    error the sum of squared distances. Repeated rows share their code and count each. Vectors that
    parted() can't compare have neither code nor error and take no part; an empty table gives no rows.
    """
    vectors = parted(embeddings, parts, scale)
    books = _started(vectors, parts, entries)
    each = vectors.where("vector is not null").select(F.posexplode("vector").alias("pos", "part"))
    distinct = cut(each.groupBy("pos", "part").agg(F.count("*").alias("weight")))
    for _ in range(rounds):
        totals = {(r.pos, r.entry, r.j): int(r.total) for r in _sums(distinct, books)}
        for (p, e, j), total in totals.items():
            if j >= 0:
                books[p, e, j] = total // totals[p, e, -1]
    given = F.array(*(
        F.struct(F.lit(p).alias("pos"), F.get("vector", F.lit(p)).alias("part"), *([F.col("vec_id"), F.col("label")] if not p else [
            F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("int").alias("label")])) for p in range(parts)))
    held = vectors.withColumn("row", F.monotonically_increasing_id()).select("row", F.inline(given))
    # Parts of one row: as many as there are parts, never more.
    coded = held.join(_assigned(distinct, books), ["pos", "part"], "left").groupBy("row").agg(
        F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.count("entry").alias("n"),
        F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("code"), F.sum("error").alias("error"))
    return coded.select("vec_id", "label", F.when(F.col("n") == parts, F.col("code.entry")).alias("code"), "error"), books


def digests(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error (the sum of errors over equal
    labels, nulls together) and codebooks_sha256, for each row that compress() keeps."""
    with interim(embeddings.sparkSession) as kept:
        coded, books = compress(embeddings, parts, entries, rounds, scale)
        coded = cut(coded.select("vec_id", "label", F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "").alias("code"), "error"))
        kept.append(coded)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
