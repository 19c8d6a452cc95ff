"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct shingles of ``width`` words (the whole sequence if it has
fewer). Equal sets fall into one class and only one member of a class goes on. Its signature has
60 components of 14 bits. Two sets of similarity J differ in each component with probability
1 - J, so with J >= 0.80 they differ in more than 29 of 60 with probability about 2e-7 at that
similarity and far less above it (2e-10 at 0.85). The signature is split into 15 chunks of four; by the pigeonhole
principle two signatures at distance <= 29 agree in some chunk up to one component. Every chunk
is emitted once for each component left out, so that all pairs under the distance share a key.

Beside the components stands an odd sketch: one bit for each of 1024 classes of shingle hashes,
the parity of the set's members there. The bits in which two sketches differ never outnumber the
shingles that only one set has, so the sketch rules out pairs for certain, and no true pair.

Copies of copies can fill a key. Round one compares every member of a key with three pivots only
(its smallest member and two that hashes choose, so that no outlier stands for a group), confirms
these links on the full sets and takes components. Round two compares only members of a key that
are still in different components, in pairs of tiles; two tiles of one component never meet.
No link between different components is lost, and a tight group costs as many pairs as members.

Keys with one member go before anything else is done. What a key has is found by aggregates that
are taken before the shuffle, and is joined to its members, so that Spark can split a hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, mixed, rows, seeds, spare

CHUNKS = 15
#: Components of a chunk. They stand in one long, each in a lane with a spare bit.
SPAN = 4
COMPONENTS = CHUNKS * SPAN
#: Any pair up to this distance has a chunk with one error at most.
MAX_DISTANCE = 2 * CHUNKS - 1
#: Pairs of less similarity would be lost beyond MAX_DISTANCE too often.
LEAST_PERCENT = 80
BITS = 14
LOW = np.int64(sum((1 << BITS) - 1 << i * (BITS + 1) for i in range(SPAN)))
SPARE = np.int64(sum(1 << BITS << i * (BITS + 1) for i in range(SPAN)))
#: Longs of an odd sketch, which follow the chunks in a signature.
ODD = 16
LANES = np.arange(SPAN, dtype=np.uint64) * np.uint64(BITS + 1)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(width, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j, m in enumerate(seeds(k, 17)):
        out += h[j : n - k + 1 + j] * m
    out = mixed(out + np.uint64(k))
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """BITS of the smallest value under each hash function, SPAN to a long."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024]
        v = (part[:, None] ^ b[None, :]) * a[None, :]
        v ^= v >> np.uint64(32)
        np.minimum(low, v.min(0), out=low)
    lanes = (mixed(low) & np.uint64((1 << BITS) - 1)).reshape(-1, SPAN) << LANES
    odd = np.bincount((hashes >> np.uint64(54)).astype(np.int64), minlength=64 * ODD) & 1
    return np.concatenate([lanes.sum(1, dtype=np.uint64), np.packbits(odd.astype(np.uint8)).view(np.uint64)]).view(np.int64)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (null for an empty set), sig as longs."""
    def each(batches):
        a, b = seeds(COMPONENTS, 3), seeds(COMPONENTS, 5)
        for d in rows(batches):
            sets = [shingle_hashes(t, width) for t in d["text"]]
            sigs = [signature(s, a, b).tolist() if len(s) else None for s in sets]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(d["doc_id"], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_hash", "sig"])

    return docs.select("doc_id", "text").mapInArrow(
        each, "doc_id long, n_shingles long, set_hash binary, sig array<long>")


def _keys(classes: DataFrame) -> DataFrame:
    """(key, slot, id): one row for each class and slot. A slot is a component left out of its chunk."""
    parts = [(p, [c for c in range(p - p % SPAN, p - p % SPAN + SPAN) if c != p]) for p in range(COMPONENTS)]

    def each(batches):
        mult, slots = seeds(COMPONENTS, 11), np.arange(COMPONENTS, dtype=np.int8)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                d = batch.slice(at, 2000)
                n = d.num_rows
                longs = d.column("sig").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                longs = longs.reshape(n, -1)[:, :CHUNKS].ravel()
                sig = (longs[:, None] >> LANES & np.uint64((1 << BITS) - 1)).reshape(n, COMPONENTS)
                spread = mixed((sig + np.uint64(1)) * mult[None, :])
                keys = np.empty((n, len(parts)), np.uint64)
                for p, kept in parts:
                    keys[:, p] = mixed(spread[:, kept].sum(1, dtype=np.uint64) + np.uint64(p + 1))
                ids = np.repeat(d.column("id").to_numpy(zero_copy_only=False), len(parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(slots, n)), pa.array(ids)],
                    ["key", "slot", "id"])

    return classes.select("id", "sig").mapInArrow(each, "key long, slot byte, id long")


def near(x: np.ndarray, nx: int, y: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of y (signatures of sets of ny shingles) are near enough to x to be confirmed on
    the full sets."""
    # Of signed numbers bitwise_count takes the absolute value.
    odd = np.bitwise_count((y[:, CHUNKS:] ^ x[CHUNKS:]).view(np.uint64)).sum(1, dtype=np.int64)
    # With percent of the union in common, so many shingles at most are in one set only.
    at = np.flatnonzero((100 + percent) * odd <= (100 - percent) * (nx + ny))
    return at[_differ(x, y[at]).sum(1) <= MAX_DISTANCE]


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of y and chunk, in how many components it differs from x: adding LOW carries
    into a lane's spare bit just where the lanes differ."""
    return np.bitwise_count(((y[:, :CHUNKS] ^ x[:CHUNKS]) + LOW) & SPARE).astype(np.int64)


def _near_pairs(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which the signatures are near."""
    def each(batches):
        for batch in batches:
            x, y = (batch.column(f"sig_{k}").flatten().to_numpy().reshape(-1, CHUNKS + ODD) for k in "ab")
            nx, ny = (batch.column(f"n_{k}").to_numpy() for k in "ab")
            keep = [bool(len(near(x[i], nx[i], y[i : i + 1], ny[i : i + 1], percent))) for i in range(len(nx))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for k in ("b", "a"):
        pairs = pairs.join(reps.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}")), k)
    return pairs.mapInArrow(each, "a long, b long")


def _tiles(split: DataFrame, tile: int) -> DataFrame:
    """split (key, component, id, ...) once for each pair of tiles (lo, hi) that a row belongs to, with
    its own tile. A component with more than ``tile`` members of a key has tiles of its own, all
    others of the key share some; hashes deal members out, and two tiles of one large component are
    no pair, as they need no comparing."""
    counts = split.groupBy("key", "component").agg(F.count("*").alias("n_of"))
    large = cut(counts.where(F.col("n_of") > tile).withColumn("n_tiles", F.ceil(F.col("n_of") / tile)))
    shared = counts.where(F.col("n_of") <= tile).groupBy("key").agg(F.ceil(F.sum("n_of") / tile).alias("first"))
    # A row for each large component of a key, so few.
    upto = Window.partitionBy("key").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    large = large.withColumn("before", F.coalesce(F.sum("n_tiles").over(upto), F.lit(0)))
    own = cut(large.join(shared, "key", "left").select(
        "key", "component", (F.coalesce("first", F.lit(0)) + F.col("before")).alias("from"), F.col("n_tiles").alias("of")))
    total = cut(counts.groupBy("key").agg(
        F.ceil(F.coalesce(F.sum(F.when(F.col("n_of") <= tile, F.col("n_of"))), F.lit(0)) / tile).alias("first"),
        F.sum(F.when(F.col("n_of") > tile, F.ceil(F.col("n_of") / tile)).otherwise(0)).alias("large")).select(
        "key", "first", (F.col("first") + F.col("large")).alias("tiles")))
    placed = split.join(total, "key").join(own, ["key", "component"], "left")
    mine = F.coalesce(F.col("from"), F.lit(0)) + F.pmod(F.xxhash64("id"), F.coalesce("of", "first"))
    others = F.expr("""concat(if(from is null, sequence(0L, tiles - 1), array()), if(from > 0, sequence(0L, from - 1), array()),
        if(from + of < tiles, sequence(from + of, tiles - 1), array()))""")
    dealt = placed.withColumn("own", mine).withColumn("other", F.explode(others))
    return dealt.select(*split.columns, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")


def _cross_pairs(members: DataFrame, percent: int, tile: int = 4096) -> DataFrame:
    """From members (key, slot, id, component, n, sig): the pairs (a, b) in the same key but not in
    the same component of which the signatures are near, each at the first slot that it shares. Each
    pair of tiles of a key is a group of its own, so no task holds more than two tiles of a key."""
    dealt = _tiles(members, tile).select("key", "lo", "hi", "own", "slot", "id", "component", "n", "sig")
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "own", "id")

    def found(t: pa.Table):
        lo, hi, own, slot, ids, component, n = (t.column(c).to_numpy() for c in ("lo", "hi", "own", "slot", "id", "component", "n"))
        sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, CHUNKS + ODD)
        a, b = [], []
        for i in range(len(ids) - 1):
            # Within one tile all later rows; between two tiles the rows of the other.
            start = i + 1 if lo[i] == hi[i] else int(np.searchsorted(own, hi[i]))
            if own[i] != lo[i]:
                break
            y = start + np.flatnonzero(component[start:] != component[i])
            y = y[near(sig[i], n[i], sig[y], n[y], percent)]
            d = _differ(sig[i], sig[y])
            chunk, at = slot[i] // SPAN, slot[i] % SPAN
            y = y[(d[:, :chunk] >= 2).all(1) & ((d[:, chunk] == 1) | (at == 0))]
            a.append(np.minimum(ids[i], ids[y]))
            b.append(np.maximum(ids[i], ids[y]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (a, b)], ["a", "b"])

    def each(batches):
        left = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([left, t]) if left is not None else t
            cols = [t.column(c).to_numpy() for c in ("key", "lo", "hi")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for x, y in zip([0, *cuts], cuts, strict=False):
                yield found(t.slice(x, y - x))
            left = t.slice(cuts[-1]) if len(cuts) else t
        if left is not None:
            yield found(left)

    return dealt.mapInArrow(each, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, full set) of the documents that some other document may be close to."""
    def each(batches):
        for d in rows(batches, 500):
            yield pa.RecordBatch.from_arrays(
                [pa.array(d["id"], pa.int64()),
                 pa.array([shingle_hashes(t, width).tobytes() for t in d["text"]], pa.binary())], ["id", "members"])

    chosen = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")
    return chosen.mapInArrow(each, "id long, members binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    def each(batches):
        for d in rows(batches, 200):
            keep, last, have = [], None, None
            for a, x, y in zip(d["a"], d["members_a"], d["members_b"], strict=True):
                if a != last:
                    last, have = a, np.frombuffer(x, np.uint64)
                other = np.frombuffer(y, np.uint64)
                both = np.concatenate([have, other])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v for v, k in zip(d[c], keep, strict=True) if k], pa.int64()) for c in ("a", "b")], ["a", "b"])

    full = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("members_b")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("members").alias("members_a")), "a")
    # Sizes bound the similarity, so most hopeless pairs end before Python.
    size_a, size_b = F.length("members_a"), F.length("members_b")
    full = full.where(100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b))
    return full.select("a", "b", "members_a", "members_b").mapInArrow(each, "a long, b long")


def _same_document(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of one doc_id, for each doc_id that stands with several texts."""
    own = signed.where("doc_id is not null and set_hash is not null").select("doc_id", "set_hash")
    several = own.groupBy("doc_id").agg(F.min("set_hash").alias("low"), F.max("set_hash").alias("high")).where("low <> high").select("doc_id")
    met = own.join(several, "doc_id").distinct().join(classes.select("set_hash", "id"), "set_hash")
    least = met.groupBy("doc_id").agg(F.min("id").alias("a"))
    return met.join(least, "doc_id").where("a < id").select("a", F.col("id").alias("b"))


def near_duplicates(documents: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """One row for each row of documents (doc_id, text): doc_id, n_shingles, component_id (the
    smallest doc_id that links reach), kept (doc_id = component_id).

    Documents without words (null, empty, blank) are linked with nothing and kept. Rows that share
    a doc_id are one node. A row without doc_id belongs to the component of its class; if the class
    has no doc_id, component_id is null and the row is kept. Other columns are ignored. An empty
    table gives an empty result. A percent under LEAST_PERCENT raises ValueError.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"signatures fit {LEAST_PERCENT} percent and more, not {percent}")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(_signed(docs, width))
    # sig follows from set_hash, so any row of a class has it.
    classes = cut(signed.where("set_hash is not null").groupBy("set_hash").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))
    reps = classes.where("id is not null").select("id", "n", "sig")
    twice = cut(_keys(reps).groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("key"))
    shared = cut(_keys(reps).join(twice, "key").select("key", "slot", "id"))
    sets = cut(_sets(docs, shared.select("id").distinct(), width))
    # One order of all ids, so that groups which share many keys have the same pivots in all of them.
    dice = F.xxhash64("id")
    pivots = cut(shared.groupBy("key").agg(F.array(F.min("id"), F.min_by("id", dice), F.max_by("id", dice)).alias("pivots")))
    stars = shared.join(pivots, "key").select(F.explode("pivots").alias("p"), "id").where("p <> id").select(
        F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct()
    stars = _near_pairs(stars, reps, percent)
    first = cut(_confirmed(stars, sets, percent))
    label = components(first)
    placed = cut(shared.join(label, "id", "left").select("key", "slot", "id", F.coalesce("component", "id").alias("component")))
    mixed_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    split = cut(placed.join(cut(mixed_keys), "key"))
    cross = cut(_cross_pairs(split.join(reps, "id"), percent))
    label = components(cut(first.union(_confirmed(cross, sets, percent)).union(_same_document(signed, classes))))
    placed = cut(classes.select("set_hash", "id").join(label, "id", "left").select(
        "set_hash", F.coalesce("component", "id").alias("component_id")))
    out = signed.select("doc_id", "n_shingles", "set_hash").join(placed, "set_hash", "left")
    component = F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(documents: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """documents without those whose component has a smaller doc_id; repeated rows of the doc_id
    that stays, all stay, and so do rows without doc_id, which nothing can name. Columns as given."""
    (name,) = spare(documents, "gone")
    gone = near_duplicates(documents, percent, width).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return documents.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
