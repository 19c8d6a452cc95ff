"""A trie of conversations by their common beginnings, summed up by peeling leaves.

A node is a sequence of turns with which conversations begin. Its key is the sum, modulo 2^64 and in
two lanes, of hashes of each turn with its depth, so keys of all beginnings are running sums. Equal
keys are taken for equal sequences; the chance that two of n nodes meet by accident is n^2 / 2^128.

Peeling node by node would take as many rounds as the longest conversation has turns. So nodes are
first contracted to paths: each node belongs to its longest member (the smallest conv_id of
equals), and the nodes of one conversation form a path that runs down to a leaf. A path holds a
counter of the paths that hang from it and its own nodes' sums. In a round all paths whose counter
is zero send their totals to the path above, which adds them up and counts down, until only the
root's path is left, and that too is finished. A path of l nodes hangs from one that reaches at
least as deep, so rounds are at most the square root of twice the number of nodes. A last running
sum from each path's end to its top gives every node its subtree's totals.

Running sums (running()) sort rows over all tasks, sum inside each task and carry what the tasks
before have of the same key, so a conversation or path of any length needs no task of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, interim

#: Ids in one piece of a node's list of ends.
PIECE = 4096


def running(df: DataFrame, by: str, order: list[Column], sums: list[str], keep: list[str]) -> DataFrame:
    """by, keep and sums of df, where sums are running sums over the rows with the same value of by in
    the given order, modulo 2^64. All of these are longs without nulls."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [by, *keep, *sums]
    ordered = df.repartitionByRange(n, by, *order).sortWithinPartitions(by, *order).select(*(F.col(c).cast("long").alias(c) for c in names))

    def within(batches):
        part, seq = TaskContext.get().partitionId(), 0
        first = last = None
        carried = np.zeros(len(sums), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(by).to_numpy()
            first = key[0] if first is None else first
            upto = np.cumsum(np.stack([batch.column(c).to_numpy().view(np.uint64) for c in sums], 1), 0)
            start = np.flatnonzero(key[1:] != key[:-1]) + 1
            before = np.zeros((len(start) + 1, len(sums)), np.uint64)
            before[1:] = upto[start - 1]
            if key[0] == last:
                before[0] -= carried
            found = upto - np.repeat(before, np.diff([0, *start, len(key)]), 0)
            last, carried = key[-1], found[-1]
            out = [batch.column(c) for c in (by, *keep)] + [pa.array(np.ascontiguousarray(found[:, i]).view(np.int64)) for i in range(len(sums))]
            out += [pa.array(np.full(len(key), part, np.int64)), pa.array(np.arange(seq, seq + len(key))), pa.array(key == first)]
            seq += len(key)
            yield pa.RecordBatch.from_arrays(out, [*names, "part", "seq", "first"])

    schema = ", ".join(f"`{c}` long" for c in names)
    written = cut(ordered.mapInArrow(within, f"{schema}, part long, seq long, first boolean"))
    # One row for each partition, of which there are as many as the setting says.
    ends = written.groupBy("part").agg(F.min(by).alias("first"), F.max(by).alias("last"), F.max_by(F.array(*sums), "seq").alias("sums")).orderBy("part").collect()
    carry, last, held = {}, None, np.zeros(len(sums), np.uint64)
    for r in ends:
        own = np.array(r.sums, np.int64).view(np.uint64)
        before = held if r.first == last else np.zeros(len(sums), np.uint64)
        carry[r.part] = before
        last, held = r.last, own + before if r.first == r.last else own

    def across(batches):
        none = np.zeros(len(sums), np.uint64)
        for batch in batches:
            first, part = batch.column("first").to_numpy(zero_copy_only=False), batch.column("part").to_numpy()
            added = [np.zeros(batch.num_rows, np.uint64) for _ in sums]
            for p in np.unique(part).tolist():
                for x, more in zip(added, carry.get(p, none), strict=True):
                    x[first & (part == p)] = more
            out = [batch.column(c) for c in (by, *keep)]
            out += [pa.array((batch.column(c).to_numpy().view(np.uint64) + x).view(np.int64)) for c, x in zip(sums, added, strict=True)]
            yield pa.RecordBatch.from_arrays(out, names)

    out = written.mapInArrow(across, schema)
    out._cut_path = written._cut_path
    return out


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), one and two (hashes of role and text), size (UTF-8 bytes of the text)
    for each turn. Turns stand in order of turn, null first, equal ones in order of role and text; null
    role and text are empty. Rows without conv_id belong to no conversation and go."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    own = own.where("conv_id is not null").withColumns({
        "one": F.xxhash64("role", "text"), "two": F.xxhash64(F.lit(1), "role", "text"), "size": F.octet_length("text"), "place": F.lit(1)})
    return cut(running(own, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["place"], ["one", "two", "size"]))


def sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """numbered() turns as they are: (conv_id, length, depth, one, two, size for each turn; conv_id,
    length for each conversation)."""
    members = turns.groupBy("conv_id").agg(F.max("place").alias("length"))
    return turns.withColumnRenamed("place", "depth").join(members, "conv_id"), members


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """As sequences(), for conversations put together from two: the first h turns of the conversation
    c - c % family (all if it has fewer, none if it is absent; % keeps the sign of c), then c's own turns
    after its first h. h is the crc32 of c's decimal digits modulo heads."""
    own = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    own = own.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads, "base": F.col("conv_id") - F.col("conv_id") % family})
    at_base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    own = own.join(at_base, "base", "left").select(
        "conv_id", "base", "h", taken.alias("m"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    members = cut(own)
    # A conversation has less than `heads` turns here and at most `family` takers.
    head = turns.where(F.col("place") < heads).withColumnRenamed("conv_id", "base").join(
        members.select("conv_id", "base", "h", "length"), "base").where("place <= h").withColumn("depth", F.col("place"))
    tail = turns.join(members, "conv_id").where("place > h").withColumn("depth", F.col("place") - F.col("h") + F.col("m"))
    names = ["conv_id", "length", "depth", "one", "two", "size"]
    return head.select(*names).unionAll(tail.select(*names)), members.select("conv_id", "length")


def _ends(steps: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 for each node at which conversations end. Ids are put in order over
    all tasks and joined to pieces there; a node's digest then reads its pieces one after the other."""
    last = steps.where("depth = length").select("depth", "k1", "k2", "conv_id")
    key = ["depth", "k1", "k2"]
    n = max(1, int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pieces(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d, one, two, ids = (batch.column(i).to_numpy() for i in range(4))
            start = np.flatnonzero((d[1:] != d[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
            bounds = [b for a, z in zip([0, *start], [*start, len(d)], strict=True) for b in range(a, z, PIECE)]
            out = [(int(d[a]), int(one[a]), int(two[a]), int(ids[a]), ",".join(map(str, ids[a:z].tolist()))) for a, z in zip(bounds, [*bounds[1:], len(d)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], [*key, "first", "ids"])

    def digest(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for d, one, two, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids")), strict=True):
                if (d, one, two) != now:
                    if state:
                        out.append((*now, state.hexdigest()))
                    now, state = (d, one, two), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], [*key, "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], [*key, "ends_sha256"])

    parts = last.repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(
        pieces, "depth long, k1 long, k2 long, first long, ids string")
    return parts.repartition(n, *key).sortWithinPartitions(*key, "first").select(*key, "ids").mapInArrow(
        digest, "depth long, k1 long, k2 long, ends_sha256 string")


def _peeled(paths: DataFrame) -> DataFrame:
    """path, up, at, saved, leaves of all paths, where saved and leaves are those of the whole subtree
    of a path's top. paths: path, up (the path above, null for the root's), at (the depth there), left (how
    many paths hang from it), saved and leaves of its own nodes."""
    state, rounds = cut(paths), []
    while not state.isEmpty():
        done = state.where("left = 0")
        rounds.append(done.drop("left"))
        sent = done.where("up is not null").groupBy(F.col("up").alias("path")).agg(
            F.count("*").alias("n"), F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        some = lambda c: F.coalesce(F.col(c), F.lit(0))
        state = cut(state.where("left > 0").join(sent, "path", "left").select(
            "path", "up", "at", (F.col("left") - some("n")).alias("left"), (F.col("saved") + some("more_saved")).alias("saved"),
            (F.col("leaves") + some("more_leaves")).alias("leaves")))
    out = rounds[0] if rounds else state.drop("left")
    for more in rounds[1:]:
        out = out.unionAll(more)
    return out


def trie(steps: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences() or rebuilt() conversations: conv_id (the smallest member),
    depth, parent_conv_id (the parent's conv_id, null for the root), n_convs (members), n_children,
    n_leaves (childless nodes of the subtree), saved_tokens (summed over the subtree: members but
    one times bytes of the node's last text) and ends_sha256 (of the ids of members that end there).

    conv_id and depth together name a node; the turn itself is the member's turn at that depth. Turnless
    conversations end at the root. Without conversations there are no nodes, not even a root.
    """
    keyed = steps.withColumns({f"k{i}": F.xxhash64("depth", c) for i, c in ((1, "one"), (2, "two"))}).withColumns({"t1": F.col("k1"), "t2": F.col("k2")})
    keyed = cut(running(keyed, "conv_id", [F.col("depth")], ["k1", "k2"], ["depth", "length", "size", "t1", "t2"]))
    both = lambda a, b: F.struct(F.col(a).alias("one"), F.col(b).alias("two"))
    longest = F.min(F.struct((-F.col("length")).alias("length"), "conv_id"))
    nodes = keyed.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), longest.alias("of"), F.min("size").alias("size"), F.min("t1").alias("t1"), F.min("t2").alias("t2"))
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), longest.alias("of")).where("n_convs > 0").select(
        *(F.lit(0).cast("long").alias(c) for c in ("depth", "k1", "k2")), "conv_id", "n_convs", "of", *(F.lit(0).cast("long").alias(c) for c in ("size", "t1", "t2")))
    nodes = cut(nodes.unionAll(root).select(
        "depth", "k1", "k2", "conv_id", "n_convs", F.col("of.conv_id").alias("path"), (F.col("depth") == -F.col("of.length")).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), "t1", "t2"))
    # Keys without the last turn are the parent's: a sum less its last term, taken modulo 2^64.
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"),
                         F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("up"))
    lower = nodes.withColumns({f"u{i}": _less(f"k{i}", f"t{i}") for i in (1, 2)}).drop("t1", "t2")
    linked = cut(lower.join(above, ["depth", "u1", "u2"], "left").drop("u1", "u2"))
    tops = linked.where("up is null or up <> path")
    hanging = tops.where("up is not null").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("left"))
    own = linked.groupBy("path").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    paths = tops.select("path", "up", (F.col("depth") - 1).alias("at")).join(own, "path").join(hanging, "path", "left")
    totals = _peeled(paths.select("path", "up", "at", F.coalesce("left", F.lit(0)).alias("left"), "saved", "leaves"))
    sent = totals.where("up is not null").groupBy(F.col("up").alias("path"), F.col("at").alias("depth")).agg(
        F.count("*").alias("n"), F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    met = linked.join(sent, ["path", "depth"], "left").join(_ends(_with_root(keyed, members)), ["depth", "k1", "k2"], "left")
    met = cut(met.withColumns({
        "n_children": some("n") + 1 - F.col("leaves"), "saved": F.col("saved") + some("more_saved"), "leaves": F.col("leaves") + some("more_leaves")}))
    whole = running(met, "path", [F.col("depth").desc()], ["saved", "leaves"], ["depth"])
    out = met.select("path", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "ends_sha256").join(whole, ["path", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    out._reads = [met, whole]
    return out


def _less(a: str, b: str) -> Column:
    """a - b modulo 2^64, for longs."""
    wide = F.col(a).cast("decimal(38,0)") - F.col(b).cast("decimal(38,0)")
    turn = F.expr(f"{2**64}BD")
    return F.when(wide >= F.expr(f"{2**63}BD"), wide - turn).when(wide < F.expr(f"-{2**63}BD"), wide + turn).otherwise(wide).cast("long")


def _with_root(steps: DataFrame, members: DataFrame) -> DataFrame:
    """Turnless conversations end at the root."""
    zero = F.lit(0).cast("long")
    return steps.select("depth", "length", "k1", "k2", "conv_id").unionAll(
        members.where("length = 0").select(zero.alias("depth"), "length", zero.alias("k1"), zero.alias("k2"), "conv_id"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """trie() of conversations (conv_id, turn, role, text) as they are."""
    return _tidy(conversations, lambda turns: trie(*sequences(turns)))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """trie() of conversations as rebuilt() puts them together. Nulls, ties and rows without conv_id are
    treated as numbered() says; other columns are ignored, and an empty table gives no rows."""
    return _tidy(conversations, lambda turns: trie(*rebuilt(turns)))


def _tidy(conversations: DataFrame, made) -> DataFrame:
    """What is written on the way is deleted, but for the two tables that the result is joined from."""
    with interim(conversations.sparkSession) as kept:
        out = made(numbered(conversations))
        kept += out._reads
    return out
