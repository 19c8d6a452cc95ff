import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarryline.llm import prefixtrie, vectorcodes

SCHEMA = "conv_id long, turn long, role string, text string"


def originals(data):
    turns = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(own)] for c, own in turns.items()}


def put_together(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
    return out


def brute(convs):
    """One node after the other, each with all its members."""
    members = defaultdict(list)
    for c, own in convs.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    done = {}
    for node in sorted(members, key=len, reverse=True):
        below = [done[x] for x in children[node]]
        cost = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        done[node] = (sum(x[0] for x in below) or 1, cost + sum(x[1] for x in below))
    return sorted(((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), *done[node],
                    sha(c for c in own if len(convs[c]) == len(node))) for node, own in members.items()), key=str)


def rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def conversations(seed, n=40, most=9):
    r = random.Random(seed)
    data = []
    for c in r.sample(range(-20, 3 * n), n):
        data += [(c, k if r.random() < 0.9 else r.choice([None, 3]), r.choice(["user", "user", None]), r.choice(["a", "é", "bb", None, ""])) for k in range(r.randrange(1, most))]
    r.shuffle(data)
    return data


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    data = conversations(seed)
    df = spark.createDataFrame(data, SCHEMA).repartition(3).selectExpr("*", "1 as depth", "2 as path", "3 as k1", "4 as size", "5 as place", "6 as one")
    assert rows(prefixtrie.rebuilt_trie(df)) == brute(put_together(originals(data)))
    if not seed:
        assert rows(prefixtrie.prefix_trie(df)) == brute(originals(data))


def test_growing_and_branching_conversations(spark, monkeypatch):
    """Each conversation goes on from the last one, a third of all rows are one conversation, and copies end together."""
    monkeypatch.setattr(prefixtrie, "PIECE", 3)
    data = [(c, k, "user", f"t{k}") for c in range(12) for k in range(c)] + [(100, k, "user", f"t{k}") for k in range(60)]
    data += [(200 + c, k, "user", "same") for c in range(20) for k in range(2)]
    data += [(300 + c, k, "user", f"t{k}" if k <= c else f"own {c}") for c in range(8) for k in range(9)]  # branches off a long one
    data += [(None, 1, "user", "nobody's"), (500, None, None, None)]
    assert rows(prefixtrie.prefix_trie(spark.createDataFrame(data, SCHEMA).repartition(4))) == brute(originals(data))


def test_nested_branches_take_few_rounds(spark, monkeypatch):
    found = []
    peeled = prefixtrie._peeled
    monkeypatch.setattr(prefixtrie, "_peeled", lambda paths: found.append(paths.count()) or peeled(paths))
    data = [(c, k, "user", f"t{k}") for c in range(3) for k in range(50)]
    got = prefixtrie.prefix_trie(spark.createDataFrame(data, SCHEMA))
    assert rows(got) == brute(originals(data)) and found == [1]


def test_running_sums_cross_tasks(spark):
    """One key over all tasks, sums beyond a long, several keys in a task."""
    values = [(0, i, 2**62 + i) for i in range(200)] + [(k, i, i) for k in range(1, 40) for i in range(k % 4)]
    df = spark.createDataFrame(values, "k long, i long, v long").repartition(5).withColumn("w", F.lit(1))
    got = {(r.k, r.i): (r.v, r.w) for r in prefixtrie.running(df, "k", [F.col("i")], ["v", "w"], ["i"]).collect()}
    sums, want = defaultdict(int), {}
    for k, i, v in sorted(values):
        sums[k] += v
        want[k, i] = ((sums[k] + 2**63) % 2**64 - 2**63, i + 1)
    assert got == want


def test_empty_and_turnless(spark):
    assert rows(prefixtrie.rebuilt_trie(spark.createDataFrame([], SCHEMA))) == []
    alone = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    data = [(alone, 0, "user", "x")]  # its first turn goes and its base is absent
    got = rows(prefixtrie.rebuilt_trie(spark.createDataFrame(data, SCHEMA)))
    assert got == brute(put_together(originals(data))) and got[0][:7] == (alone, 0, None, 1, 0, 1, 0)


def test_only_what_the_result_reads_is_left(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quarryline.llm.common.shared_dir", lambda spark: f"file://{tmp_path}")
    got = prefixtrie.rebuilt_trie(spark.createDataFrame(conversations(1), SCHEMA))
    assert len(list(tmp_path.iterdir())) == 2 and rows(got) == brute(put_together(originals(conversations(1))))
    floats = [(i, [0.1 * i + k for k in range(8)], 0) for i in range(4)]
    codes = vectorcodes.digests(spark.createDataFrame(floats, "vec_id long, embedding array<float>, label int"))
    assert len(list(tmp_path.iterdir())) == 3 and codes.count() == 4
