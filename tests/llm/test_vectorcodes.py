import hashlib
import math
import random

import pytest

from quarryline.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(data, parts=8, entries=16, rounds=6, scale=4096):
    """One vector at a time, with Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v], k) for i, v, k in data
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cuts = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = {}
    for (i, _, _), c in sorted(zip(kept, cuts, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1])):
        first.setdefault(i, c)
    books = [[c[p] for c in list(first.values())[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda part, book: min((far(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = [[] for _ in book]
            for c in cuts:
                held[near(c[p], book)[1]].append(c[p])
            books[p] = [[sum(x) // len(own) for x in zip(*own, strict=True)] if own else e for own, e in zip(held, book, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cuts]
    errors = [sum(e for e, _ in f) for f in found]
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, sum(x for x, (_, _, z) in zip(errors, kept, strict=True) if z == label), sha)
                   for (i, _, label), f, e in zip(kept, found, errors, strict=True)), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def floats(r, n, width=64):
    import numpy as np
    return [[float(np.float32(r.uniform(-1, 1))) for _ in range(width)] for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    some = floats(r, 60)
    data = [(i, v, r.choice([None, 0, 1, 2])) for i, v in enumerate(some)]
    r.shuffle(data)
    assert rows(vectorcodes.digests(spark.createDataFrame(data, SCHEMA).repartition(3))) == brute(data)


def test_equal_parts_ties_and_repeats(spark):
    """Few values, so that parts repeat, entries coincide and distances tie; one vector holds most rows."""
    r = random.Random(4)
    make = lambda: [r.choice([0.0, 0.25, -0.25]) for _ in range(8)] * 2
    data = [(i, make(), r.choice([None, 1])) for i in range(40)] + [(7, [0.25] * 16, 1)] * 100 + [(None, make(), 1), (None, make(), 2)]
    got = rows(vectorcodes.digests(spark.createDataFrame(data, SCHEMA).repartition(3)))
    assert len(got) == 142 and got == brute(data)
    few = [(i, make(), 0) for i in range(5)]
    assert rows(vectorcodes.digests(spark.createDataFrame(few, SCHEMA))) == brute(few)


def test_rows_that_go_and_rows_without_code(spark):
    good = [(i, [0.1 * i + k for k in range(8)], 0) for i in range(4)]
    gone = [(10, None, 0), (11, [None] + [0.0] * 7, 0), (12, [float("nan")] * 8, 0), (13, [float("inf")] + [0.0] * 7, 0), (14, [-float("inf")] * 8, None)]
    odd = [(20, [1.0] * 7, 0), (21, [], 0), (22, [5000.0] + [0.0] * 7, 3), (23, [1.0] * 16, None)]
    df = spark.createDataFrame(good + gone + odd, SCHEMA).selectExpr("*", "1 as pos", "2 as part", "3 as row", "4 as code", "5 as weight", "6 as vector", "7 as error")
    got = rows(vectorcodes.digests(df))
    want = brute([(i, [struct_float(x) for x in v], k) for i, v, k in good])
    assert [x for x in got if x[0] < 10] == want
    assert {x[0]: x[1:4] for x in got if x[0] >= 10} == {20: (None, None, want[0][3]), 21: (None, None, want[0][3]), 22: (None, None, None), 23: (None, None, None)}
    assert rows(vectorcodes.digests(df.limit(0))) == []
    assert rows(vectorcodes.digests(spark.createDataFrame(gone, SCHEMA))) == []


def struct_float(x):
    import numpy as np
    return float(np.float32(x))


def test_large_weights_are_summed_exactly(spark):
    """Sums of weight times component beyond a long."""
    import numpy as np
    weight, x = 2**42 + 12345, [vectorcodes.BOUND, -vectorcodes.BOUND, 7]
    df = spark.createDataFrame([(0, x, weight), (0, x, weight), (0, [1, 2, 3], 1)], "pos int, part array<int>, weight long").coalesce(1)
    got = {(r.entry, r.j): int(r.total) for r in vectorcodes._sums(df, np.zeros((1, 1, 3), np.int64))}
    assert got == {(0, -1): 2 * weight + 1} | {(0, j): 2 * weight * v + w for j, (v, w) in enumerate(zip(x, [1, 2, 3], strict=True))}
