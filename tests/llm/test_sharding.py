import zlib
from collections import Counter

import numpy as np

from quarryline.llm import sharding


def test_curve_is_a_walk_through_all_cells():
    for n, bits in ((2, 3), (3, 2), (3, 3), (4, 2)):
        cells = np.indices([1 << bits] * n).reshape(n, -1)
        order = np.argsort(h := sharding.hilbert_index(list(cells), bits))
        assert sorted(h) == list(range(1 << bits * n))
        steps = np.abs(np.diff(cells[:, order], axis=1)).sum(0)
        assert (steps == 1).all()


def test_rows_law(spark):
    docs = [(i, "é" * (i % 50), f"l{i % 3}", f"s{i % 7}") for i in range(203)]
    docs += [(None, None, None, None), (5, "x", "l", None), (5, "x", "l", None), (9, "y" * 100_000, "l", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as hilbert", "2 as size", "3 as part")
    rows = sharding.shards(df.repartition(5)).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in docs)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        own = sorted((r.slot, r.hilbert) for r in rows if r.shard == s)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own)
    ends = [sorted(r.hilbert for r in rows if r.shard == s) for s in range(8)]
    assert all(a[-1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_order_and_pruning(spark):
    """Rows stand in the order that sorting all of them by coordinates gives, sizes of megabytes apart
    from those of kilobytes; and shards hold fewer values of each dimension than rows dealt at random."""
    docs = [(i % 150, "z" * 4 ** (i % 11), f"l{i % 4}", f"s{i % 11}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    less = lambda k, name: sum(d[k] < name for d in docs) * (1 << sharding.BITS) // 300
    size = [len(t) + 1 for _, t, _, _ in docs]
    z = np.floor(2 * np.log2(size)).astype(int)
    assert len({v for v, s in zip(z, size, strict=True) if s > 46_000}) == 3
    h = sharding.hilbert_index([np.array([less(2, d[2]) for d in docs]), np.array([less(3, d[3]) for d in docs]), z], sharding.BITS)
    order = sorted(range(300), key=lambda i: (h[i], docs[i][0], zlib.crc32(docs[i][1].encode())))
    want = [(docs[i][0], size[i], int(h[i]), k * 8 // 300) for k, i in enumerate(order)]
    rows = sharding.shards(df.repartition(4)).collect()
    assert [(r.doc_id, r.size, r.hilbert, r.shard) for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == want
    held = lambda part: sum(len({(k, v) for i in range(300) if part[i] == s for k, v in enumerate((docs[i][2], docs[i][3], z[i]))}) for s in range(8))
    curve = {i: k * 8 // 300 for k, i in enumerate(order)}
    assert held(curve) < 0.75 * held({i: zlib.crc32(b"%d" % i) % 8 for i in range(300)})


def test_few_rows(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert sharding.shards(spark.createDataFrame([], schema)).count() == 0
    rows = sharding.shards(spark.createDataFrame([(1, "a", "x", "y"), (2, None, "x", "y")], schema)).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(0, 0), (4, 0)]


def test_ranges_of_names_prune(spark):
    """A reader that knows the least and the greatest source of each shard opens fewer shards for a range of
    sources than if rows were dealt at random; one source has a third of all rows."""
    docs = [(i, "z" * (7 ** (i % 5)), f"l{i * 7 % 4}", "m" if i % 3 == 0 else f"s{i * i % 40:02d}") for i in range(1200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    source = {d[0]: d[3] for d in docs}

    def opened(shard):
        ranges = [(min(own), max(own)) for s in range(8) if (own := [source[i] for i in source if shard[i] == s])]
        return sum(a <= name <= b for name in set(source.values()) for a, b in ranges)

    curve = {r.doc_id: r.shard for r in sharding.shards(df.repartition(4)).collect()}
    assert opened(curve) < 0.6 * opened({i: zlib.crc32(b"%d" % i) % 8 for i in source})
    found = sharding.steps(df, "source")
    assert [n for _, n in found] == sorted({n for _, n in found}) and found[0] == (0, "m") and found[1][0] == 400 * 128 // 1200
