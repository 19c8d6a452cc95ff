import random
import re

from quarryline.llm import neardup


def brute(docs, percent=85, width=5):
    """Components by comparing all pairs of shingle sets."""
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j] and find(i) != find(j):
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(150)]
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one TWO"), (5, "one"), (6, " ".join(base))]
    for i in range(7, 90):  # copies with few to many edits: links chain
        own = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            own[r.randrange(len(own))] = r.choice(words)
        docs.append((i, " ".join(own)))
    docs += [(i, " ".join(r.choice(words) for _ in range(r.randrange(5, 200)))) for i in range(90, 130)]
    docs += [(130, docs[100][1].upper()), (131, " ".join(base * 30)), (132, "é Ünï " * 40)]
    r.shuffle(docs)
    return docs


def test_equals_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == brute(docs)


def test_small_tiles_find_the_same_pairs(spark):
    docs = [d for d in corpus() if d[0] >= 6]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    from pyspark.sql import functions as F

    reps = neardup._signed(df, 5).groupBy("set_hash").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    members = neardup._keys(reps).join(reps, "id").withColumn("component", F.col("id"))
    whole, tiled = ({(r.a, r.b) for r in neardup._cross_pairs(members, 85, t).collect()} for t in (4096, 7))
    once = neardup._cross_pairs(members, 85, 7).count()
    assert whole == tiled and once == len(tiled) > 50


def test_tiles_of_large_components_do_not_meet(spark):
    """A key with one large component, a few strays and a second large one: all pairs across, no others."""
    rows = [("k", i, 0) for i in range(300)] + [("k", i, i) for i in range(300, 320)] + [("k", i, 500) for i in range(400, 500)]
    rows += [("m", i, 0) for i in range(30)] + [("m", 99, 99)]
    df = spark.createDataFrame(rows, "key string, id long, component long")
    got = neardup._tiles(df, 16).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.key, r.lo, r.hi), []).append(r)
    assert max(map(len, groups.values())) < 80
    pairs = set()
    for (key, lo, hi), own in groups.items():
        for x in own:
            for y in own:
                if x.id < y.id and x.component != y.component and (x.own != y.own or lo == hi):
                    assert (key, x.id, y.id) not in pairs
                    pairs.add((key, x.id, y.id))
    assert pairs == {(k, a, b) for k, a, c in rows for l, b, d in rows if k == l and a < b and c != d}
    assert len(got) == 300 * 9 + 100 * 21 + 20 * 28 + 30 + 3  # not 420 * 28: tiles of one component never meet


def test_edge_rows(spark):
    """Empty table, null and repeated doc_id, columns that clash."""
    schema = "doc_id long, text string, id long, key string, component string, sig string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c", 1, "k", "c", "s"), (7, "a b c", 1, "k", "c", "s"), (7, "a b c", 2, "k", "c", "s"),
            (None, "x", 1, None, None, None), (9, None, 1, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == [("7", "7", True), ("7", "7", True), ("9", "9", True), ("None", "7", False), ("None", "None", True)]
    assert neardup.keep_one(df).columns == df.columns


def test_pipeline_stage_links_from_80_percent(spark):
    """Pairs on both sides of 0.80 and 0.85; a signature as laid out loses hardly any pair at 0.80."""
    from math import comb

    import corpus_pipeline

    r = random.Random(8)
    docs = []
    for i, changed in enumerate([40, 41, 42, 43, 47, 50, 52, 54, 55, 56, 58, 70] * 10):  # 500 shingles, the last words changed
        own = [f"v{r.randrange(10**9)}" for _ in range(504)]
        docs += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[: 504 - changed] + [f"n{w}" for w in own[504 - changed :]]))]
    between = [(500 - c) / (500 + c) for c in (40, 41, 42, 43, 47, 50, 52, 54, 55, 56, 58, 70)]
    assert sum(0.80 <= j < 0.85 for j in between) == 8
    df = spark.createDataFrame(docs, "doc_id long, text string")
    left = {x.doc_id for x in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert left == {i for i, (_, component) in brute(docs, 80).items() if i == component}
    assert len(left) == 120 + 10 * sum(j < 0.80 for j in between)
    n, d = neardup.COMPONENTS, neardup.MAX_DISTANCE
    assert sum(comb(n, k) * 0.2**k * 0.8 ** (n - k) for k in range(d + 1, n + 1)) < 3e-6


def test_too_low_a_percent_raises(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    try:
        neardup.near_duplicates(df, percent=neardup.LEAST_PERCENT - 1)
    except ValueError:
        return
    raise AssertionError("no ValueError")


def test_texts_of_one_doc_id_are_one_node(spark):
    words = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    docs = [(3, words("a")), (5, words("a")), (5, words("b")), (7, words("b") + " end"), (9, words("c")), (9, words("d")), (8, words("d")), (None, words("c")), (6, words("e")), (5, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted([("3", 36, 3, True), ("5", 36, 3, False), ("5", 36, 3, False), ("7", 37, 3, False), ("9", 36, 8, False), ("9", 36, 8, False), ("8", 36, 8, True),
                          ("None", 36, 8, False), ("6", 36, 6, True), ("5", 0, 5, True)])
