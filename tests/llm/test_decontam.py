import hashlib
import random
import re

from quarryline.llm import decontam


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, width=13):
    w, hit, found = split(text), set(), set()
    for i, t in items:
        s = split(t)
        n = min(width, len(s))
        for k in range(len(s) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == s[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(str(i))
    return (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(w))


def data():
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(6)] + ["été", "x9"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([3, 7, 12, 13, 14, 25, 40])))) for i in range(12)]
    items += [(20, "Solo"), (21, ""), (22, None), (23, "w1, w1. w1"), (24, items[0][1].upper())]
    docs = [(0, None), (1, ""), (2, "solo"), (3, "..."), (4, items[5][1]), (5, items[5][1])]
    for i in range(6, 60):
        text = [r.choice(vocab + ["other"]) for _ in range(r.randrange(1, 120))]
        if r.random() < 0.6:
            s = r.choice(items)[1] or ""
            at = r.randrange(len(text))
            text[at:at] = s.split()
        docs.append((i, r.choice([" ", ", ", "\n"]).join(text)))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as spans", "'q' as _row", "2 as item_id")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 as doc_id")
    want = {i: brute(t, items) for i, t in docs}
    got = {r.doc_id: tuple(r)[1:] for r in decontam.digests(d, b).collect()}
    assert got == want


def test_blocks_of_items_and_removal(spark):
    docs, items = data()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one = decontam.contamination(d, b)
    many = decontam.contamination(d, b, block_bytes=300)
    key = lambda r: (r.doc_id, r.n_words, [(s.start, s.stop) for s in r.spans], r["items"])
    assert sorted(map(key, one.collect()), key=str) == sorted(map(key, many.collect()), key=str)
    sizes = [sum(len(t) for _, t in decontam._collected(x)) for x in decontam._blocks(b.union(b), 300, 13)]
    assert len(sizes) > 3 and max(sizes) <= 300
    bad = {i for i, t in docs if brute(t, items)[4]}
    for size in (1 << 20, 300):
        left = decontam.remove_contaminated(d, b, block_bytes=size)
        assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {i for i, _ in docs} - bad


def test_long_items_and_texts(spark, monkeypatch):
    """Items in pieces give the windows of whole items; a text of 200,000 words is one document."""
    monkeypatch.setattr(decontam, "PIECE_WORDS", 20)
    docs, items = data()
    long = " ".join(f"v{i % 97}x{i % 89}" for i in range(200_000))
    d = spark.createDataFrame([*docs, (99, long)], "doc_id long, text string")
    b = spark.createDataFrame([*items, (30, " ".join(long.split()[100_000:100_090]))], "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontam.digests(d, b).collect()}
    hit = got.pop(99)
    assert got == {i: brute(t, items) for i, t in docs} and hit[0] == 200_000 and hit[1] % 90 == 0 and hit[2] == 1


def test_cuts_spans(spark):
    item = " ".join(f"v{i}" for i in range(15))
    d = spark.createDataFrame([(1, f"Before, {item.upper()}; after é"), (2, None), (3, "clean text")], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id: r.text for r in decontam.without_spans(d, b).collect()} == {1: "Before, ; after é", 2: None, 3: "clean text"}


def test_empty_tables(spark):
    d, b = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    assert decontam.digests(d, b).count() == 0
    row = decontam.digests(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), b).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
