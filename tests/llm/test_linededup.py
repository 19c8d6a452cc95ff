import hashlib
import random

from quarryline.llm import linededup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def alike(a, b, min_words, min_chars):
    """Whether two normalised lines are equal or near, by the whole edit distance."""
    if a == b:
        return True
    (x, y), (p, q) = (t.split(" ") for t in (a, b)), (a, b)
    if max(len(x), len(y)) >= min_words:
        return abs(len(x) - len(y)) <= 1 and distance(x, y) <= 1
    return max(len(p), len(q)) >= min_chars and abs(len(p) - len(q)) <= 1 and distance(p, q) <= 1


def norm(line):
    return b" ".join(line.encode().lower().split()).decode()


def brute(docs, min_words=8, min_chars=20):
    """Text and removed lines of each row, by comparing every line with all earlier ones. Rows with
    one doc_id are one document."""
    earlier, out, seen = {}, [None] * len(docs), {}
    for k in sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, k)):
        text = docs[k][1]
        if text is None:
            out[k] = (None, 0)
            continue
        if docs[k][0] in seen:
            out[k] = seen[docs[k][0]]
            continue
        kept, lines = [], text.split("\n")
        for line in lines:
            w = norm(line)
            gone = bool(w) and any(alike(w, e, min_words, min_chars) for e in earlier)
            if w:
                earlier[w] = True
            if not gone:
                kept.append(line)
        out[k] = seen[docs[k][0]] = ("\n".join(kept), len(lines) - len(kept))
    return out


def corpus():
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(7)] + ["É", "x"]
    lines = [" ".join(r.choice(vocab) for _ in range(r.randrange(1, 14))) for _ in range(60)]
    docs = [(0, None), (1, ""), (2, "\n\n"), (3, "w1 w1 w1 w1 w1 w1"), (4, "w1 w1 w1 w1 w1 w1 w1\nw1 w1 w1 w1 w1")]
    for i in range(5, 120):
        own = []
        for _ in range(r.randrange(1, 8)):
            w = r.choice(lines).split()
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                at = r.randrange(len(w) + 1)
                w[at : at + r.choice([0, 1])] = r.choice([[], [r.choice(vocab)]])
            own.append(r.choice([" ", "  "]).join(w).upper() if r.random() < 0.2 else " ".join(w))
        docs.append((i, "\n".join(own)))
    docs += [(120, "\u7b2c\u4e00\u7ae0" * 9), (121, "\u7b2c\u4e00\u7ae0" * 8 + "\u7b2c\u4e8c\u7ae0"), (122, "\u7b2c\u4e00\u7ae0"),
             (123, "\u7b2c\u4e8c\u7ae0"), (124, "Chapter 1\nchapter  1\nChapter 2"), (125, "Rights reserved, page 12"), (126, "rights reserved page 12\n \n "),
             (127, "Rights reserved, page 123"), (128, "two words two words")]
    return [*docs, (None, docs[50][1]), docs[60], (-5, docs[70][1]), (200, "w1 " * 1000 + "\n" + "w1 " * 1001), (201, "\u00e9" * 900), (202, "\u00e9" * 901)]


def test_equals_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    removed = []
    for limits in ((8, 20), (5, 20), (1, 1), (99, 5)):
        got = [(r.text, r.n_gone) for r in linededup.dedup_lines(df, *limits, count_as="n_gone").collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute(docs, *limits))), limits
        removed.append(sum(n for _, n in got))
    assert removed[2] > removed[1] > removed[0] > 50


def test_lines_on_both_sides_of_a_bound(spark):
    """Of lines of 8, 7 and 9 words and of 20, 19 and 21 characters, in any order, all but the first go."""
    eight = "one two three four five six seven eight"
    lines = [eight, eight.removesuffix(" eight"), eight + " nine"]
    chars = ["abcde fghij klmno pq", "abcde fghij klmno p", "abcde fghij klmno pqr"]
    for first, second, third in [(0, 1, 2), (1, 0, 2), (2, 0, 1)]:
        for own in (lines, chars):
            docs = [(1, own[first]), (2, own[second]), (3, own[third]), (4, own[1].replace("two", "2").replace("abcde", "abcdx")), (5, own[1][1:])]
            got = {r.doc_id: r.n for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), count_as="n").collect()}
            want = {i: n for (i, _), (_, n) in zip(docs, brute(docs), strict=True)}
            assert got == want and (want[2], want[3], want[4]) == (1, 1 if first != 1 else want[3], want[4])


def test_rows_without_doc_id(spark):
    line = "one two three four five six seven eight nine"
    docs = [(None, f"{line}\nown {k}") for k in range(6)] + [(None, line), (3, line), (None, f"{line} ten")]
    got = sorted((str(r.doc_id), r.text) for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted([("None", f"own {k}") for k in range(6)] + [("None", ""), ("None", ""), ("3", line)])


def test_digests_and_dropping(spark):
    line = "one two three four five six seven eight"
    docs = [(2, line), (1, f"{line}\nshort"), (3, f"{line} nine\nx"), (4, "a\nX"), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text_sha256) for r in linededup.digests(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (2, 0, sha(docs[1][1])), 2: (1, 1, sha("")), 3: (2, 1, sha("x")), 4: (2, 1, sha("a")), 5: (None, 0, None)}
    assert {r.doc_id for r in linededup.dedup_lines(df, drop_emptied=True).collect()} == {1, 3, 4, 5}
    assert linededup.digests(df.limit(0)).count() == 0
    try:
        linededup.dedup_lines(df, count_as="TEXT")
    except ValueError:
        return
    raise AssertionError("no ValueError")
