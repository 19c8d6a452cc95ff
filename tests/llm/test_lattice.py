import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers

from quarryline.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")


def words(text):
    return (text or "").encode().lower().split()


def segmentations(b, names):
    """All ways to cut b, by the definition."""
    if not b:
        yield ()
    for n in range(1, len(b) + 1):
        if b[:n] in names:
            for rest in segmentations(b[n:], names):
                yield (b[:n], *rest)


def brute(docs, rounds):
    names, scores = lattice.vocabulary(PATH)
    weight = dict(zip(names, scores.tolist(), strict=True))
    train = [(i, t) for i, t in docs if i is None or zlib.crc32(str(i).encode()) % 10]
    counts = {}
    for _, t in train:
        for w in words(t):
            counts[w] = counts.get(w, 0) + 1
    paths = {w: list(segmentations(lattice.MARK + w, weight)) for _, t in docs for w in words(t)}
    p = lambda path: math.exp(sum(weight[x] for x in path))
    for _ in range(rounds):
        uses = dict.fromkeys(names, lattice.ADDED)
        uses[b""] += len(train)
        for w, c in counts.items():
            total = sum(map(p, paths[w]))
            for path in paths[w]:
                for x in path:
                    uses[x] += c * p(path) / total
        whole = sum(uses.values())
        weight = {x: math.log(u / whole) for x, u in uses.items()}
    n, v = sum(counts.values()) + len(train), len(counts) + (1 if train else 0)
    base = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    out = {}
    for i, t in docs:
        ws = words(t)
        out[i] = (i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(ws) + 1,
                  sum(w in counts for w in ws) + (1 if train else 0), n, sum(base(counts.get(w, 0)) for w in ws) + base(len(train)),
                  sum(math.log10(sum(map(p, paths[w]))) for w in ws) + weight[b""] / math.log(10))
    return out


def corpus():
    r = random.Random(2)
    vocab = ["".join(r.choice("abtehé\x1f") for _ in range(r.randrange(1, 8))) for _ in range(60)] + ["the", "of", "漢字", "|"]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(0, 40)))) for i in range(60)]
    return [*docs, (60, None), (61, ""), (None, "the THE of"), (62, "the " * 3000)]


def close(a, b):
    return a[:4] == b[:4] and all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a[4:], b[4:], strict=True))


def test_equals_sum_over_all_segmentations(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as block", "2 as word", "3 as held_out")
    want = brute(docs, 2)
    first = brute(docs, 0)
    for block in (1 << 20, 50):
        rows = lattice.score(df.repartition(3), PATH, block_words=block, rounds=2).collect()
        assert len(rows) == len(docs)
        for r in rows:
            assert close(tuple(r)[1:-1], want[r.doc_id]), (r, want[r.doc_id])
            assert math.isclose(r.start_score, first[r.doc_id][-1], rel_tol=1e-6), (r, first[r.doc_id])


def test_held_out_text_teaches_nothing(spark):
    docs = dict(corpus())
    held = [i for i in docs if i is not None and zlib.crc32(str(i).encode()) % 10 == 0]
    other = [(i, "strange qqq words" if i in held else t) for i, t in docs.items()]
    frame = lambda d: {r.doc_id: r for r in lattice.score(spark.createDataFrame(d, "doc_id long, text string"), PATH).collect()}
    a, b = frame(list(docs.items())), frame(other)
    assert held and all(math.isclose(a[i].score, b[i].score, rel_tol=1e-9) and math.isclose(a[i].base_score, b[i].base_score, rel_tol=1e-9) for i in docs if i not in held)


def test_empty_table(spark):
    assert lattice.score(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_mark_is_no_text(spark):
    """A word that holds the mark's character is not two words."""
    docs = [(1, "the of"), (2, "the\u2581of"), (3, "the \u2581of"), (4, "\u2581the of")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    scores = {r.doc_id: r.score for r in lattice.score(df, public_tokenizers.path("piece_bpe_32k.model"), rounds=0).collect()}
    assert len({round(x, 6) for x in scores.values()}) == 4 and max(scores, key=scores.get) == 1


def test_probabilities_of_all_texts_sum_to_one_at_most():
    """Words of a small alphabet, the mark's character in it; more of them come closer to all that the
    end leaves, and never pass it."""
    names = [bytes([b]) for b in range(256)] + [lattice.MARK + b"a", b"ab", b"ba", lattice.SHOWN, lattice.MARK + lattice.SHOWN, lattice.END]
    weight = np.full(len(names), 1e-12)
    for n in (b"a", b"b", lattice.MARK, lattice.MARK + b"a", b"ab", b"ba", lattice.SHOWN, lattice.MARK + lattice.SHOWN):
        weight[names.index(n)] = 1.0
    weight[-1] = 3.0
    scores = np.log(weight / weight.sum())
    pieces, sums = lattice.Pieces(names[:-1], scores[:-1]), []
    for most in (2, 4, 6):
        words = [b"".join(w) for n in range(1, most + 1) for w in itertools.product((b"a", b"b", lattice.SHOWN), repeat=n)]
        sums.append(sum(np.exp(lattice.forward(pieces, m)).sum() for _, m in lattice.by_length(words)))
    assert sums[0] < sums[1] < sums[2] < 1 - np.exp(scores[-1])
