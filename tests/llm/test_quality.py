import itertools
import random
import re
from collections import Counter

import numpy as np

from quarryline.llm import quality


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def corpus():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randrange(2, 9))) for _ in range(500)]
    docs = [(0, None, "en", "a"), (1, "", "en", "a"), (2, "a b c \x1f\n\na b c \x1f\n \n", "en", "a"), (3, "x " * 30_000, "en", "a")]
    for i in range(4, 300):
        words = [r.choice(vocab) for _ in range(r.randrange(1, 200))]
        if i % 9 == 0:
            words = [w + r.choice(["###", "$$", "|"]) for w in words]
        if i % 13 == 0:
            words = words[:30] * 2
        text = "".join(w + r.choice("   \n") for w in words)
        docs.append((i, text, r.choice(["en", "fr", None]), r.choice(["a", "a", "b"])))
    return [*docs, docs[20], docs[20]]


def vector(text):
    n, chars, sym, dup, rep, failed = base(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
    share = lambda a, b: np.arcsin(np.sqrt(min(1, a / max(b, 1))))
    return np.round(np.array([np.log((chars + 100) / (n + 20)), share(sym, chars), share(dup, lines), share(rep, n)]) * 1000) / 1000


def fitted(x):
    mean = x.mean(0)
    return mean, (x.T @ x / len(x) - np.outer(mean, mean)) + np.diag(np.square(quality.LEAST_SD))


def squared(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def half(n):
    return min(n, (n + 5) // 2)


def robust(x, starts=30):
    """Reweighted estimate by concentration steps on sorted rows, from medians and random subsets."""
    r = np.random.default_rng(1)
    first = [(np.median(x, axis=0), np.diag(np.square(quality.LEAST_SD))), fitted(x)]
    first += [fitted(x[r.choice(len(x), min(len(x), 5), replace=False)]) for _ in range(starts)]
    best = None
    for mean, cov in first:
        for _ in range(100):
            last, (mean, cov) = mean, fitted(x[np.argsort(squared(x, mean, cov), kind="stable")[: half(len(x))]])
            if np.allclose(last, mean, atol=1e-12):
                break
        if best is None or np.linalg.slogdet(cov)[1] < best[0] - 1e-6:
            best = np.linalg.slogdet(cov)[1], mean, cov
    d2 = squared(x, *best[1:])
    factor = max(1.0, np.median(d2) / quality.CHI2_MEDIAN)
    return fitted(x[d2 <= quality.CHI2_975 * factor])


def judged(docs):
    """{doc_id: (distance, verdict)} of (doc_id, text, lang, source), by sorting whole groups."""
    good = [(lang, source, vector(t)) for _, t, lang, source in docs if not base(t)[5]]
    if not good:
        return {i: (None, False) for i, *_ in docs}
    top, found, out = robust(np.array([v for *_, v in good])), {}, {}

    def drawn(rows, wider):
        if not rows:
            return wider
        w = len(rows) / (len(rows) + quality.PRIOR_ROWS)
        return tuple(w * a + (1 - w) * b for a, b in zip(robust(np.array(rows)), wider, strict=True))

    for i, t, lang, source in docs:
        key = lang, source
        if key not in found:
            of_lang = found.setdefault((key[0], None), drawn([v for a, _, v in good if a == key[0]], top))
            found[key] = drawn([v for a, b, v in good if (a, b) == key], of_lang)
        d2 = squared(vector(t)[None], *found[key])[0]
        out[i] = d2, not base(t)[5] and d2 <= quality.CHI2_9999
    return out


def test_equals_estimates_by_sorting(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as n_words", "2 as mean", "3 as band", "4 as n")
    got = {r.doc_id: r for r in quality.quality(df.repartition(4)).collect()}
    want = judged(docs)
    for i, t, _, _ in docs:
        assert tuple(got[i])[1:7] == base(t), i
        d2, kept = want[i]
        assert abs(got[i].distance2 - d2) < 0.03 * (1 + d2), (i, got[i].distance2, d2)
        assert got[i].kept == kept or abs(d2 / quality.CHI2_9999 - 1) < 0.05, i
    assert sum(not r.kept and not r.base_failed for r in got.values()) >= 10


def test_raw_estimate_has_the_least_determinant(spark):
    """Of all subsets of half of a small group, with clusters of outliers in it."""
    r, x, groups = np.random.default_rng(4), [], {}
    for g in range(5):
        rows = np.round(r.normal([1700, 100, 50, 30], [150, 60, 40, 20], (8, 4))).astype(int)
        far = np.round(r.normal([2600, 900, 500, 400], [30, 30, 30, 30], (4 - g % 2, 4))).astype(int)
        groups[f"g{g}"] = np.concatenate([rows, far])
        x += [("l", f"g{g}", *map(int, v)) for v in groups[f"g{g}"]]
    df = spark.createDataFrame(x, "lang string, source string, " + ", ".join(f"{d} long" for d in quality.DIMS)).selectExpr("*", "word_length % 64 as salt")
    got = {q.source: q for q in quality.raw_estimates(df).collect()}
    for name, rows in groups.items():
        subsets = itertools.combinations(range(len(rows)), half(len(rows)))
        least = min((np.linalg.slogdet(fitted(rows[list(s)] / 1000)[1])[1], s) for s in subsets)
        assert abs(got[name].logdet - least[0]) < 1e-6
        assert np.allclose([got[name][f"m{i}"] for i in range(4)], rows[list(least[1])].mean(0) / 1000)


def test_shapes(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert quality.quality(spark.createDataFrame([], schema)).count() == 0
    assert quality.keep_good(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "one two three four five six seven eight nine ten", None, None), (1, None, None, None)], schema)
    assert sorted(str(r.kept) for r in quality.quality(df).collect()) == ["False", "True"]
    assert [r.doc_id for r in quality.keep_good(df).collect()] == [None]
    bad = df.where("text is null")
    assert [(r.kept, r.distance2) for r in quality.quality(bad).collect()] == [(False, None)] and quality.keep_good(bad).count() == 0


def test_small_groups_are_judged(spark):
    """A group of one row, and a language of few, are held against what is wider."""
    r = random.Random(5)
    plain = lambda: " ".join("".join(r.choice("abcde") for _ in range(r.randrange(2, 9))) for _ in range(80))
    docs = [(i, plain(), "en", f"s{i % 30}") for i in range(60)] + [(i, plain(), "fr", "big") for i in range(60, 90)]
    docs += [(90, " ".join(w + "###" for w in plain().split()), "en", "rare"), (91, plain(), "xx", "one"),
             (92, " ".join(w + "$$$|" for w in plain().split()), "xx", "two"), (93, "", "en", "empty")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in quality.quality(df).collect()}
    assert {i for i in got if not got[i].kept} == {90, 92, 93}
    for i, (d2, _) in judged(docs).items():
        assert abs(got[i].distance2 - d2) < 0.03 * (1 + d2), i
    kept = quality.keep_good(df.selectExpr("*", "doc_id as stats", "1 as params"))
    assert {(x.doc_id, x.stats, x.params) for x in kept.collect()} == {(i, i, 1) for i in got if got[i].kept}
