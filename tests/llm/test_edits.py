import random

import public_tokenizers
import tokenizers

from quarryline.llm import bpe, edits

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


def test_trees_follow_edits():
    r = random.Random(9)
    count = library()
    counter = edits.Counter(PATH, [bpe.pre_token_pattern(bpe.NARROW), bpe.pre_token_pattern()])
    alphabet = "ab  \n\n'st1é.! 漢\t"
    for _ in range(150):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(0, 200)))
        leaf = r.choice([1, 2, 5, 32])
        chars, tokens = edits.build(counter, text, leaf)
        for _ in range(8):
            start, removed = r.randrange(-3, len(text) + 4), r.choice([0, 0, 1, 3, 40])
            new = "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 3, 30])))
            at = max(0, min(start, len(text)))
            want = text[:at] + new + text[at + removed :]
            text, chars, tokens, _ = edits.edited(counter, text, chars, tokens, start, removed, new, leaf)
            assert text == want and chars[1] == len(text) and tokens[1] == count(text), (text, start, removed, new)


def test_only_the_region_is_cut_anew():
    counter = edits.Counter(PATH, [bpe.pre_token_pattern(bpe.NARROW), bpe.pre_token_pattern()])
    text = "some words and more " * 2000
    chars, tokens = edits.build(counter, text, 32)
    n = edits.edited(counter, text, chars, tokens, 20_000, 5, "other")[3]
    assert n < 800


def test_long_scripts_stay_local():
    """After hundreds of edits at one place no edit costs more than the first ones."""
    count, r = library(), random.Random(2)
    counter = edits.Counter(PATH, [bpe.pre_token_pattern(bpe.NARROW), bpe.pre_token_pattern()])
    for where in (lambda n: n, lambda n: 0, lambda n: n // 2):
        text, recut = "some words and more " * 50, []
        chars, tokens = edits.build(counter, text, edits.LEAF)
        for _ in range(400):
            text, chars, tokens, n = edits.edited(counter, text, chars, tokens, where(len(text)), 0, " five more words stand here")
            recut.append(n)
        assert tokens[1] == count(text) and chars[1] == len(text) and max(recut) < 1200
    for _ in range(300):
        text, chars, tokens, _ = edits.edited(counter, text, chars, tokens, r.randrange(len(text) + 1), r.randrange(90), "")
    assert tokens[1] == count(text) and chars[1] == len(text)


def test_query_equals_library(spark):
    docs = [(1, "One two three. " * 40), (2, None), (3, ""), (4, "x"), (5, " \n \n" * 9), (1, "One two three. " * 40), (1, "other text"), (None, "no id"),
            (6, "word" * 3000), (7, "a<|endoftext|>b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as chars", "2 as seq", "3 as crc")
    got = edits.counts(df, PATH).collect()
    count = library()
    script = {r.doc_id: [] for r in edits.revision(df).collect()}
    for r in edits.revision(df).collect():
        script[r.doc_id].append((r.seq, r.start, r.removed, r.inserted))
    want = []
    for i, t in docs:
        t = t or ""
        before, edited = count(t), t
        for _, start, removed, inserted in sorted(script[i]) if i is not None else ():
            at = min(start, len(edited))
            edited = edited[:at] + inserted + edited[min(at + removed, len(edited)):]
        want.append((str(i), before, count(edited), len(script[i]) if i is not None else 0, len(edited)))
    assert sorted((str(r.doc_id), r.tokens_before, r.tokens_after, r.n_edits, r.n_chars) for r in got) == sorted(want)
    assert edits.counts(df.limit(0), PATH).count() == 0
