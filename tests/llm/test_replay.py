import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from quarryline.llm import replay

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def library(path, pattern=PATTERN):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(5)
    alphabet = "abcdefgthe  \n\t'sre<|endoftext|>éß漢字👍0123.,!?  \x1c\x85²Ⅷ"
    out = [None, "", " ", "<|endoftext|>", "it's we'll I'VE", "  two  spaces \n\n x"]
    out += ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 90))) for _ in range(400)]
    out += ["".join(r.choice("abe") for _ in range(r.randrange(1, 120))) for _ in range(200)]
    return [*out, "word " * 20_000, "x" * 20_000, out[20], out[20]]


def test_equals_library_and_round_trips(spark):
    docs = list(enumerate(texts())) + [(None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lib = library(PATH)
    got = {r.doc_id: r for r in replay.digests(df.selectExpr("*", "'x' as ids", "1 as decoded"), PATH, PATTERN).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        ids = lib.encode_ordinary(text or "")
        sha = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (text or "").encode())]
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), *sha), text


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_every_code_point(name):
    """The pattern's classes are the library's, of which the module regex and Python know other versions."""
    path = public_tokenizers.path(name)
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    ranks, block = replay.Ranks(path), replay.Block([replay.explicit(PATTERN, replay.NARROW), replay.explicit(PATTERN)])
    some = every[:0x3000] + every[0xA000:0x20000:3] + every[0x30000::997]
    given = [every, "".join(f"{c}a " for c in some), "".join(f" {c}{c}1" for c in some)]
    for i, text in enumerate(given):
        block.add(i, text)
    lib = library(path)
    for i, ids in block.encoded(ranks):
        assert ids.tolist() == lib.encode_ordinary(given[i])
        assert ranks.decode(ids).decode() == given[i]


@pytest.mark.parametrize("seed", range(12))
def test_any_table_of_ranks(tmp_path, seed):
    """Tables that no training made: merges that make pairs of lower ranks, tokens that no merge reaches."""
    r = random.Random(seed)
    path = str(tmp_path / "ranks")
    tokens = [bytes([b]) for b in range(256)]
    made = {bytes(r.choices(b"ab", k=r.randrange(2, 6))) for _ in range(seed * 3)} | {bytes(r.choices(b"abc", k=2)) for _ in range(6)}
    tokens += r.sample(sorted(made), len(made))
    if seed % 2:
        r.shuffle(tokens)
    with open(path, "wb") as f:
        f.write(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    words = ["".join(r.choices("abc", [5, 5, 1], k=r.randrange(1, 30))) for _ in range(400)] + ["a" * k for k in range(1, 30)]
    ranks = replay.Ranks(path)
    ids, upto = replay.replay([w.encode() for w in words], ranks)
    lib = library(path, r"\w+")
    starts = [0, *upto[:-1].tolist()]
    for w, a, b in zip(words, starts, upto.tolist(), strict=True):
        assert ids[a:b].tolist() == lib.encode_ordinary(w), w


def test_overlapping_pairs_merge_from_the_left(tmp_path):
    path = str(tmp_path / "ranks")
    with open(path, "wb") as f:
        f.write(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate([bytes([b]) for b in range(256)] + [b"aa", b"aab"])))
    ids, upto = replay.replay([b"aaa", b"", b"aaab", b"aaaab", b"aab", b"b"], replay.Ranks(path))
    assert [x.tolist() for x in map(ids.__getitem__, map(slice, [0, *upto[:-1]], upto))] == [[256, 97], [], [256, 97, 98], [256, 257], [257], [98]]


def test_small_blocks_give_the_same(monkeypatch):
    ranks, given = replay.Ranks(PATH), texts()[:60]

    def run():
        block, out = replay.Block([replay.explicit(PATTERN, replay.NARROW), replay.explicit(PATTERN)]), []
        for i, text in enumerate(given):
            block.add(i, text)
            if block.full:
                out += block.encoded(ranks)
        return [(i, ids.tolist()) for i, ids in [*out, *block.encoded(ranks)]]

    whole = run()
    assert [i for i, _ in whole] == list(range(60))
    monkeypatch.setattr(replay, "WORDS", 3)
    assert run() == whole


def test_decode_alone_and_empty(spark):
    df = spark.createDataFrame([(1, [0, 256, 50255]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in replay.decode(df, PATH).collect()}
    assert got == {1: library(PATH).decode_bytes([0, 256, 50255]), 2: b"", 3: b""}
    assert replay.digests(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).count() == 0
    assert replay.replay([], replay.Ranks(PATH))[0].tolist() == []
