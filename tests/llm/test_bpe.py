import hashlib
import random

import public_tokenizers
import tokenizers

from quarryline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    r = random.Random(5)
    alphabet = "abcdefgthe  \n\t'sre<|endoftext|>éß漢字👍0123.,!?  \x1c\x85²Ⅷ"
    out = [None, "", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "it's we'll I'VE", "  two  spaces \n\n x"]
    out += ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 90))) for _ in range(400)]
    out += ["".join(r.choice("abe") for _ in range(r.randrange(1, 120))) for _ in range(200)]
    return [*out, "word " * 20_000, "x" * 20_000, out[20], out[20]]


def test_equals_library_and_round_trips(spark):
    docs = list(enumerate(texts())) + [(None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    t = tokenizers.Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in bpe.digests(df.selectExpr("*", "'x' as ids", "1 as decoded"), PATH).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert back == (text or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), back)]
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), *sha), text


def test_decode_alone_and_empty(spark):
    df = spark.createDataFrame([(1, [0, 256, 50256]), (2, None), (3, [])], "doc_id long, ids array<int>")
    t = tokenizers.Tokenizer.from_file(PATH)
    got = {r.doc_id: r.decoded for r in bpe.decode(df, PATH).collect()}
    assert got == {1: t.decode([0, 256, 50256], skip_special_tokens=False), 2: "", 3: ""}
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_small_memory_gives_the_same(monkeypatch):
    v = bpe.Vocabulary(PATH)
    patterns = [bpe.pre_token_pattern(bpe.NARROW), bpe.pre_token_pattern()]
    whole = [bpe.Encoder(v, patterns)(t).tolist() for t in texts()[:60]]
    monkeypatch.setattr(bpe, "CACHE", 3)
    assert [bpe.Encoder(v, patterns)(t).tolist() for t in texts()[:60]] == whole


def test_every_code_point():
    """The classes of code points are the library's, of which the module regex and Python know other versions."""
    v, t = bpe.Vocabulary(PATH), tokenizers.Tokenizer.from_file(PATH)
    encoder = bpe.Encoder(v, [bpe.pre_token_pattern(bpe.NARROW), bpe.pre_token_pattern()])
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    for text in (every, "".join(f"{c}a " for c in every[:0x3000] + every[0xA000:0x20000:3] + every[0x30000::997])):
        assert encoder(text).tolist() == t.encode(text, add_special_tokens=False).ids
