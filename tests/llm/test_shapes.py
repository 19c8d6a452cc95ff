"""Nulls, empty and very long texts, repeated rows, empty tables and columns of any name, for all
operators and stages."""
import re
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest

import corpus_pipeline
import quarryline.llm
from quarryline.llm import bpe, decontam, edits, htmltext, lattice, licenses, linededup, neardup, quality, replay, sharding

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
OWN = {"doc_id", "text", "lang", "source"}
#: Every short string in the operators' code that could be a column's name.
NAMES = sorted({n for f in Path(quarryline.llm.__file__).parent.glob("*.py") for s in re.findall(r"\"([^\"\n]*)\"", f.read_text())
                for n in re.findall(r"\b[a-z_][a-z0-9_]{0,30}\b", s)} - OWN)
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000)) + "\n" + "z" * 20_000
PLAIN = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [(1, PLAIN, "en", "a"), (1, PLAIN, "en", "a"), (2, None, None, None), (3, "", "", ""), (4, LONG, "en", "a"), (None, PLAIN + " thirteen", None, "a"),
        (5, "Hallo Welt\n\nHallo Welt", "de", None), (6, "x\u00e9 " * 40, "fr", "b"), (7, PLAIN + " more", "en", "a")]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, names=(), n=None):
    df = spark.createDataFrame(DOCS[:n], SCHEMA)
    return df.selectExpr("*", *(f"{k} as `{x}`" for k, x in enumerate(names))).coalesce(2)


def benchmark(spark):
    return spark.createDataFrame([("i", PLAIN), (None, "a b"), ("n", None)], "item_id string, text string")


OPERATORS = {
    "quality": lambda d: quality.quality(d), "edits": lambda d: edits.counts(d, BPE), "lattice": lambda d: lattice.score(d, PIECES),
    "neardup": lambda d: neardup.near_duplicates(d), "licenses": lambda d: licenses.licences(licenses.laid_out(d)), "bpe": lambda d: bpe.digests(d, BPE),
    "replay": lambda d: replay.digests(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "htmltext": lambda d: htmltext.extract(d.selectExpr("doc_id as page_id", "source as url", "text as html", *(f"`{c}`" for c in d.columns if c not in
                                                                                                           ("page_id", "url", "html")))),
    "decontam": lambda d: decontam.digests(d, benchmark(d.sparkSession)), "linededup": lambda d: linededup.digests(d), "sharding": lambda d: sharding.shards(d)}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, name):
    rows = lambda df: Counter(map(str, df.collect()))
    plain = rows(OPERATORS[name](documents(spark)))
    assert sum(plain.values()) == len(DOCS)
    assert rows(OPERATORS[name](documents(spark, NAMES))) == plain
    assert OPERATORS[name](documents(spark, n=1).limit(0)).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages(spark, tmp_path, name, stage):
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda r: (r.doc_id, r.text)
    plain = sorted(map(key, stage(spark, documents(spark), str(tmp_path)).collect()), key=str)
    names = [n for n in NAMES if n != "n_chars"]
    df = documents(spark, names)
    got = stage(spark, df, str(tmp_path))
    rows = got.collect()
    assert got.schema.simpleString() == df.schema.simpleString() and 0 < len(rows) < len(DOCS) or name == "line_dedup"
    assert sorted(map(key, rows), key=str) == plain and all(tuple(r)[4:] == tuple(range(len(names))) for r in rows)
    assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_several_blocks_keep_the_columns(spark):
    df = documents(spark, ["_row", "row", "row_bad", "n_words", "spans"])
    left = decontam.remove_contaminated(df, benchmark(spark), block_bytes=10).collect()
    assert {r.doc_id for r in left} == {2, 3, 4, 5, 6, 7} - {7} and all(tuple(r)[4:] == (0, 1, 2, 3, 4) for r in left)


def test_last_stage(spark):
    rows = corpus_pipeline.encode(spark, documents(spark, NAMES), "").collect()
    assert len(rows) == len(DOCS)
