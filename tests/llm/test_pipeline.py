import hashlib
import os
import sys

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tokenizers

sys.path.insert(0, os.path.dirname(__file__))
from test_decontam import brute as contaminated  # noqa: E402
from test_neardup import brute as components  # noqa: E402
from test_linededup import norm  # noqa: E402
from test_quality import judged  # noqa: E402

import corpus_pipeline  # noqa: E402
from quarryline.llm import quality  # noqa: E402


def good(spark, docs):
    """Documents that estimates by sorting keep; those beside the cut-off go by the query."""
    want = judged([(d["doc_id"], d["text"], d["lang"], d["source"]) for d in docs])
    df = spark.createDataFrame(pa.Table.from_pylist(docs).to_pandas()[["doc_id", "text", "lang", "source"]])
    got = {r.doc_id: r.kept for r in quality.quality(df).collect()}
    close = {i for i, (d2, _) in want.items() if d2 is not None and abs(d2 / quality.CHI2_9999 - 1) < 0.05}
    assert len(close) < 0.05 * len(docs)
    return [d for d in docs if (got if d["doc_id"] in close else {i: k for i, (_, k) in want.items()})[d["doc_id"]]]


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def fewer_lines(docs):
    earlier, out = {}, []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        kept = []
        for line in d["text"].split("\n"):
            line, shown = norm(line), line
            w = line.split(" ")
            # By words where the longer line has eight, by characters where both have fewer and the longer line has twenty.
            ways = [u for u, fits in ((w, len(w) >= 7), (line, len(w) < 8 and len(line) >= 19)) if fits]
            least = {list: 8, str: 20}
            near = any(max(len(u), len(e)) >= least[type(u)] and within_one(u, e) for u in ways for n in (-1, 0, 1) for e in earlier.get((type(u), len(u) + n), {}).values())
            gone = bool(line) and (line in earlier.setdefault(None, set()) or near)
            earlier[None] = earlier.get(None, set()) | {line}
            for u in ways:
                earlier.setdefault((type(u), len(u)), {})[line] = u
            if not gone:
                kept.append(shown)
        text = "\n".join(kept)
        if text == d["text"] or text.split():
            out.append({**d, "text": text})
    return out


@pytest.mark.parametrize("sources", [20, 1])
def test_equals_brute_force(spark, tmp_path, sources):
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    if sources == 1:  # groups large enough for estimates
        docs = [{**d, "source": "one"} for d in docs]
    items = pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pylist()
    schema = pq.read_schema("/root/testdata/sf0.001/documents.parquet")
    pq.write_table(pa.Table.from_pylist(docs, schema), tmp_path / "documents.parquet")
    pq.write_table(pa.Table.from_pylist(items), tmp_path / "benchmark.parquet")
    left = fewer_lines(good(spark, docs))
    parts = components([(d["doc_id"], d["text"]) for d in left], 80)
    left = [d for d in left if parts[d["doc_id"]][1] == d["doc_id"]]
    pairs = [(i["item_id"], i["text"]) for i in items]
    left = [d for d in left if not contaminated(d["text"], pairs)[4]]
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d in left:
        ids = t.encode(d["text"], add_special_tokens=False).ids
        want[d["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 50 < len(want) < len(docs)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), "/root/testdata/sf0.001").schema.simpleString() == docs.schema.simpleString()
