import pytest
from oracle import of_spark, of_sql
from pyspark.sql import functions as F

from quarryline.operators import intake as I
from quarryline.plans import intake
from quarryline.sources import event_logs

CHAT = "id int, messages array<struct<role:string,content:string,blocks:array<struct<type:string,text:string,image:string>>>>"
ASK, TOLD = ("user", "q", None), ("assistant", "a", None)


@pytest.mark.parametrize("messages,fault", [
    ([ASK], None), ([("system", "s", None), ASK, TOLD, ASK], None), ([], "messages"), (None, "messages"), ([ASK] * 6, "messages"), ([TOLD], "roles"), ([ASK, ASK], "roles"),
    ([("system", "s", None), ("system", "s", None), ASK], "roles"), ([(None, "q", None)], "roles"), ([("user", " \n", None)], "blocks"), ([("user", None, None)], "blocks"), ([("user", None, [])], "blocks"),
    ([("user", None, [("file", "x", None)])], "blocks"), ([("user", None, [("text", "x", "y")])], "blocks"), ([ASK, ("assistant", None, [("image", None, "i")]), ASK], "blocks"),
    ([("user", None, [("text", "x", None)] * 33)], "blocks"), ([("user", "x" * 11, None)], "text"), ([("user", None, [("image", None, "i")] * 2)], "images"), ([ASK, TOLD], "end"),
    ([("system", "s", None)], "end"), ([("user", None, [("image", None, "i"), ("text", "x", None)])], None)])
def test_requests(spark, messages, fault):
    row = I.requests(spark.createDataFrame([(1, messages)], CHAT), 5, 1, 10).first()
    assert row.fault == fault and (row.normal is None) == (fault is not None)


def test_texts_of_blocks(spark):
    df = spark.createDataFrame([(1, [("user", None, [("text", "a", None), ("image", None, "i"), ("text", "b", None)]), ("user", None, [("image", None, "i")]), TOLD])], CHAT)
    got = df.select(F.transform("messages", lambda m: I.block_text(m["role"], I.as_blocks(m))).alias("x")).first().x
    assert got == ["a\nb", None, "a"]


def test_details_and_owners(spark):
    df = spark.createDataFrame([(1, "model-1 (x)", "a" * 64, "s"), (2, "m@1", "A" * 64, None), (3, None, "a" * 64 + "\n", "s")], "k int, backend string, adapter_sha256 string, secret string")
    assert [tuple(r) for r in I.safe_details(df, ["k"]).orderBy("k").collect()] == [(1, None, "a" * 64), (2, "m@1", None), (3, None, None)]
    families = spark.createDataFrame([("x", "train"), ("x", "train"), ("y", "test")], "f string, split string")
    rows = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "f string, n int")
    assert [tuple(r) for r in I.owned(rows, families, "f", ["train", "val"]).collect()] == [("x", 1, "train")]
    with pytest.raises(ValueError, match="several splits"):
        I.owned(rows, families.union(spark.createDataFrame([("x", "val")], families.schema)), "f", ["train"])
    with pytest.raises(ValueError, match="several views"):
        I.with_view(rows, families, ["f"], "split")


def test_logs(spark, tmp_path):
    begun, done = '{"event":"attempted"}\n', '{"event":"finished","status":"%s","exit_code":%s}\n'
    logs = {"open": begun, "torn": begun + '{"event":"fin', "good": begun + done % ("succeeded", 0), "failed": begun + done % ("failed", 3), "lied": begun + done % ("succeeded", 1),
            "odd": begun + done % ("happy", 0), "empty": "", "twice": begun * 2, "long": begun + done % ("failed", 1) * 2, "late": done % ("failed", 1), "keys": '{"event":"attempted","event":"attempted"}\n',
            "list": "[]\n", "stub": '{"event":"attempted"}', "huge": begun + " " * (1 << 20)}
    for name, text in logs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "events.jsonl").write_text(text)
    (tmp_path / "open" / "notes.txt").write_text("no log")
    (tmp_path / "bytes").mkdir()
    (tmp_path / "bytes" / "events.jsonl").write_bytes(b'{"event":"\xff"}\n')
    got = {r.id: (r.status, r.torn, r.fault) for r in event_logs.scan(spark, str(tmp_path)).collect()}
    bad = {"lied": "success without exit code 0", "odd": "unknown status", "twice": "bad end", "long": "bad sequence", "late": "bad sequence",
           "keys": "no strict JSON object", "list": "no strict JSON object", "stub": "bad sequence", "huge": "too large", "bytes": "no UTF-8"}
    assert got == {"open": ("incomplete", False, None), "torn": ("incomplete", True, None), "good": ("succeeded", False, None), "failed": ("failed", False, None)} | {
        k: (None, k == "stub", v) for k, v in bad.items()}


@pytest.mark.parametrize("name", sorted(intake.QUERIES))
def test_larger_tables(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    assert of_spark(intake.QUERIES[name](spark, sf_dir)) == of_sql(intake.ORACLES[name], sf_dir)
