import random

import pytest
from pyspark.sql import functions as F

from quarryline.streaming import tokens

SCHEMA = "key string, event_id long, ts timestamp, kind string, token string, purpose string, size long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def frame(spark, events):
    return spark.createDataFrame([(k, i, t, kind, token, p, s) for k, i, t, kind, token, p, s in events], SCHEMA.replace("ts timestamp", "t long")).withColumn(
        "ts", F.timestamp_millis(F.col("t") * 1000)).drop("t")


def rows(df):
    return sorted(((r.key, r.at, -1 if r.event_id is None else r.event_id, r.token, r.verdict) for r in df.collect()))


def verdicts(spark, events, machine, **more):
    found = sorted(tokens.settled(frame(spark, events), machine, **more).withColumn("at", F.unix_seconds("at")).collect(), key=lambda r: (r.at, r.event_id is not None, r.event_id or 0))
    return [(r.at, r.token, r.verdict) for r in found]


def test_approvals(spark):
    ask = lambda i, t, token, size=1, p="search": ("a", i, t, "ask", token, p, size)
    answer = lambda i, t, token, p="search": ("a", i, t, "answer", token, p, None)
    assert verdicts(spark, [ask(1, 0, "x"), answer(2, 299, "x"), answer(3, 299, "x"), ask(4, 400, "y"), answer(5, 700, "y"), answer(6, 1, "x", "other"), answer(7, 5, "none")], tokens.Approvals()) == [
        (0, "x", "open"), (1, "x", "invalid"), (5, "none", "invalid"), (299, "x", "used"), (299, "x", "invalid"), (400, "y", "open"), (700, "y", "expired"), (700, "y", "invalid")]
    many = [ask(k, k, f"t{k}") for k in range(10)] + [answer(20, 20, "t0"), ask(21, 21, "late"), ask(22, 22, "late")]
    assert [v for _, _, v in verdicts(spark, many, tokens.Approvals())] == ["open"] * 8 + ["refused"] * 2 + ["used", "open", "repeated"]
    assert [v for _, _, v in verdicts(spark, [ask(1, 1, "x", 60), ask(2, 2, "y", 41), ask(3, 3, "z", 40)], tokens.Approvals(room=100))] == ["open", "refused", "open"]
    assert verdicts(spark, [ask(1, 0, "x"), ask(1, 0, "x")], tokens.Approvals(), upto="1970-01-01T00:05:00") == [(0, "x", "open"), (300, "x", "expired")]


def test_cancellations(spark):
    a, b, c = ("0123456789abcdef" * 2, "f" * 32, "e" * 64)
    event = lambda i, t, kind, token: ("p", i, t, kind, token, None, None)
    assert verdicts(spark, [
        event(1, 0, "start", a), event(2, 1, "start", a), event(3, 2, "cancel", a), event(4, 3, "finish", a), event(5, 4, "start", a), event(6, 10, "cancel", b), event(7, 39, "start", b),
        event(8, 50, "cancel", c), event(9, 80, "start", c), event(10, 90, "start", "short")], tokens.Cancellations()) == [
        (0, a, "started"), (1, a, "already active"), (2, a, "stopped"), (3, a, "finished"), (4, a, "started"), (10, b, "waiting"), (39, b, "cancelled"), (50, c, "waiting"),
        (80, c, "expired"), (80, c, "started"), (90, "short", "bad token")]
    many = [event(k, 0, "cancel", f"{k:032x}") for k in range(33)] + [event(40, 1, "cancel", f"{0:032x}"), event(41, 30, "cancel", f"{40:032x}")]
    assert [v for _, _, v in verdicts(spark, many, tokens.Cancellations())] == ["waiting"] * 32 + ["refused", "waiting"] + ["expired"] * 31 + ["waiting"]


@pytest.mark.parametrize("machine", [tokens.Approvals(seconds=20, most=3, room=100), tokens.Cancellations(seconds=20, most=3)], ids=lambda m: type(m).__name__)
def test_stream_equals_batch_after_a_restart(spark, tmp_path, machine):
    """Events arrive out of order, some twice, over a restart; the last one moves the watermark past all others."""
    r = random.Random(7)
    kinds = ("ask", "answer") if isinstance(machine, tokens.Approvals) else ("start", "cancel", "cancel", "finish")
    token = (lambda: f"t{r.randrange(6)}") if isinstance(machine, tokens.Approvals) else (lambda: f"{r.randrange(6):032x}")
    events = [(r.choice("ab"), i, 1000 + i // 2, r.choice(kinds), token(), r.choice("pp q"), r.randrange(60)) for i in range(120)]
    arriving = sorted(events, key=lambda e: e[2] + r.randrange(15))
    folder = tmp_path / "in"
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        def run(some):
            frame(spark, some).coalesce(1).write.mode("append").parquet(str(folder))
            source = spark.readStream.schema(SCHEMA).parquet(str(folder))
            q = tokens.stream(source, machine, "20 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
                "checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()

        run(arriving[:50])
        run(arriving[50:] + arriving[45:60])
        run([("z", 999, 5000, kinds[0], "0" * 32, "p", 1)])
        run([("a", 1, 1001, kinds[0], "9" * 32, "p", 1)])  # too late by far
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if old is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = [x for x in rows(spark.read.parquet(str(tmp_path / "out"))) if x[0] != "z"]
    assert got == rows(tokens.settled(frame(spark, events), machine, upto="1970-01-01T01:20:00")) and len(got) > 120
