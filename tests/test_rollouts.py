from datetime import datetime, timedelta

import pytest
from oracle import of_spark, of_sql
from pyspark.sql import functions as F

from quarryline.operators import rollouts as R
from quarryline.plans import rollouts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("said,want", [
    ("No results found.", (True, 0)), ("no results", (True, 0)), ("The lookup yielded zero matches; U1 is LM317", (True, 0)), ("lm317.", (False, 0)), ("Unable to verify", (False, 1)),
    ("I am unable to retrieve the datasheet. Check the manufacturer's datasheet for ratings.", (True, 0)), ("No results. Its limit is 40 V.", (True, 1)),
    ("No  results", (True, 0)), ("no results indeed", (False, 1)), ("", (False, 0)), (None, (False, 0)), ("U2 is LM317", (False, 1))])
def test_answers_to_empty_searches(spark, said, want):
    got = one(spark, R.search_answer(F.lit(said).cast("string"), F.lit("U1"), F.lit("LM317")))
    assert (got.acknowledged, got.unknown, got.passed) == (*want, want == (True, 0))


@pytest.mark.parametrize("said,value,clarify,refusal,want", [
    ("It is 10K", "10k", False, False, True), ("It is 10K", "11k", False, False, False), (" \n", None, False, False, False), (None, None, None, None, False), ("ok", None, None, None, True),
    ("a <|im_start|>", None, False, False, False), ("a\nHuman: b", None, False, False, False), ("Which part?", None, True, False, True), ("Which parts?", None, True, False, False),
    ("Needs a bench MEASUREMENT", None, False, True, True), ("5 V", None, False, True, False), ("STRASSE", "straße", False, False, True)])
def test_final_answers(spark, said, value, clarify, refusal, want):
    text, flag = (lambda v: F.lit(v).cast("string")), (lambda v: F.lit(v).cast("boolean"))
    assert one(spark, R.final_fits(text(said), text(value), flag(clarify), flag(refusal))) is want


def test_routing(spark):
    cases = [
        ("Which parts?", 0, None, None, None, True), ("Which one?", 0, None, None, None, False), ("Which part?", 1, "web_search", "{}", None, False),
        (None, 1, "web_search", '{"query": "the lm317 sheet"}', "web_search", True), (None, 1, "web_search", '{"query": "lm", "n": 1}', "web_search", False),
        (None, 2, "show_label", '{"label": "U1"}', "show_label", False), (None, 1, "show_label", '{"label": "U1"}', "show_label", True),
        (None, 1, "show_label", '{"label": "u1"}', "show_label", False), (None, 1, "show_label", "{", "show_label", False), (None, 1, None, None, "show_label", False), (None, None, None, None, None, False)]
    df = spark.createDataFrame([(*c[:5], "U1", "LM317", c[5]) for c in cases],
                               "content string, n_calls int, function string, arguments string, tool string, refdes string, part string, want boolean")
    assert [r.correct for r in R.routed(df).collect()] == [c[5] for c in cases]


def test_viewer_state(spark):
    def e(tool, status="shown", box=None, label=None):
        return (tool, status, box, label)

    turns = [
        ("a", 0, False, False, [e("show_label", box=[1, 1, 2, 2], label="R1"), e("web_search")], "1 R1"), ("a", 1, False, False, [], "1 R1"), ("a", 2, False, True, None, "1 None"),
        ("a", 3, False, False, [e("show_region", box=[3, 3, 4, 4]), e("show_label", status="missing", box=[9, 9, 9, 9], label="X")], "3 None"),
        ("a", 4, True, False, [e("show_label", box=[5, 5, 6, 6], label="R5")], "5 R5"), ("a", 5, False, True, [e("show_full_sheet")], "5 R5"), ("b", 0, None, None, [e("show_full_sheet")], "0 None")]
    form = "case string, turn int, error boolean, clears boolean, events array<struct<tool:string,status:string,box:array<int>,label:string>>, want string"
    got = R.viewed(spark.createDataFrame(turns, form), "case", "turn").orderBy("case", "turn").collect()
    assert [f"{r.after[0]} {r.focus}" for r in got] == [t[5] for t in turns]
    assert [r.blocked for r in got] == [False] * 5 + [True, False]
    assert [r.still for r in got] == [False, True, True, False, False, False, False]  # trying to move is not still
    none = R.viewed(spark.createDataFrame([], form), "case", "turn").withColumns({"passed": F.lit(True), "allowed": F.lit(True)})
    assert tuple(R.reported(none).first()) == (0, 0, 0, 0, 0, 0)


def test_cancellations(spark):
    zero = datetime(2024, 1, 1)
    told = {"early": [(0, "cancel"), (29, "start")], "late": [(0, "cancel"), (30, "start")], "spent": [(0, "cancel"), (1, "finish"), (2, "start")],
            "active": [(0, "start"), (99, "cancel")], "done": [(0, "start"), (1, "finish"), (2, "cancel")], "again": [(0, "cancel"), (20, "cancel"), (40, "start")]}
    rows = [(k, zero + timedelta(seconds=s), i, kind) for k, es in told.items() for i, (s, kind) in enumerate(es)]
    df = spark.createDataFrame(rows, "k string, at timestamp, tie int, kind string")
    got = {r.k for r in R.cancelled(df, "k", "at", "tie", 30).collect() if r.cancelled}
    assert got == {"early", "active", "again"}


@pytest.mark.parametrize("name", sorted(rollouts.QUERIES))
def test_larger_tables(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    assert of_spark(rollouts.QUERIES[name](spark, sf_dir)) == of_sql(rollouts.ORACLES[name], sf_dir)
