import pytest
from pyspark.sql import functions as F

from quarryline.functions import expressions as X
from quarryline.functions import parsers as P
from quarryline.operators import conversations as C
from quarryline.operators import ledger as L
from quarryline.operators import selection as S
from quarryline.streaming import logs


def ask(spark, column, **values):
    return spark.range(1).select(column(**{k: F.lit(v) for k, v in values.items()}).alias("x")).first().x


@pytest.mark.parametrize("answer,value,want", [("It is 150.", "150", True), ("1500", "150", False), ("-150", "150", False), ("150.5", "150", False), ("100nF", "100 nF", True),
                                               ("100\xa0NF cap", "100 nF", True), ("x150", "150", False), ("é150", "150", False), ("a (1 A)", "1 A", True), ("c++", "c++", True)])
def test_value_tokens(spark, answer, value, want):
    assert ask(spark, X.states_value, answer=answer, value=value) is want


@pytest.mark.parametrize("said,gold,want", [("R1.1, R2.2", ["R1.1", "R2.2"], 1.0), ("R1.1 R2.2 R3.3 Q0.0", ["R1.1"], 0.5), ("", ["R1.1"], 0.0), ("It is not connected", [], 1.0),
                                            ("not connected to R1.1", [], 0.0), ("MISO_3.3V R1.1", ["R1.1"], 1.0)])
def test_pin_scores(spark, said, gold, want):
    row = spark.createDataFrame([(said, gold)], "said string, gold array<string>")
    got = row.select(X.pin_f1(X.pins(F.col("said")), F.col("gold"), F.col("said"), F.lit("Q0.0"), F.lit("MISO_3.3V")).alias("x")).first().x
    assert got == pytest.approx(want)


def test_reasoning_and_roles(spark):
    assert ask(spark, X.final_answer, c=" <think>a\nb</THINK>\n x <Think>y") == "x"
    assert ask(spark, X.final_answer, c=None) == ""
    assert ask(spark, X.spills_role, text="a\n Assistant: \r\nb") and not ask(spark, X.spills_role, text="the user: x")
    assert ask(spark, X.refuses, answer="That isn't shown here") and not ask(spark, X.refuses, answer="noon on")
    assert ask(spark, X.canonical_json, c='{"b": 1, "a": [1, null]}') == '{"a":[1,null],"b":1}'


def test_gates_need_evidence(spark):
    rows = spark.createDataFrame([(float("nan"), 3), (0.99, 0), (0.99, 2), (0.9, 2), (None, 2), (1.5, 2)], "v double, n long")
    assert [r.p for r in rows.select(X.passes(F.col("v"), F.col("n"), F.lit(0.95)).alias("p")).collect()] == [False, False, True, False, False, False]


ASK = "What value is R9, and what does it connect to?"


@pytest.mark.parametrize("question,answer,want", [
    (ASK, "R9 is not shown in the schematic.", "restricted_grammar_match"), (ASK, "There is no R9 in the provided evidence. Its value and connections are not shown.", "restricted_grammar_match"),
    (ASK, "R9 is not shown in the schematic. It is 5k.", "unrecognized_or_unsupported_claim"), (ASK, "R8 is not shown in the schematic", "unrecognized_or_unsupported_claim"),
    (ASK, "Its value and connections are not shown", "no_grounded_absence_statement"), (ASK, "<think>x", "empty_answer"), ("Why?", "no", "unsupported_question"),
    ("What measured voltage was observed at R1.2 during a powered bench test?", "No bench measurement for R1.2 is recorded in the sheet.", "restricted_grammar_match")])
def test_refusal_grammar(question, answer, want):
    assert P.refusal_verdict(question, answer)[3] == want


def test_calls_and_fractions(spark):
    call = "<tool_call>\n<function={}>{}</function></tool_call>"
    region = "<parameter=box>\n[1, 2, 3, 4]\n</parameter>"
    assert P.tool_calls(" hi ") == ("hi", "[]", None)
    assert P.tool_calls("See" + call.format("show_region", region)) == ("See", '[{"arguments": {"box": [1, 2, 3, 4]}, "name": "show_region"}]', None)
    for bad in (call.format("show_region", region.replace("3", "0")), call.format("other", ""), call.format("show_full_sheet", "") + " tail", "<tool_call>", "</tool_call>",
                call.format("show_region", region + region), call.format("show_region", "text" + region), call.format("show_region", "<parameter=box>[true,2,3,4]</parameter>")):
        assert P.tool_calls(bad)[2]
    assert [P.exact(k, "3.3", "1000") for k in ("ohms_law_current", "series_resistance", "rc_time_constant", "x")] == ["33/10000", "10033/10", "3300", None]
    assert P.exact("series_resistance", "0", "1") is None and P.exact("series_resistance", "1e3", "1") is None
    df = spark.createDataFrame([(ASK, "R9 is not shown in the schematic.", "STRASSE ß")], "q string, a string, t string")
    row = df.select(P.contextual_refusal("q", "a").alias("v"), P.casefolded("t").alias("t")).first()
    assert row.v.accepted and row.t == "strasse ss"
    assert P.canonical('{"b":"é", "a":1.50}', "C1") == '{"a":1.5,"b":"\\u00e9"}' and P.canonical('{"b":"é","a":2}', "C3") == '{"a": 2, "b": "é"}'


def test_blocking_keeps_denominators(spark):
    talk = [(1, 0, "user", "q"), (1, 1, "user", "q2"), (1, 2, "assistant", "a"), (1, 3, "user", "q3"), (1, 4, "assistant", "b"), (2, 0, "user", "q"), (2, 1, "assistant", "r")]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    t = C.blocked(C.user_turns(df))
    assert {(r.key, r.status, r.caused_by) for r in t.collect()} == {("1#0", "failure", None), ("1#1", "dependency_failed", "1#0"), ("1#2", "dependency_failed", "1#0"), ("2#0", "success", None)}
    r = C.rates(t, [], {"done": "status = 'success'"}).first()
    assert (r.correct, r.total) == (1, 4)
    assert {x.fault for x in C.alternation_faults(df).collect()} == {"repeated role"}


def test_poison_sums_and_selection(spark):
    steps = spark.createDataFrame([("a", 1.0, "x"), ("a", None, "x"), ("b", 1.0, "x"), ("b", 2.0, "y")], "k string, s double, scope string")
    assert {(r.k, r.s, r.scope) for r in L.poison_sums(steps, "k", ["s"], "scope").collect()} == {("a", None, "x"), ("b", 3.0, "mixed")}
    for n in (1, 2, 25, 26, 27, 300):
        got = sorted(r["rank"] for r in S.equally_spaced(spark.range(n), "id", 26).collect())
        assert got == sorted({round(i * (n - 1) / 25) for i in range(26)})
    with pytest.raises(ValueError, match="no"):
        S.require_empty(spark.range(1), "no")


def test_stream_folds_to_the_same_states(spark, tmp_path):
    rows = [(u, e, f"2024-01-01 0{h}:00:00") for u, e, h in ((1, "attempted", 1), (2, "attempted", 1), (1, "finished", 2), (3, "finished", 3))]
    df = spark.createDataFrame(rows, "user_id long, event string, ts string").withColumn("ts", F.to_timestamp("ts"))
    for part in range(2):
        df.where(F.col("user_id") % 2 == part).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        logs.fold_to(stream, "user_id", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    states = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, logs.current(states, "user_id").collect())) == sorted(map(tuple, L.folded(df, "user_id").collect()))
    plan, done = spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("a",)], "key string")
    assert [r.key for r in logs.pending(plan, done).collect()] == ["b"]
    with pytest.raises(ValueError):
        logs.pending(done, plan)


def test_another_subject_is_no_part_of_the_table(spark, tmp_path):
    """contextual_refusal: the answer about another part must not name the part with key 0."""
    import duckdb

    from quarryline.plans import facts

    spark.range(64).selectExpr("id div 32 * 7 as p_partkey", "cast(id % 32 as int) as p_size").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted((*map(str, r),) for r in facts.contextual_refusal(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted((*map(str, r),) for r in con.execute(facts.ORACLES["contextual_refusal"]).fetchall())


def test_calls_are_parsed_of_what_begins_with_one(spark):
    call = "<tool_call><function=show_label><parameter=label>R1</parameter></function></tool_call>"
    texts = [None, "", " \x1fhi\u2003", f"\x85 See. {call}", call, call * 2, call * 5, "<tool_call>", "a</tool_call>", f"</tool_call>{call}", f"{call} x", f"é\U0001f600 {call}\n", "</tool_call>" * 2 + "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", P.parsed_calls(F.col("t")).alias("v"))
    assert [tuple(r.v) for r in df.orderBy("k").collect()] == [P.tool_calls(t) for t in texts]
    # Answers without a call are not in the batches for Python.
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN Contains" in plan.split("Project")[-1]


def test_white_space_and_letter_case_as_python_has_them(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(chr(c),) for c in points if c < 0x3100], "c string")
    cut = lambda f: {r.c for r in df.where(f(F.concat("c", F.lit("x"), "c")) == "x").collect()}
    assert cut(X.python_stripped) == {chr(c) for c in points if chr(c).isspace()}
    assert cut(X.stripped) == cut(lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    folds = {chr(c): chr(c).casefold() for c in points if c > 127 and chr(c).casefold().isascii()}
    assert folds == P._FOLDS
    pairs = [("Straße1", "STRASSE1"), ("\u212a1", "k1"), ("İ", "i"), ("Å", "a"), ("r1", "R1"), ("r1", "R2")]
    got = spark.createDataFrame(pairs, "o string, l string").select(P.same_label(F.col("l"), F.col("o")).alias("s")).collect()
    assert [r.s for r in got] == [a.casefold() == b.casefold() for a, b in pairs]
