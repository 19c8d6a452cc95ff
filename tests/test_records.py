from pyspark.sql import functions as F

from quarryline.operators import records as R


def test_running_budget(spark):
    rows = [(1, 0, "abcd"), (1, 1, None), (1, 2, "efgh"), (1, 3, "ij"), (2, 0, ""), (2, 1, "xyz")]
    df = spark.createDataFrame(rows, "k long, o long, t string")
    got = {(r.k, r.o): (r.kept, r.truncated) for r in R.running_budget(df, "k", "o", "t", 6).collect()}
    assert got == {(1, 0): ("abcd", False), (1, 1): (None, None), (1, 2): ("ef", True), (1, 3): ("", True), (2, 0): ("", False), (2, 1): ("xyz", False)}
    assert R.running_budget(df.limit(0), "k", "o", "t", 6).count() == 0


def test_lookup_prefers_earlier_tables(spark):
    a = spark.createDataFrame([("X", "9"), ("x", "2")], "name string, id string")
    b = spark.createDataFrame([("x", "1"), ("y", "5"), (None, "0")], "name string, id string")
    asked = spark.createDataFrame([("X",), ("Y",), ("z",), (None,)], "asked string")
    got = {r.asked: (r["rank"], r.id) for r in R.prioritised(asked, "asked", [a, b]).collect()}
    assert got == {"X": (0, "2"), "Y": (1, "5"), "z": (None, None), None: (None, None)}


def test_cardinality_and_agreement(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "k long, v string")
    b = spark.createDataFrame([(2, "y"), (3, None), (4, "w"), (5, "v")], "k long, v string")
    assert {r.k: r.verdict for r in R.agreement(a, b, ["k"], ["v"]).collect()} == {1: "a only", 2: "same", 3: "same", 4: "differs", 5: "b only"}
    many = spark.createDataFrame([(2,), (2,), (3,)], "k long")
    assert {r.k: r.matches for r in R.matches(a, many, "k").collect()} == {1: "none", 2: "several", 3: "one", 4: "none"}


def test_grading_by_label(spark):
    rows = [("value", "It is 10k.", "10k", None), ("value", "It is 110k.", "10k", None), ("refuse", "It is not shown here.", None, None),
            ("pins", "R1.1 and R2.2", None, ["R1.1", "R2.2"]), ("pins", "It is floating.", None, []), ("view", "x", None, None), ("value", None, "10k", None)]
    df = spark.createDataFrame(rows, "type string, output string, value string, pins array<string>").withColumns({"query": F.lit("U1.1"), "net": F.lit("N1")})
    assert [(r.metric, r.score) for r in R.graded(df).collect()] == [
        ("value_exact", 1.0), ("value_exact", 0.0), ("refuse_acc", 1.0), ("pins_f1", 1.0), ("pins_f1", 1.0), (None, None), ("value_exact", 0.0)]


def test_states_and_numbers(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c.alias("x")).first().x
    assert [ask(R.job_state(F.lit(c).cast("int"))) for c in (None, 0, 75, 1)] == ["running", "completed", "queued", "failed"]
    assert [ask(R.steps(F.lit(n), 4, 4, 3, 100)) for n in (0, 1, 16, 17, 9999)] == [0, 3, 3, 6, 100]
    number = lambda op, a, b: ask(R.calculated(F.lit(op), F.lit(a), F.lit(b)))
    assert [number("add", 1.0, 2.0), number("div", 1.0, 0.0), number("div", 1.0, 4.0), number("mul", 1e300, 1e300), number("pow", 1.0, 1.0)] == [3.0, None, 0.25, None, None]
    e = spark.createDataFrame([(1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 00:05:00"), (3, 7, "2024-01-01 00:10:01")], "id long, u long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {r.id: r.state for r in R.token_states(e, "u", "ts", "id", 300).collect()} == {1: "used", 2: "expired", 3: "open"}
    talk = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "r")], "conv_id long, turn long, role string, text string")
    assert sorted((r.n, r.question, r.answer) for r in R.aligned(talk).collect()) == [(0, "q", "a"), (1, "r", "b")]


def test_view_grading(spark):
    call = "<tool_call><function={}>{}</function></tool_call>"
    label, box = "<parameter=label>r1</parameter>", "<parameter=box>[0, 0, 10, 10]</parameter>"
    rows = [(call.format("show_label", label), "show_label", "R1", None, None), (call.format("show_label", label), "show_label", "R2", None, None),
            (call.format("show_region", box), "show_region", None, [0, 0, 10, 10], 0.9), (call.format("show_region", box), "show_region", None, [5, 0, 15, 10], 0.5),
            (call.format("show_full_sheet", ""), "show_full_sheet", None, None, None), (call.format("show_full_sheet", "") * 2, "show_full_sheet", None, None, None),
            ("no call", "show_full_sheet", None, None, None), (None, "show_label", "R1", None, None)]
    df = spark.createDataFrame(rows, "output string, function string, label string, box array<int>, min_iou double")
    assert [r.score for r in R.view_graded(df).collect()] == [1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0]
