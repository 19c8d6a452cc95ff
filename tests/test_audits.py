import pytest
from pyspark.sql import functions as F

from quarryline.operators import audits as A
from quarryline.operators.durable import settled
from quarryline.operators.selection import ranked

LABELS = "labels array<struct<type:string,refdes:string>>"


def counters(spark, rows):
    return {r.counter: r.n for r in A.probe_counters(spark.createDataFrame(rows, LABELS), "labels").collect()}


def test_probe_counters(spark):
    v = lambda ref: ("value", ref)
    got = counters(spark, [([v("R1"), v("R2"), ("refuse", None)],), ([v("R1"), v("R1")],), ([v(None), v("R1")],), ([v("R1")],), (None,), ([],)])
    assert got == {"source_rows": 6, "source_rows_with_3_turns": 1, "source_rows_with_2_turns": 2, "source_rows_with_1_turns": 1, "source_rows_with_0_turns": 2,
                   "source_turns": 8, "source_value_turns": 7, "source_value_followups": 3, "skipped_repeated_target": 1, "skipped_unsupported_question": 1,
                   "skipped_no_initial_value_pair": 3, "paired_source_rows": 1, "derived_rows": 3}
    assert counters(spark, []) == {"derived_rows": 0}


def test_wordings_must_be_so_many(spark):
    cases = spark.createDataFrame([("a",), ("b",), ("b",)], "q string")
    assert A.require_wordings(cases, "q", 2).count() == 3
    with pytest.raises(ValueError, match="3 different wordings"):
        A.require_wordings(cases, "q", 3)


@pytest.mark.parametrize("late, why", [((3, "f", "dev", "x"), "unknown"), ((1, "f", "train", "x"), "twice"), ((3, "f", "val", "x"), "several splits"), ((None, "f", "train", "x"), "unknown")])
def test_rows_behind_the_first_are_checked_too(spark, late, why):
    good = [(1, "f", "train", "x"), (2, "f", "train", "y"), (9, "f", "nonsense", " 　")]
    made = lambda rows: A.first_checked(spark.createDataFrame(rows, "k int, f string, s string, t string"), "k", "f", "s", "t", 1)
    assert [r.k for r in made(good).collect()] == [1]
    with pytest.raises(ValueError, match=why):
        made([*good, late])


def test_changes_furthest_and_priority(spark):
    before = spark.createDataFrame([(0, "a"), (1, None)], "i int, sha string")
    after = spark.createDataFrame([(0, "b"), (1, None), (2, None)], "i int, sha string")
    assert {r.i: r.changed_since_start for r in A.changed(before, after, "i", ["sha"]).collect()} == {0: True, 1: False, 2: True}
    states = spark.createDataFrame([("r", None, 0), ("r", 0, 1), ("s", 5, 0), ("s", 7, 1), ("s", 7, 2)], "run string, step int, place int")
    assert {(r.run, r.place) for r in A.furthest(states, "run", "step", "place").collect()} == {("r", 0), ("s", 1)}
    c = spark.createDataFrame([(1, "b", 0), (1, "a", 5), (1, "a", 4), (2, "z", 0)], "k int, n string, t int")
    assert [tuple(r) for r in A.first_by_priority(c, ["k"], "n", ["a", "b"], "t").collect()] == [(1, "a", 4)]


def test_image_faults(spark):
    sha = "a" * 64
    rows = [(1, [(1, sha), (2, "x")], [sha]), (2, [(1, sha), (2, "x")], [sha]), (3, [(1, sha)], [sha]), (1, [(1, sha), (1, sha)], [sha]), (1, [(1, sha)], ["b" * 64]),
            (1, [(1, sha)], []), (1, [(1, sha)], None), (1, None, [sha]), (0, [(0, sha)], [sha]), (None, [(1, sha)], [sha]), (1, [(None, sha), (1, None)], [sha]), (1, [(1, sha)], [None])]
    df = spark.createDataFrame(rows, "page int, d array<struct<page:int,sha256:string>>, im array<string>")
    got = [r[0] for r in df.coalesce(1).select(A.image_fault(F.col("page"), F.col("d"), F.col("im"))).collect()]
    assert got == [None, "form", "fingerprint", "fingerprint", "differs", "images", "images", "provenance", "provenance", "provenance", "fingerprint", "differs"]


def test_audit_counts_and_composition_of_nothing(spark):
    t = spark.createDataFrame([("train", ["x"]), ("train", []), ("val", None)], "split string, flags array<string>")
    assert {tuple(r) for r in A.audit_counts(t, "split", "flags").collect()} == {("train", 2, 1, 1), ("val", 1, 0, 1)}
    none = spark.createDataFrame([], "row int, kind string, absent string")
    assert {tuple(r) for r in A.composition(none, "row", "kind", "absent").collect()} == {("rows", 0), ("turns", 0), ("absent_identifiers", 0)}


def test_addresses_are_filtered_behind_the_cap(spark):
    r = spark.createDataFrame([("q", i, u) for i, u in enumerate(["ftp://a", "https://b" + "c" * 3000, None, "http://d"])], "q string, i int, u string")
    assert [(x.i, len(x.u)) for x in A.search_results(r, "q", "i", "u", 3).collect()] == [(1, 2048)]


def test_settled_rows_and_ranks_stay(spark):
    df = settled(spark.range(1000).withColumn("x", F.rand()))
    assert sorted(df.collect()) == sorted(df.collect())
    got = ranked(spark.range(1000).withColumn("v", F.col("id") % 7), [F.col("v"), F.col("id").desc()]).collect()
    want = sorted(range(1000), key=lambda i: (i % 7, -i))
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == want


def test_addresses_are_made_of_the_first_results_only(spark, sf_dir, capsys):
    from quarryline.plans import audits

    audits.search_hits(spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert 0 <= plan.index("repeat(") and plan.rindex("repeat(") < plan.index("Window")
