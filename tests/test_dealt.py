from quarryline.operators import selection
from quarryline.operators.lessons import absent_name, targets
from quarryline.operators.selection import TASK_ROWS, dealt
from quarryline.plans import facts, lessons


def test_parts_grow_with_the_table(spark):
    df = spark.range(10)
    assert [dealt(df, n, "id").rdd.getNumPartitions() for n in (0, 10, TASK_ROWS, 25 * TASK_ROWS)] == [1, 1, 2, 26]


def test_nets_across_pages_are_dealt_once(spark, sf_dir, capsys):
    facts.cross_page_nets(spark, sf_dir).explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def test_tasks_of_a_large_table_deal_to_parts_without_holding_their_rows(spark):
    assert dealt(spark.range(10), 2000 * TASK_ROWS, "id").rdd.getNumPartitions() == 200  # spark.shuffle.sort.bypassMergeThreshold


def test_nets_are_dealt_as_numbers(spark, sf_dir, capsys):
    lessons._nets(spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "collect_set(l_partkey" in plan


def test_image_turns_deals_nets_once_and_parts_once_in_parts_that_grow_with_the_table(spark, sf_dir, capsys, monkeypatch):
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    monkeypatch.setattr(selection, "TASK_ROWS", n // 10)
    for most, parts in ((200, n // (n // 10) + 1), (3, 3)):
        monkeypatch.setattr(selection, "PARTS", most)
        lessons.image_turns(spark, sf_dir).explain()
        plan = capsys.readouterr().out
        assert plan.count("REPARTITION_BY_NUM") == plan.count(f", {parts}), REPARTITION_BY_NUM") == 3


def test_names_of_nines_count_as_used_on_parts_that_nothing_asks_about(spark):
    bom = spark.createDataFrame([
        (1, "R9999", "1k", False), (1, "R99999", "", True), (1, "R1", "2k", True), (1, "C2", "3k", True),
        (2, "R9", "1k", True), (2, "R2", "1k", True), (3, "R9999", "1k", True), (3, None, "1k", True), (3, "C1", None, True)],
        "sheet long, refdes string, value string, visible boolean")
    nets = spark.createDataFrame([(s, "n", ["A.1", "B.1"]) for s in (1, 2, 3)], "sheet long, net string, pads array<string>")
    found = targets(bom, nets, ["sheet"], visible_only=True)
    assert {(r.sheet, r.first, r.second, r.missing) for r in found.collect()} == {(1, "R1", "C2", "R999999"), (2, "R2", "R9", "R9999")}
    assert {tuple(r) for r in absent_name(bom, ["sheet"]).collect()} == {(1, "R999999"), (2, "R9999"), (3, "R99999")}
