import json
import random

from quarryline.plans import wire as wire_plans
from quarryline.operators import views, wire

PARTS = "page int, refdes string, value string, visible boolean, box array<int>"
NETS = "page int, net string, pads array<string>, box array<int>"
SHEET = [(1, "U1", "NE555", False, [100, 100, 200, 200]), (1, "R1", "10k", True, [300, 100, 340, 160]), (1, "R2", "22k", True, [400, 100, 440, 160]),
         (1, "C1", "1u", True, [500, 100, 540, 160]), (1, "J1", "x", True, None), (1, "A2", "huge", True, [0, 0, 999, 999]), (1, "A3", "flat", True, [5, 5, 5, 9]),
         (1, "r4", "low", True, [1, 1, 2, 2])]
LINES = [(1, "SCL", ["R1.1", "R2.1", "C1.1"], [200, 120, 300, 130]), (1, "SDA", ["R1.2", "R2.2", "C1.2"], [200, 130, 300, 140]), (1, "N$4", ["R1.3", "U1.2"], [200, 150, 400, 160]),
         (1, "GND", ["R1.3", "U1.2"], [0, 0, 10, 10]), (1, "ONE", ["R1.1"], [0, 0, 10, 10]), (1, "BIG", ["R1.1", "R2.2"], [0, 0, 900, 900]), (1, "NONE", ["R1.1", "R2.2"], None)]


def found(spark, parts=SHEET, nets=LINES):
    return views.targets(spark.createDataFrame(parts, PARTS), spark.createDataFrame(nets, NETS), ["page"])


def test_targets(spark):
    assert [tuple(r) for r in found(spark).collect()] == [(1, "R1", "10k", [300, 100, 340, 160], "SCL", [200, 120, 300, 130], "R1", "R2", [300, 100, 440, 160], "R999")]
    more = [*SHEET, (1, "R999", "", False, None), (1, "R99999", "", False, None)]
    assert [r.missing for r in found(spark, more, [*LINES, (1, "R9999", [], None)]).collect()] == ["R999999"]
    over = [(1, "R1", "a", True, [0, 0, 10, 10]), (1, "R2", "b", True, [5, 5, 15, 15]), (1, "C1", "c", True, [8, 8, 12, 12])]
    assert found(spark, over).count() == 0 and found(spark, over[:2]).count() == 0 and found(spark, nets=LINES[2:]).count() == 0
    late = [*over, (1, "D1", "d", True, [50, 50, 60, 60])]
    assert [(r.one, r.other) for r in found(spark, late).collect()] == [("C1", "D1")]  # R1 and R2 have no greater name that is apart


def test_pairs_of_dense_pages_are_those_of_all_pairs(spark, capsys):
    """No page's parts are collected into one row, and the pair is the first of all pairs in order."""
    rng = random.Random(7)
    parts, want = [], {}
    for page in range(12):
        names = [f"{p}{i}" for i, p in enumerate(rng.choices("URCA", k=60))]
        spread = (20, 500, 900)[page % 3]  # all overlap, some do, few do
        for name in names:
            x, y = rng.randrange(spread) // 9 * 9, rng.randrange(spread) // 9 * 9
            parts.append((page, name, "v", True, [x, y, x + rng.choice((60, 90)), y + rng.choice((60, 90))]))
        parts += [(page, "r0", "v", True, [0, 0, 9, 9])]
        own = sorted((not n[0] in "UR", n, tuple(b)) for p, n, _, _, b in parts if p == page and n != "r0")

        def together(a, b):
            (_, m, p), (_, n, q) = a, b
            aside = p[2] <= q[0] or q[2] <= p[0] or p[3] <= q[1] or q[3] <= p[1]
            return m < n and aside and (max(p[2], q[2]) - min(p[0], q[0])) * (max(p[3], q[3]) - min(p[1], q[1])) <= views.NET_AREA

        pair = next(((a, b) for a in own for b in own if together(a, b)), None)
        if pair:
            want[page] = (own[0][1], pair[0][1], pair[1][1])
    nets = [(page, "SCL", ["R1.1", "R2.1"], [0, 0, 9, 9]) for page in range(12)]
    df = found(spark, parts, nets)
    assert {r.page: (r["first"], r.one, r.other) for r in df.collect()} == want and 4 <= len(want) < 12
    df.explain()
    assert "collect_set(struct" not in capsys.readouterr().out


def test_lessons_and_their_own_replies(spark):
    made = views.lessons(found(spark), ["page"], views.F.lit("../images/sheet.png"))
    row = made.collect()[0]
    assert row.fault is None and [g.type for g in row.gold] == ["view", "view_reply"] * 3 + ["view", "view_refuse", "view", "view_reply"]
    assert row.messages[0].role == "system" and row.messages[0].content[0].text == wire.preamble(wire.VIEWER) + "\n\n" + views.SYSTEM
    assert [(b.type, b.text or b.image) for b in row.messages[1].content] == [("image", "../images/sheet.png"), ("text", "Show me R1.")]
    replies = ["".join(b.text for b in m.content) for m in row.messages if m.role == "assistant"]
    results = [m.content[0].text for m in row.messages if m.content[-1].text.startswith("<tool_response>")]
    assert [json.loads(t.split("\n")[1]) for t in results] == [
        {"status": "shown", "label": "R1", "kind": "part", "box": [300, 100, 340, 160]}, {"status": "shown", "label": "SCL", "kind": "net", "box": [200, 120, 300, 130]},
        {"status": "shown", "box": [300, 100, 440, 160]}, {"status": "not_found", "label": "R999"}, {"status": "shown", "view": "full_sheet"}]
    assert replies[4] == "<tool_call>\n<function=show_region>\n<parameter=box>\n[300, 100, 440, 160]\n</parameter>\n<parameter=label>\nR1 and R2\n</parameter>\n</function>\n</tool_call>"
    assert len(replies) == len(row.gold) == 10

    def scores(outputs):
        own = [(k, t, *g) for k, (t, g) in enumerate(zip(outputs, row.gold, strict=True))]
        df = spark.createDataFrame(own, "k int, output string, type string, name string, arguments string, label string, min_iou double")
        return [[(s.metric, s.score) for s in r.scores] for r in views.graded(df).orderBy("k").collect()]

    metrics = [["view.call_acc"], ["view.reply_acc"], ["view.call_acc"], ["view.reply_acc"], ["view.call_acc", "view.region_acc"], ["view.reply_acc"], ["view.call_acc"],
               ["view.refuse_acc"], ["view.call_acc"], ["view.reply_acc"]]
    assert scores(replies) == [[(m, 1.0) for m in x] for x in metrics]
    assert scores(["<tool_call>broken"] * 10) == [[(m, 0.0) for m in x] for x in metrics]
    plain = scores(["U1 is at the top left."] * 10)
    assert [x for x in plain if any(s for _, s in x)] == [[("view.reply_acc", 1.0)]]  # a reply whose label names nothing
    one = lambda k, text: dict(scores([text if i == k else "" for i in range(10)])[k])
    assert one(0, "<think>R1?</think>" + replies[0].replace("R1", "r1")) == {"view.call_acc": 1.0} and one(0, replies[0] + "\n" + replies[0]) == {"view.call_acc": 0.0}
    assert one(4, replies[4].replace("440", "400")) == {"view.call_acc": 1.0, "view.region_acc": 1.0} and one(4, replies[4].replace("440", "365")) == {"view.call_acc": 0.0, "view.region_acc": 0.0}
    assert one(1, "showing r1.") == {"view.reply_acc": 1.0} and one(1, "Showing R12.") == {"view.reply_acc": 0.0} and one(1, "$R1") == {"view.reply_acc": 0.0}
    assert one(7, replies[6]) == {"view.refuse_acc": 0.0}


def test_replies_are_parsed_once(spark, sf_dir, capsys):
    wire_plans.view_replies(spark, sf_dir).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_candidates_are_dealt_by_their_number(spark, tmp_path):
    part = spark.range(5000).selectExpr("id as p_partkey", "int(id % 50 + 1) as p_size", "'Brand#1' as p_brand", "'TIN' as p_type")
    part.write.parquet(str(tmp_path / "part.parquet"))
    assert wire_plans._candidates(spark, str(tmp_path)).rdd.getNumPartitions() == 3
