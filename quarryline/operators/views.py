"""Lessons in which a model drives the viewer of a drawing, and grading of what it answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import expressions as X
from quarryline.functions import parsers as P

from . import wire
from .durable import settled
from .selection import first_of

#: Forms of parts and nets that the viewer is asked for, nets that are never asked for.
REFDES, NET, RAILS = r"^[A-Z][A-Z0-9_]*[0-9][A-Z0-9_]*$", r"^[A-Z][A-Z0-9_+]{1,15}$", ("GND", "VCC")
#: The largest area of a part, and of a net or of two parts together, of a page of 1000 x 1000.
PART_AREA, NET_AREA = 40_000, 250_000
#: Boxes of the greatest names that parts meet first, and parts of a page's other boxes.
NEAR, TILES = 32, 64
#: The system message of view lessons.
SYSTEM = ("Answer only from the attached schematic image. If a part, label or measurement is not shown, say so. Do not invent facts.\n\n"
          "You control the schematic viewer beside this conversation. When the user asks to see, find, show or zoom to something, call a viewer function first, then answer "
          "briefly from its result. Use show_label for a named part or net, show_region for an area you can see, and show_full_sheet to zoom out. If show_label returns "
          "not_found, say the label is not on this page; do not guess a location.")


def _corners(box: Column) -> list[Column]:
    return [F.get(box, i) for i in range(4)]


def viewable_nets(nets: DataFrame) -> DataFrame:
    """nets (net, pads, box) that can be asked for: named ones of two pads or more whose box is not too
    large; anonymous ones and supply rails can not."""
    sound = F.col("net").rlike(NET) & ~F.col("net").isin(*RAILS) & (F.size("pads") >= 2)
    return nets.where(sound & F.col("box").isNotNull() & (X.area(_corners(F.col("box"))) <= NET_AREA))


def targets(parts: DataFrame, nets: DataFrame, keys: list[str]) -> DataFrame:
    """What a page's lesson is about: keys, first, value, first_box, net, net_box, one, other, pair_box, missing.

    parts: keys, refdes, value, visible, box (null: none); nets: keys, net, pads, box. Parts must show their
    value and have a box that is neither empty nor too large; U and R come first, then by name. The net
    is that of fewest pads, then by name. The pair is the first one in the order of parts, of two that don't
    overlap and fit into one view, the lesser name first. The missing name is R999, or with as many more
    nines as it takes to be no part or net of the page. Pages with fewer than three such parts, no such net or no
    pair have no row.

    Parts are written once, and no page's parts meet in one task. Whether two parts make a pair depends on their boxes and
    on which name is greater, so of the parts of one box only the first may be the first of a pair, and the box's greatest
    name tells whether any other of them may be its fellow. First parts meet the boxes of the greatest names; those
    before the best one so found meet all boxes of their page, in TILES parts. A page on which no two boxes make a pair has as
    many comparisons as pairs of different boxes.
    """
    parts = settled(parts.select(*keys, "refdes", "value", "visible", "box").distinct())
    corners, rank = _corners(F.col("box")), ~F.col("refdes").rlike("^[UR]")
    fit = parts.where(F.col("visible") & F.col("refdes").rlike(REFDES) & F.col("box").isNotNull())
    fit = fit.where((X.area(corners) > 0) & (X.area(corners) <= PART_AREA)).select(*keys, rank.alias("rank"), "refdes", "value", "box")
    boxes = settled(fit.groupBy(*keys, "rank", "box").agg(F.min(F.struct("refdes", "value")).alias("low"), F.max("refdes").alias("high"), F.count("*").alias("n")))
    head = F.struct("rank", F.col("low.refdes").alias("refdes"), F.col("low.value").alias("value"), "box")
    listed = boxes.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(head).alias("top")).where("n >= 3").drop("n")

    def at(box, name):
        return [c.alias(f"{name}{i}") for i, c in enumerate(_corners(F.col(box)))]

    def apart(a, b):
        # No box is empty. Millions of pairs are compared, so the condition has plain columns only.
        x, y = [F.col(f"{a}{i}") for i in range(4)], [F.col(f"{b}{i}") for i in range(4)]
        aside = (x[2] <= y[0]) | (y[2] <= x[0]) | (x[3] <= y[1]) | (y[3] <= x[1])
        return aside & ((F.greatest(x[2], y[2]) - F.least(x[0], y[0])) * (F.greatest(x[3], y[3]) - F.least(x[1], y[1])) <= NET_AREA)

    heads = boxes.select(*keys, head.alias("a"), F.col("low.refdes").alias("one"), *at("box", "p"))
    ends = boxes.groupBy(*keys, "box").agg(F.max("high").alias("high")).select(*keys, "box", "high", *at("box", "q"))
    meets = (F.col("one") < F.col("high")) & apart("p", "q")
    near = first_of(ends, keys, [F.col("high").desc(), F.col("box")], NEAR)
    known = heads.join(near, keys).where(meets).groupBy(*keys).agg(F.min("a").alias("known"))
    rest = heads.join(known, keys, "left").where(F.col("known").isNull() | (F.col("a") < F.col("known"))).drop("known")
    tiled = rest.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(TILES - 1)))).join(
        ends.withColumn("tile", F.pmod(F.hash("box"), F.lit(TILES))), [*keys, "tile"]).where(meets).select(*keys, "a")
    first = settled(tiled.unionByName(known.select(*keys, F.col("known").alias("a"))).groupBy(*keys).agg(F.min("a").alias("a")))
    told = fit.select("*", *at("box", "q")).join(first.select(*keys, F.col("a.refdes").alias("one"), *at("a.box", "p")), keys)
    second = told.where((F.col("one") < F.col("refdes")) & apart("p", "q"))
    pairs = second.groupBy(*keys).agg(F.min(F.struct("rank", "refdes", "value", "box")).alias("b")).join(first, keys)
    union = F.array(*X.union_box(_corners(F.col("a.box")), _corners(F.col("b.box"))))
    best = viewable_nets(nets).groupBy(*keys).agg(F.min(F.struct(F.size("pads").alias("n"), "net", "box")).alias("best"))
    names = parts.select(*keys, F.col("refdes").alias("name")).unionAll(nets.select(*keys, F.col("net").alias("name")))
    nines = names.where(F.col("name").rlike("^R9{3,}$")).groupBy(*keys).agg(F.collect_set(F.length("name") - 1).alias("used"))
    free = F.array_min(F.array_except(F.sequence(F.lit(3), F.size("used") + 3), F.col("used")))
    missing = F.concat(F.lit("R"), F.repeat(F.lit("9"), F.coalesce(free, F.lit(3))))
    return listed.join(pairs, keys).join(best, keys).join(nines, keys, "left").select(
        *keys, F.col("top.refdes").alias("first"), F.col("top.value").alias("value"), F.col("top.box").alias("first_box"),
        F.col("best.net").alias("net"), F.col("best.box").alias("net_box"), F.col("a.refdes").alias("one"), F.col("b.refdes").alias("other"),
        union.alias("pair_box"), missing.alias("missing"))


#: Question, tool, its arguments and result as JSON, reply, type of the reply's label, the label it names.
TASKS = (
    ("Show me {first}.", "show_label", '{"label": "{first}"}', '{"status": "shown", "label": "{first}", "kind": "part", "box": {first_json}}',
     "Showing {first}, marked {value}.", "view_reply", "{first}"),
    ("Zoom to the {net} net.", "show_label", '{"label": "{net}"}', '{"status": "shown", "label": "{net}", "kind": "net", "box": {net_json}}',
     "Showing net {net}.", "view_reply", "{net}"),
    ("Frame {one} and {other} together in one view.", "show_region", '{"box": {pair_json}, "label": "{one} and {other}"}', '{"status": "shown", "box": {pair_json}}',
     "Showing {one} and {other} together.", "view_reply", "{other}"),
    ("Where is {missing}? Show it to me.", "show_label", '{"label": "{missing}"}', '{"status": "not_found", "label": "{missing}"}',
     "{missing} is not on this sheet, so there is nothing to show.", "view_refuse", None),
    ("Zoom back out to the whole sheet.", "show_full_sheet", "{}", '{"status": "shown", "view": "full_sheet"}', "Showing the full sheet.", "view_reply", None),
)
#: The overlap that a region must reach.
MIN_IOU = 0.5


def _filled(form: str) -> Column:
    """A form with {name} for columns; other braces stand for themselves."""
    names = ("first", "first_json", "value", "net", "net_json", "one", "other", "pair_json", "missing")
    out, rest = [], form
    while rest:
        at, name = min(((rest.find("{" + n + "}"), n) for n in names if "{" + n + "}" in rest), default=(-1, ""))
        if at < 0:
            out.append(F.lit(rest))
            break
        out += [F.lit(rest[:at]), F.col(name)]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*out)


def lessons(found: DataFrame, keys: list[str], image: Column) -> DataFrame:
    """keys, messages (plain, as a trainer reads them) and gold of one lesson for each row of targets():
    five tasks, each a call and a reply. image: the page's image, in front of the first question."""
    own = found.withColumns({f"{k}_json": wire.json_box(F.col(f"{k}_box")) for k in ("first", "net", "pair")})
    label = "struct<type:string,name:string,arguments:string,label:string,min_iou:double>"
    messages, gold = [wire.turn("system", F.lit(SYSTEM))], []
    for k, (question, tool, arguments, result, reply, kind, named) in enumerate(TASKS):
        key = F.lit(f"call-{k}")
        messages += [wire.turn("user", _filled(question), image=None if k else image), wire.turn("assistant", None, calls=wire.call(key, F.lit(tool), _filled(arguments))),
                     wire.turn("tool", _filled(result), answers=key), wire.turn("assistant", _filled(reply))]
        iou = F.lit(MIN_IOU if tool == "show_region" else None).cast("double")
        gold += [F.struct(F.lit("view").alias("type"), F.lit(tool).alias("name"), _filled(arguments).alias("arguments"), F.lit(None).cast("string").alias("label"), iou.alias("min_iou")).cast(label),
                 F.struct(F.lit(kind).alias("type"), F.lit(None).alias("name"), F.lit(None).alias("arguments"),
                          (_filled(named) if named else F.lit(None)).alias("label"), F.lit(None).alias("min_iou")).cast(label)]
    made = own.select(*keys, F.array(*messages).alias("_messages"), F.array(*gold).alias("gold"))
    return wire.plain(made, "_messages", wire.VIEWER).select(*keys, F.col("plain").alias("messages"), "gold", "fault")


def graded(answers: DataFrame) -> DataFrame:
    """answers (output, and of the label type, name, arguments (JSON), label, min_iou) with scores: an array
    of (metric, score), two for a region and one otherwise; none for labels of another type.

    view: the answer makes exactly one call, of the right function, and its label is the same but for letter case,
    or its box overlaps the expected one by min_iou (0.5 if null). view_reply: no call, some text, and the label in it as
    a word of its own. view_refuse: no call and a refusal. A malformed call counts as none and no reply.
    """
    form = "array<struct<arguments:struct<box:array<int>,label:string>,name:string>>"
    own = answers.withColumn("_said", X.final_answer(F.col("output"))).withColumn("_p", P.parsed_calls(F.col("_said")))
    own = own.withColumns({"_calls": F.from_json("_p.calls", form), "_want": F.from_json("arguments", "box array<int>, label string")})
    own = own.withColumn("_one", F.when(F.size("_calls") == 1, F.get("_calls", 0)))
    same = P.same_label(F.col("_one.arguments.label"), F.col("_want.label"))
    meets = X.iou(_corners(F.col("_one.arguments.box")), _corners(F.col("_want.box"))) >= F.coalesce("min_iou", F.lit(MIN_IOU))
    right = F.col("_one.name") == F.col("name")
    fits = F.when(F.col("name") == "show_label", same).when(F.col("name") == "show_region", meets).otherwise(F.lit(True))
    own = own.withColumn("_text", F.when((F.size("_calls") == 0) & (F.length("_p.content") > 0), F.col("_p.content")))
    text = F.col("_text")
    score = lambda name, c: F.struct(F.lit(name).alias("metric"), F.coalesce(c, F.lit(False)).cast("double").alias("score"))
    called = score("view.call_acc", right & fits)
    scores = F.when((F.col("type") == "view") & (F.col("name") == "show_region"), F.array(called, score("view.region_acc", right & meets))).when(
        F.col("type") == "view", F.array(called)).when(F.col("type") == "view_refuse", F.array(score("view.refuse_acc", X.refuses(text)))).when(
        F.col("type") == "view_reply", F.array(score("view.reply_acc", text.isNotNull() & (F.col("label").isNull() | X.names_label(text, F.col("label"))))))
    return own.withColumn("scores", scores).drop("_said", "_p", "_calls", "_want", "_one", "_text")
