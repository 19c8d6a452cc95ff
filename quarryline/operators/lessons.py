"""Questions and answers made from schematic facts: targets of a sheet, and turns, lessons and scenarios on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import first_of

#: Forms of part names and of pads that questions may be about.
REFDES, PAD = r"^[A-Z][A-Z0-9_$-]*$", r"^[A-Z][A-Z0-9_$-]*\.[A-Z0-9_$+-]+$"


def _nines() -> Column:
    """How many nines a name has that is R and four nines or more; null for others."""
    return F.when(F.col("refdes").rlike("^R9{4,}$"), F.length("refdes") - 1)


def _absent(used: Column) -> Column:
    """R9999, or with more nines where used has that number of nines."""
    return F.concat(F.lit("R"), F.repeat(F.lit("9"), F.array_min(F.array_except(F.sequence(F.lit(4), F.size(used) + 4), used))))


def absent_name(bom: DataFrame, keys: list[str]) -> DataFrame:
    """keys, missing: R9999, or with as many more nines as it takes to be no part of the sheet."""
    # Few rows are left of a sheet before sets are made, which are sorted where there are many sheets.
    nines = bom.select(*keys, _nines().alias("n")).distinct()
    return nines.groupBy(*keys).agg(F.collect_set("n").alias("used")).select(*keys, _absent(F.col("used")).alias("missing"))


def targets(bom: DataFrame, nets: DataFrame, keys: list[str], visible_only: bool = False) -> DataFrame:
    """What a sheet's questions are about: keys, two parts (first, first_value, second, second_value),
    one net with its sorted pads, and a missing part.

    bom: keys, refdes, value, visible; nets: keys, net, pads. Parts need a value (a visible one with
    visible_only); resistors come first, then by name. Nets have two to eight well-formed pads; named
    ones come first, then those of fewest pads, then by name. Sheets with one such part or no such
    net have no row.
    """
    fit = F.coalesce(F.col("value") != "", F.lit(False)) & F.col("refdes").rlike(REFDES)
    fit = fit & F.col("visible") if visible_only else fit
    # Parts to ask about (0) and names of nines (their number), so that one pass over bom finds both; two of each are enough.
    kinds = F.array_compact(F.array(F.when(fit, F.lit(0)), _nines()))
    few = first_of(bom.select(*keys, "refdes", "value", F.explode(kinds).alias("kind")).distinct(), [*keys, "kind"], [~F.col("refdes").startswith("R"), F.col("refdes")], 2)
    own = F.struct((~F.col("refdes").startswith("R")).alias("rank"), "refdes", "value")
    sheets = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("kind") == 0, own))).alias("x"), F.collect_set(F.nullif("kind", F.lit(0))).alias("used"))
    two = sheets.where("size(x) = 2").select(
        *keys, *(F.col("x")[i][c].alias(n) for i, c, n in ((0, "refdes", "first"), (0, "value", "first_value"), (1, "refdes", "second"), (1, "value", "second_value"))),
        _absent(F.col("used")).alias("missing"))
    sound = nets.where(F.size("pads").between(2, 8) & F.forall("pads", lambda p: p.rlike(PAD)))
    net = first_of(sound, keys, [F.col("net").startswith("N$"), F.size("pads"), F.col("net")]).select(*keys, "net", "pads")
    return two.join(net, keys)


def _text(form: str) -> Column:
    """A form with column names in braces, as a string expression."""
    parts = []
    for piece in form.split("{"):
        name, brace, rest = piece.partition("}")
        parts += [F.col(name), F.lit(rest)] if brace else [F.lit(piece)]
    return F.concat(*parts)


#: Question, answer, and the kind of label of each turn; others is the net's pads but the first.
EVIDENCE = (
    ("What value is recorded for {first}?", "{first} has value {first_value} in the source schematic.", "value"),
    ("Which physical component pads connect to net {net} on this sheet?", "On this sheet, {net} connects {all_pads}.", "pins"),
    ("Trace {query}: which other physical pads share its net on this sheet?", "{query} is on {net}, together with {others}.", "trace"),
    ("What is the specified value of {second}?", "{second} has value {second_value} in the source schematic.", "value"),
    ("What value is {missing}, and what does it connect to?",
     "There is no {missing} in the supplied sheet evidence. Its value and connections are not shown.", "refuse"),
    ("What measured voltage was observed at {query} during a powered bench test?",
     "No bench measurement is supplied in this schematic or source evidence. I cannot infer a measured voltage.", "refuse"),
)
#: The turns where only the image is given; the first two are worded for it.
IMAGE = (
    ("Read the value shown next to {first}.", "{first} is marked {first_value}.", "value"),
    ("And what value is marked for {second}?", "{second} is marked {second_value}.", "value"),
    EVIDENCE[4], EVIDENCE[5],
)


def turns(chosen: DataFrame, keys: list[str], image_only: bool = False) -> DataFrame:
    """The turns of one conversation for each row of targets(): keys, turn (from 0), question, answer,
    type (value, pins, refuse), value, pins, query, net of the label."""
    named = chosen.withColumns({"query": F.col("pads")[0], "all_pads": F.array_join("pads", ", "), "others": F.array_join(F.slice("pads", 2, 7), ", ")})
    none = F.lit(None)

    def label(turn: int, question: str, answer: str, kind: str) -> Column:
        value = F.col("first_value" if "{first}" in question else "second_value") if kind == "value" else none.cast("string")
        pins = {"pins": F.col("pads"), "trace": F.slice("pads", 2, 7)}.get(kind, none.cast("array<string>"))
        return F.struct(
            F.lit(turn).alias("turn"), _text(question).alias("question"), _text(answer).alias("answer"),
            F.lit("pins" if kind == "trace" else kind).alias("type"), value.alias("value"), pins.alias("pins"),
            (F.col("query") if kind == "trace" else none.cast("string")).alias("query"),
            (F.col("net") if kind in ("pins", "trace") else none.cast("string")).alias("net"))

    cells = F.array(*(label(i, *t) for i, t in enumerate(IMAGE if image_only else EVIDENCE)))
    return named.select(*keys, F.inline(cells))


def circuits(parts: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Integrated circuits that lessons may name: parts (keys, refdes, value) called U... or IC..., with
    a letter and a digit in the value, that have a region (keys, refdes)."""
    named = parts.where(F.col("refdes").rlike("^(U|IC)") & F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]"))
    return named.join(regions.select(*keys, "refdes").distinct(), [*keys, "refdes"], "left_semi")


#: Kind, wording for training, wording for validation, tool, its argument.
LESSONS = (
    ("search", "Search the web for the datasheet for {refdes}.", "Find the manufacturer's datasheet online for {refdes}.", "web_search", "{value} datasheet"),
    ("followup", "Search online for that selected part's datasheet.", "do a web search for that part", "web_search", "{value} datasheet"),
    ("show", "Show me {refdes}.", "Take me to {refdes} on the drawing.", "show_label", "{refdes}"),
    ("clarify", "Search for that part online.", "Look that component up on the web.", None, None),
)


def lessons(candidates: DataFrame) -> DataFrame:
    """Four routing lessons for each candidate (id, page, refdes, value, split): id, split, kind, focused
    (whether the part is selected), question, tool, argument. Validation has wording of its own."""
    def one(kind, train, val, tool, argument):
        return F.struct(F.lit(kind).alias("kind"), F.when(F.col("split") == "val", _text(val)).otherwise(_text(train)).alias("question"),
                        F.lit(tool).cast("string").alias("tool"), (_text(argument) if argument else F.lit(None).cast("string")).alias("argument"))

    made = candidates.select("*", F.inline(F.array(*(one(*x) for x in LESSONS))))
    name = F.concat(F.col("id").cast("string"), F.lit("-p"), F.col("page").cast("string"), F.lit("-"), "refdes", F.lit("-"), "kind")
    return made.select(name.alias("id"), "split", "kind", (F.col("kind") != "clarify").alias("focused"), "question", "tool", "argument")


#: Turns of scenarios; wording for training and validation, tool, argument, answer, whether
#: the view may move, whether the selection is cleared before.
STEPS = {
    "show": ("Show me {refdes}.", "Center the view on {refdes}.", "show_label", "{refdes}", "Showing {refdes}.", True, False),
    "value": ("What value is marked for {refdes}?", "What is the marking for {refdes}?", None, None, "{refdes} is marked {value}.", False, False),
    "again": ("Remind me what {refdes} is marked.", "Remind me what {refdes} is marked.", None, None, "{refdes} is marked {value}.", False, False),
    "review": ("What voltage was measured at {refdes} during startup?", "Does this drawing establish the measured startup voltage at {refdes}?", None, None,
               "The schematic does not provide measured startup voltage. A bench measurement is required.", False, False),
    "search": ("Search online for that part datasheet.", "Do a web search for that part.", "web_search", "{value} datasheet",
               "The search returned no results. I cannot infer datasheet specifications from an empty result.", False, False),
}
STEPS["cleared"] = (*STEPS["search"][:6], True)
STEPS["explicit"] = ("Search the public datasheet for {value}.", "Search the public datasheet for {value}.", *STEPS["search"][2:])
#: The steps of each scenario.
SCENARIOS = {"discussion": ("show", "value", "review", "again"), "search": ("show", "search", "value", "review"),
             "stale_focus": ("show", "cleared", "explicit", "value")}


def scenarios(candidates: DataFrame) -> DataFrame:
    """Three scenarios of four turns for each candidate (id, refdes, value, split): id, kind, split, turn
    (from 0), step, question, tool, argument, answer, may_move, clears."""
    def one(kind, turn, step):
        train, val, tool, argument, answer, may_move, clears = STEPS[step]
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(turn).alias("turn"), F.lit(step).alias("step"),
            F.when(F.col("split") == "val", _text(val)).otherwise(_text(train)).alias("question"), F.lit(tool).cast("string").alias("tool"),
            (_text(argument) if argument else F.lit(None).cast("string")).alias("argument"), _text(answer).alias("answer"),
            F.lit(may_move).alias("may_move"), F.lit(clears).alias("clears"))

    made = candidates.select("id", "refdes", "value", "split", F.inline(F.array(*(one(k, i, s) for k, steps in SCENARIOS.items() for i, s in enumerate(steps)))))
    return made.select(F.concat(F.col("id").cast("string"), F.lit("-"), "kind").alias("id"), "kind", "split", "turn", "step", "question", "tool",
                       "argument", "answer", "may_move", "clears")


def tool_prefixes(made: DataFrame) -> DataFrame:
    """Training rows of scenarios(): the turns up to each one that calls a tool, and the whole of each
    scenario: id, row, n_turns, history (questions and answers, the last answer only of whole ones)."""
    own = F.struct("turn", "question", "answer", "tool")
    whole = made.groupBy("id").agg(F.array_sort(F.collect_list(own)).alias("t"))
    ends = F.filter(F.sequence(F.lit(1), F.size("t")), lambda n: F.get(F.col("t"), n - 1)["tool"].isNotNull())
    rows = whole.select("id", "t", F.explode(F.concat(ends, F.array(F.lit(0)))).alias("n"))
    size = F.when(F.col("n") > 0, F.col("n")).otherwise(F.size("t"))
    said = F.transform(F.slice("t", 1, size), lambda x: F.concat_ws("\n", x["question"], F.when((F.col("n") == 0) | (x["turn"] < F.col("n") - 1), x["answer"])))
    name = F.when(F.col("n") == 0, F.col("id")).otherwise(F.concat("id", F.lit("-tool-"), F.col("n").cast("string")))
    return rows.select("id", name.alias("row"), size.cast("long").alias("n_turns"), F.array_join(said, "\n").alias("history"))


#: Turns of a change from one page to the next: question, tool, answer, whether the view may move, whether it is a refusal,
#: and the page that it is about.
PAGE_CHANGE = (
    ("Show me {first}.", "show_label", "Showing {first}.", True, False, "one"),
    ("I changed to page {two}. Read the value of {second} here without moving the view.", None, "{second} is marked {second_value}.", False, False, "two"),
    ("Discuss only: what startup voltage was measured at {second} on this page?", None,
     "The schematic does not provide measured startup voltage. A bench measurement is required.", False, True, "two"),
    ("Now explicitly show {second} on this page.", "show_label", "Showing {second}.", True, False, "two"),
)


def page_changes(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Four turns for each source of two pages or more: keys, turn (from 0), page, question, tool, argument, answer,
    expected (the value asked for, or null), may_move, refusal.

    parts: keys, page, refdes, value, region (whether the page shows where it is). On each of the two first pages
    the first part by name counts that is a U, IC, R or C with a value and a region; a source without one on both has
    no row."""
    fit = parts.where(F.col("refdes").rlike("^(U|IC|R|C)") & (F.coalesce(F.col("value"), F.lit("")) != "") & F.col("region"))
    pages = parts.groupBy(*keys).agg(F.min("page").alias("one"))
    after = parts.join(pages, keys).where("page > one").groupBy(*keys, "one").agg(F.min("page").alias("two"))
    target = fit.groupBy(*keys, "page").agg(F.min(F.struct("refdes", "value")).alias("t"))
    at = lambda p, name: target.select(*keys, F.col("page").alias(p), F.col("t.refdes").alias(name), F.col("t.value").alias(f"{name}_value"))
    both = after.join(at("one", "first"), [*keys, "one"]).join(at("two", "second"), [*keys, "two"])
    both = both.withColumns({"_one": F.col("one"), "_two": F.col("two"), "two": F.col("two").cast("string")})

    def turn(k, question, tool, answer, may_move, refusal, page):
        name = "first" if page == "one" else "second"
        asked = F.when(F.lit(tool is None and not refusal), F.col(f"{name}_value"))
        return F.struct(
            F.lit(k).alias("turn"), F.col(f"_{page}").alias("page"), _text(question).alias("question"), F.lit(tool).cast("string").alias("tool"),
            F.when(F.lit(tool is not None), F.col(name)).alias("argument"), _text(answer).alias("answer"), asked.alias("expected"), F.lit(may_move).alias("may_move"), F.lit(refusal).alias("refusal"))

    return both.select(*keys, F.inline(F.array(*(turn(k, *t) for k, t in enumerate(PAGE_CHANGE)))))
