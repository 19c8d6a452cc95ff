"""Judging rollouts: answers after tool calls, routing, the viewer's state from turn to turn, and cancellations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.expressions import PYTHON_RE

# Forms of a clause in an answer to a search without results, and marks of an invented dialogue.
ABSTAINS = (
    r"no (?:search )?(?:results|matches)(?:(?: were)? (?:returned|found|available))?",
    r"(?:the )?(?:search|lookup) (?:returned|found|yielded) (?:no|zero) (?:results|matches)",
    r"(?:i )?(?:cannot|can't|could not|couldn't|am unable to) (?:verify|confirm|determine|find|retrieve|infer) "
    r"(?:the |any |a )?(?:datasheet(?: specifications)?|specifications|ratings|limits)"
    r"(?: (?:from|with|without|using) (?:(?:the |these |any )?(?:search results|results|datasheet|source evidence)|an empty (?:search )?result))?",
)
REQUESTS = (
    r"(?:please )?(?:provide|share|upload|check|consult) (?:the |a |an )?(?:manufacturer's )?datasheet"
    r"(?: (?:to verify|to confirm|for) (?:the )?(?:specifications|ratings|limits))?",
)
MARKED = (" is marked ", " is labeled ", " is ")
INVENTED = ("<tool_call>", "<tool_response>", "<|im_start|>", "\nUser:", "\nHuman:")
ASKS, NAMES = r"\b(which|select|specify|provide)\b", ("part", "component", "reference", "designator")
DENIES = ("not", "cannot", "can't", "unavailable", "measurement", "measure")
NAVIGATION = ("show_label", "show_region", "show_full_sheet")
SHEET = (0, 0, 1000, 1000)


def folded(c: Column) -> Column:
    """Letter case taken away; upper() first, as it alone writes out letters such as the sharp s."""
    return F.lower(F.upper(c))


def _any(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def _whole(forms: tuple[str, ...]) -> str:
    return PYTHON_RE + r"\A(?:" + "|".join(forms) + r")\z"


def search_answer(content: Column, refdes: Column, value: Column) -> Column:
    """An answer given after a search found nothing, by its clauses: struct of acknowledged (some clause
    says that nothing was found), unknown (clauses that neither say so, nor ask for a datasheet, nor
    name the part as marked), passed. Null content has no clause."""
    clauses = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), r"[.!?;\n]+"), lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))),
                       lambda c: c != "")
    says = lambda c: c.rlike(_whole(ABSTAINS))
    names = F.array(folded(value), *(folded(F.concat(refdes, F.lit(m), value)) for m in MARKED))
    fits = lambda c: c.rlike(_whole(ABSTAINS + REQUESTS)) | F.coalesce(F.array_contains(names, folded(c)), F.lit(False))
    acknowledged, unknown = F.exists(clauses, says), F.size(F.filter(clauses, lambda c: ~fits(c))).cast("long")
    return F.struct(acknowledged.alias("acknowledged"), unknown.alias("unknown"), (acknowledged & (unknown == 0)).alias("passed"))


def clarifies(text: Column) -> Column:
    """Whether a text asks which part is meant."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.rlike(PYTHON_RE + ASKS) & _any(low, NAMES)


def final_fits(content: Column, value: Column, clarify: Column, refusal: Column) -> Column:
    """Whether a final answer is not blank, invents no dialogue, names the value (if not null), asks
    which part is meant (if clarify) and denies something (if refusal)."""
    said = F.coalesce(content, F.lit(""))
    asks = said.rlike(PYTHON_RE + ASKS) & said.rlike(PYTHON_RE + rf"\b({'|'.join(NAMES)})\b")
    valued = F.coalesce(value == "", F.lit(True)) | F.contains(folded(said), folded(F.coalesce(value, F.lit(""))))
    off = lambda flag: ~F.coalesce(flag, F.lit(False))
    return said.rlike(r"(?U)\S") & ~_any(said, INVENTED) & valued & (off(clarify) | asks) & (off(refusal) | _any(F.lower(said), DENIES))


def routed(answers: DataFrame) -> DataFrame:
    """answers (content, n_calls, function, arguments as JSON, tool, refdes, part) with correct: no call
    and a question for the part where no tool is expected; else one call of the tool, whose arguments
    are the part's label and nothing else, or for web_search a query alone that has the part's name.
    A repeated key counts as another argument."""
    args = F.col("arguments")
    only = lambda key: F.json_object_keys(args) == F.array(F.lit(key))
    query = only("query") & F.contains(folded(F.get_json_object(args, "$.query")), folded(F.col("part")))
    label = only("label") & (F.get_json_object(args, "$.label") == F.col("refdes"))
    called = (F.coalesce("n_calls", F.lit(0)) == 1) & (F.col("function") == F.col("tool")) & F.when(F.col("tool") == "web_search", query).otherwise(label)
    none = (F.coalesce("n_calls", F.lit(0)) == 0) & clarifies(F.col("content"))
    return answers.withColumn("correct", F.coalesce(F.when(F.col("tool").isNull(), none).otherwise(called), F.lit(False)))


def counted(scored: DataFrame, key: str) -> DataFrame:
    """correct and total by key."""
    return scored.groupBy(key).agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))


def viewed(turns: DataFrame, case: str, turn: str) -> DataFrame:
    """The viewer's state through the turns of each case, which starts on the whole sheet without focus.

    turns: case, turn, error (the turn broke off), clears (focus goes at its start), events: its tool
    results in order, of tool, status, box, label. A label that is shown moves the view to its box and
    focuses it; a region or the whole sheet moves the view and takes the focus away. Turns behind a
    broken one are blocked and change nothing. Adds blocked, before and after (boxes), focus (after),
    still (neither moved nor tried to; false in turns that broke off or were blocked).
    """
    order = Window.partitionBy(case).orderBy(turn)
    earlier, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    failed = F.coalesce("error", F.lit(False))
    blocked = F.coalesce(F.max(failed).over(earlier), F.lit(False))
    moves = F.filter(F.coalesce("events", F.expr("array()")), lambda e: ((e["tool"] == "show_label") & (e["status"] == "shown")) | e["tool"].isin(*NAVIGATION[1:]))
    whole = F.array(*map(F.lit, SHEET))
    ran = turns.withColumn("blocked", blocked).withColumn("_move", F.when(~F.col("blocked") & (F.size(moves) > 0), F.element_at(moves, -1)))
    box = F.when(F.col("_move.tool") == "show_full_sheet", whole).otherwise(F.col("_move.box"))
    focus = F.when(F.col("_move").isNotNull(), F.struct(F.when(F.col("_move.tool") == "show_label", F.col("_move.label")).alias("label"))).when(
        ~F.col("blocked") & F.coalesce("clears", F.lit(False)), F.struct(F.lit(None).cast("string").alias("label")))
    put = ran.withColumns({"_box": box, "_focus": focus})
    state = put.withColumns({
        "before": F.coalesce(F.last("_box", ignorenulls=True).over(earlier), whole), "after": F.coalesce(F.last("_box", ignorenulls=True).over(upto), whole),
        "focus": F.last("_focus", ignorenulls=True).over(upto)["label"]})
    tried = F.exists(F.coalesce("events", F.expr("array()")), lambda e: e["tool"].isin(*NAVIGATION))
    still = ~F.col("blocked") & ~failed & (F.col("before") == F.col("after")) & ~tried
    return state.withColumn("still", still).drop("_move", "_box", "_focus")


def reported(states: DataFrame) -> DataFrame:
    """Totals over viewed() turns that also have passed, allowed (whether the view may move): one row."""
    held = ~F.col("allowed")
    calls = F.when(F.col("blocked"), 0).otherwise(F.size(F.filter(F.coalesce("events", F.expr("array()")), lambda e: e["tool"].isin(*NAVIGATION))))
    return states.agg(
        F.count("*").alias("n_turns"), F.count_if("passed").alias("n_passed"), F.count_if(~F.col("blocked") & ~F.coalesce("error", F.lit(False))).alias("n_ended"),
        F.count_if(held).alias("n_held"), F.count_if(held & F.col("still")).alias("n_still"),
        F.coalesce(F.sum(F.when(held, calls)), F.lit(0)).cast("long").alias("n_unasked"))


def cancelled(events: DataFrame, key: str, at: str, tie: str, seconds: int) -> DataFrame:
    """The start events of each key with cancelled: whether a cancel event came while it was active, or
    before it, not more than seconds ago and with no other start or finish between.

    events: key, at, tie, kind (start, cancel, finish). An active start ends at the key's next finish or start.
    """
    order = Window.partitionBy(key).orderBy(at, tie)
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    place = F.row_number().over(order)
    e = events.withColumn("_n", place)
    ends = F.when(F.col("kind") != "cancel", F.col("_n"))
    stop = F.when(F.col("kind") == "cancel", F.struct("_n", F.col(at).alias("at")))
    e = e.withColumns({"_end": F.max(ends).over(earlier), "_stop": F.max(stop).over(earlier), "_next_end": F.min(ends).over(later), "_next_stop": F.min(stop).over(later)})
    pending = (F.col("_stop._n") > F.coalesce("_end", F.lit(0))) & (F.col(at) < F.col("_stop.at") + F.expr(f"INTERVAL {seconds} SECONDS"))
    active = F.col("_next_stop._n") < F.coalesce("_next_end", F.lit(1 << 30))
    verdict = F.coalesce(pending, F.lit(False)) | F.coalesce(active, F.lit(False))
    return e.where("kind = 'start'").withColumn("cancelled", verdict).drop("_n", "_end", "_stop", "_next_end", "_next_stop")
