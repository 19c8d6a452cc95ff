"""Column expressions with the semantics of the curation and grading rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and thresholds that graders must share to give the same scores.
REFUSE = r"(no|not|isn't|doesn't|don't|aren't)\b.{0,40}\b(on|in|shown|show|drawn|specified|marked|state|sheet|schematic)"
REFDES = r"[A-Z][A-Z0-9_$-]*"
PIN = r"(?<![\w$-])([A-Z][A-Z0-9_$-]*)\.([A-Z0-9_$+-]+)(?![\w$+-])"
FLOATING = r"isn't connected|not connected|floating|nothing"
ROLE_LINE = r"^[ \t]*(?:user|assistant|system)[ \t]*:?[ \t\r]*$"

#: Java reads patterns as Python's re does with these flags: Unicode classes and only \n ends a line.
PYTHON_RE = "(?diuU)"


#: Unicode's white space, and four separators that only Python's strip() takes, too.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = "\x1c\x1d\x1e\x1f"


def stripped(c: Column) -> Column:
    """Without white space at both ends, Unicode's included; trim() takes spaces only."""
    return F.btrim(c, F.lit(WHITE))


def python_stripped(c: Column) -> Column:
    """As Python's strip() has it."""
    return F.btrim(c, F.lit(WHITE + SEPARATORS))


def final_answer(c: Column) -> Column:
    """An answer without its reasoning: complete <think> blocks go, and all behind an open one."""
    closed = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<think>.*?</think>", "")
    return stripped(F.regexp_replace(closed, r"(?is)<think>.*", ""))


def quoted(c: Column) -> Column:
    """A regular expression for the literal text of c."""
    return F.regexp_replace(c, r"([\\\^\$\.\|\?\*\+\(\)\[\]\{\}-])", r"\\$1")


def states_value(answer: Column, value: Column) -> Column:
    """Whether the answer has the value as a token of its own, with any white space inside it."""
    literal = F.regexp_replace(quoted(stripped(value)), r"(?U)\s+", r"\\s*")
    return F.rlike(answer, F.concat(F.lit(PYTHON_RE + r"(?<![\w.+-])"), literal, F.lit(r"(?!\w|\.\d)")))


def refuses(answer: Column) -> Column:
    """The keyword rule for refusals."""
    return answer.rlike(PYTHON_RE + REFUSE)


def names_label(text: Column, label: Column) -> Column:
    return F.rlike(text, F.concat(F.lit(PYTHON_RE + r"(?<![\w$-])"), quoted(label), F.lit(r"(?![\w$-])")))


def spills_role(text: Column) -> Column:
    """Whether a line holds nothing but a speaker's role."""
    return text.rlike("(?dim)" + ROLE_LINE)


def pins(answer: Column) -> Column:
    """Sorted distinct PART.PAD tokens of an answer."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(answer, F.lit(PIN), F.lit(0))))


def pin_f1(predicted: Column, gold: Column, answer: Column, query: Column, net: Column) -> Column:
    """F1 of two pin sets. The pin asked about and the net's name are no predictions, the name only
    if it is no expected pin; where no pin is expected, saying so without naming one scores 1."""
    pred = F.array_except(predicted, F.array(query))
    pred = F.when(F.array_contains(gold, net), pred).otherwise(F.array_except(pred, F.array(net)))
    tp = F.size(F.array_intersect(pred, gold)).cast("double")
    some = F.when(tp == 0, 0.0).otherwise(2 * tp / (F.size(pred) + F.size(gold)))
    none = F.when((F.size(pred) == 0) & answer.rlike(PYTHON_RE + FLOATING), 1.0).otherwise(0.0)
    return F.when(F.size(gold) == 0, none).otherwise(some)


def passes(value: Column, count: Column, threshold: Column) -> Column:
    """A gate: evidence, a finite score within 0 and 1, and the threshold reached. NaN would pass
    a bare comparison."""
    sound = (F.coalesce(count, F.lit(0)) >= 1) & value.isNotNull() & ~F.isnan(value) & value.between(0.0, 1.0)
    return F.coalesce(sound & (value >= threshold), F.lit(False))


def family_split(family: Column) -> Column:
    """test, val or train from the first 32 bits of the family's SHA-256, two, one and seven tenths."""
    bucket = F.conv(F.substring(F.sha2(family, 256), 1, 8), 16, 10).cast("long") % 10
    return F.when(bucket < 2, "test").when(bucket == 2, "val").otherwise("train")


def seeded(seed: int, *parts: Column) -> Column:
    """A reproducible random key: SHA-256 of the seed and the parts, joined by colons."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_json(c: Column) -> Column:
    """Keys sorted, no blanks, non-ASCII as it is; null for what is no strict JSON. Numbers take
    their shortest form."""
    return F.to_json(F.try_parse_json(c))


# Boxes are four columns x1, y1, x2, y2.
def area(b: list[Column]) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0)) * F.greatest(b[3] - b[1], F.lit(0))


def union_box(a: list[Column], b: list[Column]) -> list[Column]:
    return [F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])]


def iou(a: list[Column], b: list[Column]) -> Column:
    both = area([F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])])
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def coincident(ax: Column, ay: Column, bx: Column, by: Column, angle: Column, along: float, across: float) -> Column:
    """Whether b lies within a slot around a that is turned by angle degrees."""
    t, dx, dy = F.radians(angle), bx - ax, by - ay
    return (F.abs(dx * F.cos(t) + dy * F.sin(t)) <= along) & (F.abs(dy * F.cos(t) - dx * F.sin(t)) <= across)
