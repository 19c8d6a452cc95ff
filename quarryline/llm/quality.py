"""Quality rules with robust multivariate outliers.

Four statistics of a text's shape are transformed so that their spread does not depend on their
level: mean word length (logarithm), and the shares of symbols, repeated lines and repeated words
(arcsine of the square root). For each language and source the minimum covariance determinant
estimate gives their centre and covariance, untouched by up to half of the rows. A document is
rejected if its squared Mahalanobis distance exceeds a chi-square quantile.

A group's estimate is drawn towards that of its language, and a language's towards that of all
rows, by PRIOR_ROWS pseudo-rows: few rows hardly move it, many outweigh them, and the same
arithmetic holds for a group of any size, of none even.

The estimate starts from two fixed subsets (nearest to the medians, and nearest to the centre of
all) and takes concentration steps until no determinant falls any more. All rows count: a step sums
products for each narrow band of distance, so the nearest half is a run of whole bands and of the
part of the last band that is missing, and a group of any size is summed before the shuffle.
Values are whole thousandths and sums are whole numbers, so the order of rows does not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, discard, rows, spare

DIMS = ("word_length", "symbols", "lines", "repeats")
#: Least standard deviation of each statistic, as it counts in every group's covariance: most
#: documents have no symbol and no repeated line, and their spread alone would reject the first one.
LEAST_SD = (0.10, 0.05, 0.15, 0.15)
#: Pseudo-words of five characters added to each document, so that short ones do not stray by chance.
PSEUDO_WORDS = 20
#: Bands of distance for each doubling of 1/16 + squared distance.
BANDS = 64
#: A logarithm of a determinant that falls by less has settled; a guard against a loop without end.
SETTLED, MOST_STEPS = 1e-3, 500
#: Pseudo-rows by which the wider estimate counts in the narrower one.
PRIOR_ROWS = 20
#: Values for the medians from which an estimate starts are told apart to so many thousandths.
START_STEP = 10
#: Quantiles of the chi-square distribution with four degrees of freedom, at 0.975
#: (rows that count in the reweighted estimate) and 0.9999 (rows that stay).
CHI2_975, CHI2_9999 = 11.1433, 23.5127
#: Fixed value: the median of that distribution, to which the nearest half is scaled.
CHI2_MEDIAN = 3.3567
SCALE = 1000
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


def repeated(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of width words that the text has twice or more."""
    n = len(words)
    if n <= width:
        return 0
    last = {w: i for i, w in enumerate(words)}
    if len(last) == n:
        return 0
    word = rank = np.fromiter(map(last.__getitem__, words), np.int64, n)
    for k in range(1, width):  # the rank of k + 1 words from that of the first k and the last word
        found, rank = np.unique(rank[: n - k] * n + word[k:], return_inverse=True)
        if len(found) == n - k:
            return 0
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + width] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measured(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the lines with a word."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    spaces = len(raw) - len(raw.translate(None, SPACES))
    return (len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated(words), len(lines))


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def named(c: str) -> Column:
    """A name that is never null: that of null, which is a group of its own, or the name behind "="."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source (as named() has them) and STATS for each row of documents."""
    def each(batches):
        for d in rows(batches):
            found = list(zip(*map(measured, d["text"]), strict=True)) or [()] * len(STATS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d["doc_id"], pa.int64()), pa.array(d["lang"], pa.string()), pa.array(d["source"], pa.string()),
                 *(pa.array(c, pa.int64()) for c in found)], ["doc_id", "lang", "source", *STATS])

    names = [named(c).alias(c) for c in ("lang", "source")]
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *names, F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(each, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in STATS))


def base_failed(stat=F.col) -> Column:
    return (stat("n_words") < 10) | (100 * stat("n_repeat_words") > 20 * stat("n_words"))


def _vector(stat=F.col) -> list[Column]:
    """The transformed statistics in whole thousandths."""
    def share(part: str, whole: Column) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), stat(part) / F.greatest(whole, F.lit(1)))))

    values = (F.log((stat("word_chars") + 5 * PSEUDO_WORDS) / (stat("n_words") + PSEUDO_WORDS)),
              share("n_symbols", stat("word_chars")), share("n_dup_lines", stat("n_lines")),
              share("n_repeat_words", stat("n_words")))
    return [F.round(v * SCALE).cast("long").alias(d) for v, d in zip(values, DIMS, strict=True)]


D = range(len(DIMS))
PAIRS = [(i, j) for i in D for j in range(i + 1)]
SUMS = [f"s{i}" for i in D] + [f"p{i}{j}" for i, j in PAIRS]
#: A centre, and the lower half of a covariance.
MOMENTS = [f"m{i}" for i in D] + [f"c{i}{j}" for i, j in PAIRS]
#: A centre, and the lower triangular matrix that makes a covariance the identity.
PARAMS = [f"m{i}" for i in D] + [f"w{i}{j}" for i, j in PAIRS]
GROUP = ["lang", "source"]
#: Parts into which the rows of a group are dealt for joins with its parameters, so that sums are taken
#: in many tasks before the shuffle even where Spark doesn't broadcast the parameters.
SALTS = 64


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *(F.expr(f"sum({d}) as s{i}") for i, d in enumerate(DIMS)),
            *(F.expr(f"sum({DIMS[i]} * {DIMS[j]}) as p{i}{j}") for i, j in PAIRS)]


def _moments() -> list[Column]:
    """MOMENTS from n and SUMS; the covariance holds LEAST_SD."""
    out = [f"s{i} / n / {SCALE} as m{i}" for i in D]
    for i, j in PAIRS:
        least = LEAST_SD[i] ** 2 if i == j else 0
        out.append(f"p{i}{j} / n / {SCALE**2} - s{i} / n / {SCALE} * (s{j} / n / {SCALE}) + {least}D as c{i}{j}")
    return list(map(F.expr, out))


def _cholesky() -> list[str]:
    """SQL of the lower triangular root of the covariance, of its inverse, and of the determinant;
    later expressions use the names of earlier ones."""
    out = []
    for j in D:
        for i in range(j, len(DIMS)):
            rest = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            out.append(f"sqrt(c{j}{j}{rest}) as l{j}{j}" if i == j else f"(c{i}{j}{rest}) / l{j}{j} as l{i}{j}")
    out += [f"1 / l{j}{j} as w{j}{j}" for j in D]
    for gap in range(1, len(DIMS)):
        for j in range(len(DIMS) - gap):
            i = j + gap
            out.append("-(" + " + ".join(f"l{i}{k} * w{k}{j}" for k in range(j, i)) + f") / l{i}{i} as w{i}{j}")
    return [*out, "2 * (" + " + ".join(f"ln(l{i}{i})" for i in D) + ") as logdet"]


CHOLESKY = _cholesky()


def _whitened(moments: DataFrame) -> DataFrame:
    """moments with PARAMS and the logarithm of the determinant."""
    return moments.selectExpr("*", *CHOLESKY).drop(*(f"l{i}{j}" for i, j in PAIRS))


def _distance(value: str = "{}", param: str = "{}") -> Column:
    """Squared Mahalanobis distance of DIMS to PARAMS, in columns of these forms."""
    gap = [f"({value.format(x)} / {SCALE} - {param.format(f'm{i}')})" for i, x in enumerate(DIMS)]
    turned = [" + ".join(f"{param.format(f'w{i}{j}')} * {gap[j]}" for j in range(i + 1)) for i in D]
    return F.expr(" + ".join(f"power({t}, 2)" for t in turned))


def _beside(x: DataFrame, params: DataFrame) -> DataFrame:
    """Rows of x (GROUP, salt, DIMS) joined with the params of their group, which are few beside the
    rows and are repeated for each salt."""
    salted = params.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return x.join(salted, [*GROUP, "salt"])


def _band() -> Column:
    return F.floor(BANDS * F.log2(F.lit(1 / 16) + F.col("d2"))).cast("int")


def _medians(x: DataFrame) -> DataFrame:
    """PARAMS around the medians of each group, with the least spread. They come from counts of
    values to START_STEP thousandths, of which there are a few hundred at most in each dimension."""
    long = x.select(*GROUP, F.explode(F.array(*(
        F.struct(F.lit(i).alias("dim"), F.floor(F.col(d) / START_STEP).alias("value")) for i, d in enumerate(DIMS)))).alias("v"))
    counts = long.groupBy(*GROUP, "v.dim", "v.value").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*GROUP, "dim")
    below = counts.withColumns({"upto": F.sum("n").over(w.orderBy("value")), "all": F.sum("n").over(w)})
    middle = below.where(2 * F.col("upto") >= F.col("all")).groupBy(*GROUP, "dim").agg(F.min("value").alias("value"))
    return middle.groupBy(*GROUP).agg(
        *((F.max(F.when(F.col("dim") == i, F.col("value"))) * START_STEP / SCALE).alias(f"m{i}") for i in D),
        *(F.max(F.lit(1 / LEAST_SD[i] if i == j else 0.0)).alias(f"w{i}{j}") for i, j in PAIRS))


def _concentrated(x: DataFrame, state: DataFrame) -> DataFrame:
    """One concentration step from the PARAMS of each group and start: MOMENTS, PARAMS and logdet of
    the nearest half, and before, the logdet that it had."""
    near = _beside(x, state.select(*GROUP, "start", *PARAMS)).withColumn("d2", _distance())
    bands = near.withColumn("band", _band()).groupBy(*GROUP, "start", "band").agg(*_sums())
    w = Window.partitionBy(*GROUP, "start")
    rows_of = F.sum("n").over(w)
    bands = bands.withColumns({"upto": F.sum("n").over(w.orderBy("band")),
                               "half": F.least(rows_of, F.floor((rows_of + len(DIMS) + 1) / 2))})
    taken = bands.where("upto - n < half").groupBy(*GROUP, "start").agg(F.max("half").alias("n"), *(F.expr(
        f"coalesce(sum(if(upto <= half, {c}, null)), 0) + coalesce(max(if(upto > half, {c} * ((half - upto + n) / n), null)), 0) as {c}") for c in SUMS))
    new = _whitened(taken.select(*GROUP, "start", *_moments()))
    return new.join(state.select(*GROUP, "start", F.col("logdet").alias("before")), [*GROUP, "start"])


def raw_estimates(x: DataFrame) -> DataFrame:
    """The minimum covariance determinant estimate of each group of x (GROUP, salt, DIMS): GROUP,
    MOMENTS, PARAMS, logdet."""
    centre = _whitened(x.groupBy(*GROUP).agg(*_sums()).select(*GROUP, *_moments()))
    state = cut(_medians(x).withColumn("start", F.lit(0)).unionByName(centre.select(*GROUP, *PARAMS, F.lit(1).alias("start"))).withColumn(
        "logdet", F.lit(float("inf"))))
    done = []
    for _ in range(MOST_STEPS):
        new = cut(_concentrated(x, state))
        if not done:
            discard(state)
        done.append(new.where(F.col("before") - F.col("logdet") <= SETTLED))
        state = new.where(F.col("before") - F.col("logdet") > SETTLED)
        if state.isEmpty():
            break
    else:
        raise RuntimeError(f"estimates did not settle in {MOST_STEPS} steps")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    best = Window.partitionBy(*GROUP).orderBy("logdet", "start")
    return found.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place", "start", "before")


def robust_moments(x: DataFrame) -> DataFrame:
    """The reweighted estimate of each group of x: GROUP, n (rows of the group) and MOMENTS."""
    raw = cut(raw_estimates(x).select(*GROUP, *PARAMS))
    # The nearest half of normal data is too narrow: scale so that its widest row lies at the median.
    bands = _beside(x, raw).withColumn("d2", _distance()).withColumn("band", _band()).groupBy(*GROUP, "band").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*GROUP)
    upto = bands.withColumns({"upto": F.sum("n").over(w.orderBy("band")), "all": F.sum("n").over(w)})
    middle = upto.where(2 * F.col("upto") >= F.col("all")).groupBy(*GROUP).agg(F.min("band").alias("band"), F.max("all").alias("rows"))
    factor = F.greatest(F.lit(1.0), (F.pow(F.lit(2.0), (F.col("band") + 1) / BANDS) - 1 / 16) / CHI2_MEDIAN)
    scaled = cut(raw.join(middle, GROUP).select(*GROUP, "rows", *PARAMS, factor.alias("factor")))
    kept = _beside(x, scaled).where(_distance() <= CHI2_975 * F.col("factor"))
    return cut(kept.groupBy(*GROUP).agg(*_sums(), F.max("rows").alias("rows")).select(*GROUP, F.col("rows").alias("n"), *_moments()))


def _drawn(groups: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """groups, whose MOMENTS are those of the wider group, with MOMENTS drawn from there to the own
    estimate as far as its rows outweigh PRIOR_ROWS."""
    mine = own.select(*keys, F.col("n").alias("own_n"), *(F.col(c).alias(f"own_{c}") for c in MOMENTS))
    n = F.coalesce(F.col("own_n"), F.lit(0))
    weight = n / (n + PRIOR_ROWS)
    return groups.join(mine, keys, "left").select(*GROUP, *(
        (weight * F.coalesce(f"own_{c}", F.lit(0.0)) + (1 - weight) * F.col(c)).alias(c) for c in MOMENTS))


def parameters(measured_rows: DataFrame) -> DataFrame | None:
    """PARAMS for each lang and source of measured_rows (doc_id, lang, source, STATS, DIMS), from the rows that
    pass the base rules; None if no row does."""
    key = lambda c: F.concat(F.lit("="), F.col(c))
    level = lambda a, b: F.struct(a.alias("lang"), b.alias("source"))
    none = F.lit("")
    good = measured_rows.where(~base_failed()).select(F.explode(F.array(
        level(key("lang"), key("source")), level(key("lang"), none), level(none, none))).alias("g"), F.pmod(F.xxhash64("doc_id", *DIMS), F.lit(SALTS)).alias("salt"), *DIMS)
    found = robust_moments(good.select("g.lang", "g.source", "salt", *DIMS))
    top = found.where("lang = '' and source = ''").first()
    if top is None:
        return None
    groups = measured_rows.select(key("lang").alias("lang"), key("source").alias("source")).distinct()
    groups = groups.withColumns({c: F.lit(top[c]) for c in MOMENTS})
    groups = _drawn(groups, found.where("lang <> '' and source = ''"), ["lang"])
    groups = _drawn(groups, found.where("source <> ''"), GROUP)
    return cut(_whitened(groups).select(*(F.substring(c, 2, 1 << 30).alias(c) for c in GROUP), *PARAMS))


def quality(documents: DataFrame, cutoff: float = CHI2_9999) -> DataFrame:
    """For each row of documents (doc_id, text, lang, source): doc_id, the five base statistics,
    base_failed (fewer than 10 words, or over a fifth of them repeated), distance2 (squared
    Mahalanobis distance, null only if all rows fail the base rules) and kept.

    A null text is an empty one and fails. Null lang or source are groups of their own. Rows count
    as often as they stand; other columns are ignored; an empty table gives no rows.
    """
    # Texts that fail anyway say nothing about their group.
    measured_rows = cut(statistics(documents).select("*", *_vector()))
    params = parameters(measured_rows)
    if params is None:
        out = measured_rows.withColumn("distance2", F.lit(None).cast("double"))
    else:
        out = measured_rows.join(params, GROUP).withColumn("distance2", _distance())
    return out.select(
        "doc_id", *STATS[:5], base_failed().alias("base_failed"),
        (~base_failed() & (F.col("distance2") <= cutoff)).alias("kept"), F.round("distance2", 3).alias("distance2"))


def keep_good(documents: DataFrame, cutoff: float = CHI2_9999) -> DataFrame:
    """documents without the rows that quality() rejects, columns as given. The texts are measured a
    second time, which costs less than a shuffle of them."""
    params = parameters(cut(statistics(documents).select("*", *_vector())))
    if params is None:
        return documents.where(F.lit(False))
    stats, own = spare(documents, "stats", "params")
    kind = pa.struct([(c, pa.int64()) for c in STATS])

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [dict(zip(STATS, measured(t), strict=True)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*part.schema.names, stats])

    fields = [*documents.schema.fields, StructField(stats, StructType([StructField(c, LongType()) for c in STATS]))]
    rows_of = documents.mapInArrow(each, StructType(fields))
    of = params.select(F.struct("*").alias(own))
    joined = rows_of.join(of, (named("lang") == F.col(f"{own}.lang")) & (named("source") == F.col(f"{own}.source")))
    stat = lambda c: F.col(f"{stats}.{c}")
    (at,) = spare(joined, "at")
    joined = joined.where(~base_failed(stat)).withColumn(at, F.struct(*_vector(stat)))
    return joined.where(_distance(f"{at}.{{}}", f"{own}.{{}}") <= cutoff).drop(stats, own, at)
