"""What a snapshot is made of and whether its rows are sound: counts, coverage, bindings, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import first_of, require_empty

# Variants that a pair of questions gives, and the form of a fingerprint.
VARIANTS = ("standalone", "explicit_second_turn", "contextual_followup")
FINGERPRINT = r"^[0-9a-f]{64}\z"


def composition(turns: DataFrame, row: str, kind: str, absent: str) -> DataFrame:
    """(measure, n): rows, turns, different absent identifiers, and turns of each kind. Null kinds
    count as turns only; without turns the three sums are zero."""
    sums = turns.agg(F.countDistinct(row).alias("rows"), F.count("*").alias("turns"), F.countDistinct(absent).alias("absent_identifiers"))
    kinds = turns.where(F.col(kind).isNotNull()).groupBy(F.concat(F.lit("kind:"), kind).alias("measure")).agg(F.count("*").alias("n"))
    return sums.unpivot([], ["rows", "turns", "absent_identifiers"], "measure", "n").unionByName(kinds)


def audit_counts(targets: DataFrame, split: str, flags: str) -> DataFrame:
    """Targets of each split, those with flags (an array) and those without. Null flags are none."""
    flagged = F.coalesce(F.size(flags), F.lit(0)) > 0
    return targets.groupBy(split).agg(F.count("*").alias("targets"), F.count_if(flagged).alias("flagged"), F.count_if(~flagged).alias("unreviewed"))


def require_wordings(cases: DataFrame, wording: str, n: int) -> DataFrame:
    """cases, if they hold just n different wordings; otherwise an error."""
    require_empty(cases.agg(F.countDistinct(wording).alias("found")).where(F.col("found") != n), f"{n} different wordings are expected")
    return cases


def probe_counters(rows: DataFrame, labels: str) -> DataFrame:
    """(counter, n) over rows with labels (type, refdes; refdes is null where the question has no
    supported form): what the rows are, why they give no probes, and how many probes they give. Each
    row adds its own counters before the shuffle; a counter that no row has is left out, but for
    derived_rows."""
    x = F.coalesce(F.col(labels), F.array().cast(rows.schema[labels].dataType))
    values = lambda a: F.size(F.filter(a, lambda t: F.coalesce(t["type"] == "value", F.lit(False))))
    first, second = F.get(x, 0)["refdes"], F.get(x, 1)["refdes"]
    outcome = F.when((F.size(x) < 2) | (values(F.slice(x, 1, 2)) < 2), "skipped_no_initial_value_pair").when(
        first.isNull() | second.isNull(), "skipped_unsupported_question").when(first == second, "skipped_repeated_target").otherwise("paired_source_rows")
    one = lambda name, n: F.struct(name.alias("counter"), n.cast("long").alias("n"))
    own = F.array(one(F.lit("source_rows"), F.lit(1)), one(F.concat(F.lit("source_rows_with_"), F.size(x).cast("string"), F.lit("_turns")), F.lit(1)),
                  one(F.lit("source_turns"), F.size(x)), one(F.lit("source_value_turns"), values(x)),
                  one(F.lit("source_value_followups"), values(F.slice(x, 2, F.greatest(F.size(x), F.lit(1))))), one(outcome, F.lit(1)),
                  one(F.lit("derived_rows"), F.when(outcome == "paired_source_rows", len(VARIANTS)).otherwise(0)))
    none = rows.sparkSession.range(1).select(F.lit("derived_rows").alias("counter"), F.lit(0).cast("long").alias("n"))
    return rows.select(F.inline(own)).unionByName(none).groupBy("counter").agg(F.sum("n").alias("n"))


def populated(bom: DataFrame, pads: DataFrame, source: str, page: str, least: int = 2) -> DataFrame:
    """(source, page) of the sheets with parts and nets, of sources with least such sheets or more."""
    sheets = bom.select(source, page).distinct().join(pads.select(source, page), [source, page], "left_semi")
    enough = sheets.groupBy(source).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return sheets.join(enough, source, "left_semi")


def names(bom: DataFrame, nets: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Different names of parts and nets for each key."""
    return bom.select(*keys, name).union(nets.select(*keys, name)).distinct()


def first_by_priority(candidates: DataFrame, keys: list[str], name: str, names_in_order: list[str], tie: str) -> DataFrame:
    """For each key the candidate whose name stands first in the list, of equal ones that with the least
    tie; other names don't count. A minimum that is taken before the shuffle, so hot keys cost little."""
    place = F.array_position(F.array(*map(F.lit, names_in_order)), F.col(name))
    rest = [c for c in candidates.columns if c not in keys]
    best = candidates.where(F.col(name).isin(names_in_order)).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(place, F.col(tie))).alias("_best"))
    return best.select(*keys, "_best.*")


def first_checked(rows: DataFrame, key: str, family: str, split: str, text: str, n: int) -> DataFrame:
    """The first n rows by key whose text is not blank. All of these rows, not only the first n, must
    have different keys, known splits and families of one split; otherwise an error."""
    full = rows.where(F.col(text).rlike(r"(?U)\S"))
    fields = [F.col(c).isNull() for c in (key, family, split)]
    require_empty(full.where(fields[0] | fields[1] | fields[2] | ~F.col(split).isin("train", "val", "test")).select(key, family, split), "identity or split is unknown")
    require_empty(full.groupBy(key).count().where("count > 1"), "keys stand twice")
    require_empty(full.groupBy(family).agg(F.countDistinct(split).alias("n")).where("n > 1"), "families stand in several splits")
    return full.orderBy(key).limit(n)


def anchored(text: Column, anchor: Column) -> Column:
    """Whether the text contains the anchor, if runs of white space count as one space and none at the ends."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))
    return plain(text).contains(plain(anchor))


def at_places(items: Column, places: list[int]) -> Column:
    """The elements of an array at the given places from 0, in the array's order."""
    return F.filter(items, lambda _, i: i.isin(places))


def changed(before: DataFrame, after: DataFrame, place: str, fields: list[str]) -> DataFrame:
    """after with changed_since_start: whether a field differs from the row of the same place before.
    A row without such a row has changed."""
    old = before.select(F.col(place), F.struct(*fields).alias("_old"))
    return after.join(old, place, "left").withColumn("changed_since_start", ~F.struct(*fields).eqNullSafe(F.col("_old"))).drop("_old")


def furthest(states: DataFrame, run: str, step: str, place: str) -> DataFrame:
    """For each run its state with the largest step, of equal ones the first by place. No step is 0."""
    rest = [c for c in states.columns if c != run]
    best = states.groupBy(run).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(step), F.lit(0)), -F.col(place))).alias("_best"))
    return best.select(run, "_best.*")


def image_fault(page: Column, declared: Column, images: Column) -> Column:
    """What is wrong with the binding of a row's only image to its page, or null. declared: page and
    sha256 of each image record; images: digests of the images that the messages show."""
    own = F.filter(declared, lambda d: F.coalesce(d["page"] == page, F.lit(False)))
    digest = F.get(own, 0)["sha256"]
    return F.when(~F.coalesce(page >= 1, F.lit(False)) | declared.isNull(), "provenance").when((F.size(own) != 1) | digest.isNull(), "fingerprint").when(
        ~digest.rlike(FINGERPRINT), "form").when(F.coalesce(F.size(images), F.lit(0)) != 1, "images").when(
        ~F.get(images, 0).eqNullSafe(digest), "differs")


def search_results(results: DataFrame, query: str, place: str, url: str | Column, n: int = 5, chars: int = 2048) -> DataFrame:
    """Of the first n results of each query, those with a web address, which is cut at chars. Places of
    a query are different numbers. An expression as url is worked out for the first n only, and is column url."""
    top = first_of(results, [query], [F.col(place)], n)
    name, own = (url, F.col(url)) if isinstance(url, str) else ("url", url)
    return top.withColumn(name, F.left(F.coalesce(own, F.lit("")), F.lit(chars))).where(F.col(name).rlike("(?i)^https?:"))
