"""Relational facts of evidence documents: pads on nets, point questions, complexity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def net_pads(pinrefs: DataFrame, connects: DataFrame) -> DataFrame:
    """Resolves pin references (source, page, net, part, gate, pin) by the connects of their part
    (source, part, gate, pin, pads: blank-separated) to distinct (source, page, net, pad)."""
    pads = connects.select("source", "part", "gate", "pin", F.explode(F.split(F.trim("pads"), r"\s+")).alias("_pad"))
    return pinrefs.join(pads, ["source", "part", "gate", "pin"]).select(
        "source", "page", "net", F.concat_ws(".", "part", "_pad").alias("pad")).distinct()


def unresolved(pinrefs: DataFrame, connects: DataFrame, physical: DataFrame) -> DataFrame:
    """Pin references of physical parts without a connect: such a document is to be rejected."""
    return pinrefs.join(physical.select("source", "part"), ["source", "part"], "left_semi").join(
        connects, ["source", "part", "gate", "pin"], "left_anti")


def members(pads: DataFrame, keys: list[str]) -> DataFrame:
    """The sorted pads of each net, joined by blanks, and their number."""
    return pads.groupBy(*keys).agg(F.array_sort(F.collect_set("pad")).alias("pads")).withColumns(
        {"n_pads": F.size("pads").cast("long"), "pads": F.array_join("pads", " ")})


def pad_net(pads: DataFrame, keys: list[str]) -> DataFrame:
    """Each pad's net where it is the only one: keys, pad, net."""
    return pads.groupBy(*keys, "pad").agg(F.min("net").alias("net"), F.countDistinct("net").alias("n")).where("n = 1").drop("n")


def conflicts(pads: DataFrame, keys: list[str]) -> DataFrame:
    """Pads on several nets: keys, pad, n_nets."""
    return pads.groupBy(*keys, "pad").agg(F.countDistinct("net").alias("n_nets")).where("n_nets > 1")


def traced(pads: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The other pads on the net of each asked pad (keys, pad): keys, pad, net, other."""
    a = pads.join(asked.select(*keys, "pad").distinct(), [*keys, "pad"])
    b = pads.select(*keys, "net", F.col("pad").alias("other"))
    return a.join(b, [*keys, "net"]).where("pad <> other").select(*keys, "pad", "net", "other")


def answered(questions: DataFrame, nets: DataFrame) -> DataFrame:
    """Point questions (page, pad) with status: source_verified where the pad's net is recorded, else
    not_recorded_on_page."""
    j = questions.join(nets, ["page", "pad"], "left")
    return j.withColumn("status", F.when(F.col("net").isNotNull(), "source_verified").otherwise("not_recorded_on_page"))


def across_pages(pads: DataFrame) -> DataFrame:
    """Named nets on more than one page of a source; anonymous nets (N$...) are never joined."""
    return pads.where(~F.col("net").startswith("N$")).groupBy("source", "net").agg(
        F.countDistinct("page").alias("n_pages"), F.count("*").alias("n_endpoints")).where("n_pages > 1")


def complexity(pads: DataFrame) -> DataFrame:
    """Distinct parts, pad entries and nets of each source, and its nets on several pages."""
    part = F.substring_index("pad", ".", 1)
    totals = pads.groupBy("source").agg(F.countDistinct(part).alias("n_parts"), F.count("*").alias("n_pads"), F.countDistinct("net").alias("n_nets"))
    shared = pads.groupBy("source", "net").agg(F.countDistinct("page").alias("n")).where("n > 1").groupBy("source").agg(F.count("*").alias("n_shared"))
    return totals.join(shared, "source", "left").select("source", "n_parts", "n_pads", "n_nets", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


#: Kinds of question that a schematic alone never answers, and what an answer would need.
REVIEWS = {
    "component_role": ("reviewed part identity", "functional context"),
    "decoupling_adequacy": ("datasheet requirement and citation", "operating conditions", "PCB placement"),
    "voltage_compatibility": ("reviewed part identities", "datasheet ratings and citations", "operating conditions"),
    "design_defect": ("explicit design requirement", "supporting evidence", "human review"),
    "measured_voltage": ("recorded bench measurement",),
}


def reviewed(questions: DataFrame, bom: DataFrame, pads: DataFrame, keys: list[str]) -> DataFrame:
    """questions (keys, kind, target) with status, answer, required (evidence that is missing) and
    eligible (may serve as gold). bom: keys, refdes, value; pads: keys, net, pad. Kind value asks for a
    part's value, net_members for the pads of a net, pad_net for the only net of a pad; kinds of REVIEWS
    are never answered. Any other kind is an error."""
    facts = bom.where("value <> ''").groupBy(*keys, F.col("refdes").alias("target")).agg(F.max("value").alias("answer")).withColumn("kind", F.lit("value"))
    facts = facts.unionByName(members(pads, [*keys, "net"]).select(*keys, F.col("net").alias("target"), F.col("pads").alias("answer"), F.lit("net_members").alias("kind")))
    facts = facts.unionByName(pad_net(pads, keys).select(*keys, F.col("pad").alias("target"), F.col("net").alias("answer"), F.lit("pad_net").alias("kind")))
    needs = F.create_map(*(x for k, v in REVIEWS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[F.col("kind")]
    known = F.col("kind").isin("value", "net_members", "pad_net", *REVIEWS)
    asked = questions.withColumn("kind", F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("no such kind of question: "), F.coalesce("kind", F.lit("null"))))))
    j = asked.withColumn("required", needs).join(facts, [*keys, "kind", "target"], "left")
    status = F.when(F.col("required").isNotNull(), "additional_evidence_required").when(
        F.col("answer").isNotNull(), "source_verified").otherwise("not_recorded_on_page")
    return j.withColumn("status", status).withColumn("eligible", F.col("status") == "source_verified")


def assignment_faults(declared: DataFrame, assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Pads of a circuit that are not on exactly one net: keys, pad, fault. declared and assigned: keys,
    pad; a pad assigned without being declared, declared twice, left out or assigned twice is a fault."""
    n = lambda df, name: df.groupBy(*keys, "pad").agg(F.count("*").alias(name))
    both = n(declared, "n_declared").join(n(assigned, "n_assigned"), [*keys, "pad"], "full")
    fault = F.when(F.col("n_declared").isNull(), "not declared").when(F.col("n_declared") > 1, "declared twice").when(
        F.col("n_assigned").isNull(), "not assigned").when(F.col("n_assigned") > 1, "assigned twice")
    return both.select(*keys, "pad", fault.alias("fault")).where("fault is not null")
