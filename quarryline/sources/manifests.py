"""Manifests of pinned sources, and a check of the files against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.selection import crossing, require_empty

from .images import plain

FILE = "array<struct<path:string,sha256:string,reason:string>>"
FAMILIES = (f"families array<struct<repository:string,revision:string,split:string,license:string,license_path:string,license_sha256:string,attribution:string,"
            f"sources:{FILE},excluded_sources:{FILE}>>")
#: Forms of a repository, a revision and a digest.
REPOSITORY, REVISION, DIGEST = r"^[\w.-]+/[\w.-]+\z", r"^[0-9a-f]{40}\z", r"^[0-9a-f]{64}\z"


def _matches(c: str, form: str) -> Column:
    return F.coalesce(F.col(c).rlike(form), F.lit(False))


def sources(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file that a manifest (one JSON document with families) names: repository, revision, split, license,
    kind (source, excluded or licence), path, sha256, reason. A malformed document, a family in two splits, a file that is named
    twice, or a repository, revision or digest of another form is an error; so is a manifest without sources."""
    family = spark.read.schema(FAMILIES).option("multiLine", "true").option("mode", "FAILFAST").json(path).select(F.explode("families").alias("f")).select("f.*")
    none = F.lit(None).cast("string")
    licence = F.array(F.struct(F.col("license_path").alias("path"), F.col("license_sha256").alias("sha256"), none.alias("reason")))
    kinds = [(k, F.coalesce(c, F.array().cast(FILE))) for k, c in (("source", F.col("sources")), ("excluded", F.col("excluded_sources")), ("licence", licence))]

    def of(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x["path"].alias("path"), x["sha256"].alias("sha256"), x["reason"].alias("reason"))

    tagged = F.concat(*(F.transform(c, of(k)) for k, c in kinds))
    rows = family.select("repository", "revision", "split", "license", F.inline(tagged))
    sound = _matches("repository", REPOSITORY) & _matches("revision", REVISION) & _matches("sha256", DIGEST) & F.col("split").isin("train", "val", "test") & F.col("path").isNotNull()
    require_empty(rows.where(~F.coalesce(sound, F.lit(False))).select("repository", "path"), f"{path} has sources that are not pinned")
    require_empty(crossing(rows, "repository", "split"), f"{path} has families in two splits")
    require_empty(rows.groupBy("repository", "path").count().where("count > 1"), f"{path} names a file twice")
    require_empty(rows.agg(F.count_if(F.col("kind") == "source").alias("n")).where("n = 0"), f"{path} has no sources")
    return rows


def differing(found: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """repository, path, fault of sources() whose file in folder/<repository with __>/<path> is missing or has another digest.
    files: path, sha256, as snapshots.fingerprints() has them."""
    at = plain(F.concat(F.lit(folder + "/"), F.replace("repository", F.lit("/"), F.lit("__")), F.lit("/"), "path"))
    met = found.where("kind <> 'excluded'").withColumn("at", at).join(files.select(F.col("path").alias("at"), F.col("sha256").alias("now")), "at", "left")
    fault = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed")
    return met.select("repository", "path", fault.alias("fault")).where("fault is not null")
