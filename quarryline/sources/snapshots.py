"""Snapshots: leakage-checked publications that appear whole or not at all, with a manifest of what
was written.

A snapshot is a folder: rows as JSON Lines in split=<name>/, files under _files/, and under _manifest/
splits (rows, families and digest of each split), artifacts (path, length, sha256 of each file)
and snapshot (the digest of the whole). It is written beside its place under a name of its own, and
renamed when everything has been read back and all inputs still have the digests they had.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.durable import settled
from quarryline.operators.selection import crossing, require_empty

from . import objects
from .images import plain


def _lanes(rows: DataFrame) -> list[Column]:
    """Sums that don't depend on the order of rows: their number, and the eight words of each row's
    SHA-256. They are added up before any shuffle, and no list of rows is made."""
    h = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    word = lambda k: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")
    return [F.count("*").alias("n_rows"), *(F.sum(word(k)).cast("string").alias(f"_{k}") for k in range(8))]


def _sealed() -> Column:
    return F.sha2(F.concat_ws(" ", F.col("n_rows").cast("string"), *(F.coalesce(f"_{k}", F.lit("0")) for k in range(8))), 256).alias("sha256")


def digest(rows: DataFrame) -> str:
    """SHA-256 over the sums of all rows' digests, whatever their order; see _lanes()."""
    return rows.agg(*_lanes(rows)).select(_sealed()).first()[0]


def splits_of(rows: DataFrame, family: str, split: str) -> DataFrame:
    """split, n_rows, n_families, sha256 of each split, by one pass over the rows."""
    own = rows.drop(split)
    sums = rows.groupBy(F.col(split).alias("split")).agg(*_lanes(own), F.countDistinct(family).alias("n_families"))
    return sums.select("split", "n_rows", "n_families", _sealed())


# Files and folders, by Hadoop's FileSystem.


def _at(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    store, own = _at(spark, path)
    return store.exists(own)


def _whole(spark: SparkSession, path: str) -> str:
    """The path without links and relative steps, as far as its folders exist."""
    store, own = _at(spark, path)
    own = store.makeQualified(own)
    rest = []
    while own.getParent() is not None and not store.exists(own):
        rest.insert(0, own.getName())
        own = own.getParent()
    # Hadoop's local store does not follow links itself.
    found = os.path.realpath(own.toUri().getPath()) if own.toUri().getScheme() == "file" else store.resolvePath(own).toString()
    return "/".join([found.rstrip("/"), *rest])


def require_free(spark: SparkSession, path: str, protected: list[str] | tuple[str, ...] = ()) -> None:
    """Refuses a destination that exists, or that lies in a protected folder or is one, by any name."""
    if exists(spark, path):
        raise ValueError(f"{path} already exists")
    own = _whole(spark, path)
    for root in protected:
        if (own + "/").startswith(_whole(spark, root) + "/"):
            raise ValueError(f"{path} lies inside the input {root}")


def fingerprints(spark: SparkSession, *roots: str) -> DataFrame:
    """path, length, sha256 of every file under the roots; each file is read once."""
    files = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(r) for r in roots]
    return reduce(DataFrame.unionAll, files).select(plain(F.col("path")).alias("path"), "length", F.sha2("content", 256).alias("sha256")).distinct()


@dataclass(frozen=True)
class Inputs:
    """What a plan was made from: folders or files, and the digests that they had then."""
    roots: tuple[str, ...]
    files: DataFrame


def recorded(spark: SparkSession, *roots: str) -> Inputs:
    return Inputs(roots, settled(fingerprints(spark, *roots)))


def changes(now: DataFrame, then: DataFrame) -> DataFrame:
    """path, change: files (path, sha256) that are missing, new or changed."""
    both = then.select("path", F.col("sha256").alias("then")).join(now.select("path", F.col("sha256").alias("now")), "path", "full_outer")
    kind = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "new").when(F.col("now") != F.col("then"), "changed")
    return both.select("path", kind.alias("change")).where("change is not null")


def require_unchanged(inputs: Inputs | None) -> None:
    if inputs is not None:
        gone = [r for r in inputs.roots if not exists(inputs.files.sparkSession, r)]
        if gone:
            raise ValueError(f"inputs changed after planning: {gone} is missing")
        require_empty(changes(fingerprints(inputs.files.sparkSession, *inputs.roots), inputs.files), "inputs changed after planning")


def _artifacts(spark: SparkSession, path: str) -> DataFrame:
    """path (inside the snapshot), length, sha256 of its rows' and placed files."""
    root = plain(F.lit(path))
    roots = [path, *([f"{path}/_files"] if exists(spark, f"{path}/_files") else [])]
    return fingerprints(spark, *roots).withColumn("path", F.substring("path", F.length(root) + 2, F.length("path")))


def _seal(splits: DataFrame, files: DataFrame | None) -> str:
    """The snapshot's digest: that of its rows by split and of its files by name. It is the same for
    the same contents, whatever the files are called that Spark wrote the rows to."""
    named = splits.select(F.concat(F.lit("rows "), "split").alias("name"), "sha256")
    if files is not None:
        named = named.unionAll(files.where(F.col("path").startswith("_files/")).select("path", "sha256"))
    return digest(named)


def publish(rows: DataFrame, path: str, family: str = "family_id", split: str = "split", inputs: Inputs | None = None,
            files: DataFrame | None = None, protected: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Publishes rows, a folder of JSON Lines for each split, and files (name, content) at path, and
    returns the manifest's splits: split, n_rows, n_families, sha256.

    Nothing is written if path exists or lies in one of the inputs' roots or protected folders, if a
    family crosses splits or if an input is not what it was when it was recorded(). All is written
    under another name and read back for the manifest; then inputs and destination are looked at once
    more and the folder is renamed. On any failure the written part is deleted, and path does not appear.
    """
    spark = rows.sparkSession
    path = path.rstrip("/")
    protected = [*protected, *(inputs.roots if inputs else ())]
    require_free(spark, path, protected)
    require_empty(crossing(rows, family, split), "families cross splits")
    require_unchanged(inputs)
    staging = f"{path}.partial-{uuid.uuid4().hex}"
    try:
        rows.write.mode("errorifexists").partitionBy(split).json(staging)
        if files is not None:
            objects.place(files, f"{staging}/_files")
        back = spark.read.schema(rows.schema).json(staging)
        splits, found = settled(splits_of(back, family, split)), settled(_artifacts(spark, staging))
        for name, part in (("splits", splits), ("artifacts", found), ("snapshot", spark.createDataFrame([(_seal(splits, found),)], "snapshot_sha256 string"))):
            part.write.json(f"{staging}/_manifest/{name}")
        require_unchanged(inputs)
        require_free(spark, path, protected)
        store, own = _at(spark, staging)
        if not store.rename(own, _at(spark, path)[1]):
            raise ValueError(f"{path} could not be taken")
    finally:
        store, own = _at(spark, staging)
        if store.exists(own):
            store.delete(own, True)
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("split string, n_rows long, n_families long, sha256 string").json(f"{path}/_manifest/splits")


def snapshot_digest(spark: SparkSession, path: str) -> str:
    return spark.read.schema("snapshot_sha256 string").json(f"{path}/_manifest/snapshot").first()[0]


def verified(spark: SparkSession, path: str, schema: str, split: str = "split", family: str | None = None) -> DataFrame:
    """Rows of a snapshot whose manifest, files, counts and digests agree; else an error. Files of
    the snapshot that the manifest lacks, or the other way round, are errors as well. With family, no
    family may stand in two splits."""
    path = path.rstrip("/")
    rows = spark.read.schema(f"{schema}, {split} string").json(path)
    splits = manifest(spark, path)
    artifacts = spark.read.schema("path string, length long, sha256 string").json(f"{path}/_manifest/artifacts")
    if _seal(splits, artifacts) != snapshot_digest(spark, path):
        raise ValueError(f"the manifest of {path} is not the one that was published")
    require_empty(changes(_artifacts(spark, path), artifacts), f"files of {path} differ from the manifest")
    own = splits_of(rows, family or split, split).select("split", F.struct("n_rows", "sha256").alias("now"))
    then = splits.select("split", F.struct("n_rows", "sha256").alias("then"))
    require_empty(own.join(then, "split", "full_outer").where("now is null or then is null or now <> then"), f"splits of {path} differ from the manifest")
    if family:
        require_empty(crossing(rows, family, split), "families cross splits")
    return rows


def ownership_faults(rows: DataFrame, files: DataFrame, images: str = "images", split: str = "split", owners: tuple[str, ...] = ("family_id", "source_sha256")) -> DataFrame:
    """what, value, fault of everything that a snapshot's splits must not share. rows have split, the
    owners (null: none) and images (array of names of files); files (name, sha256, split) say which split each
    file belongs to. Faults: "crosses splits" (an owner or an image's digest), "not in the manifest",
    "other split" (a row names a file of another split), "no owner" (the first owner is null or blank)."""
    first = owners[0]
    out = rows.where(F.col(first).isNull() | (F.trim(first) == "")).select(F.lit(first).alias("what"), F.col(first).alias("value"), F.lit("no owner").alias("fault")).distinct()
    for owner in owners:
        out = out.unionAll(crossing(rows, owner, split).select(F.lit(owner).alias("what"), F.col(owner).alias("value"), F.lit("crosses splits").alias("fault")))
    used = rows.select(F.explode(images).alias("name"), F.col(split).alias("of")).distinct()
    met = used.join(files.select("name", "sha256", F.col("split").alias("belongs")), "name", "left")
    fault = F.when(F.col("sha256").isNull(), "not in the manifest").when(~F.col("belongs").eqNullSafe(F.col("of")), "other split")
    out = out.unionAll(met.select(F.lit("image").alias("what"), F.col("name").alias("value"), fault.alias("fault")).where("fault is not null").distinct())
    return out.unionAll(crossing(met.where("sha256 is not null"), "sha256", "of").select(F.lit("image digest").alias("what"), F.col("sha256").alias("value"), F.lit("crosses splits").alias("fault")))
