"""Images that messages refer to: which file is meant, its digest and format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which an image is read.
LIMIT = 32 * 1024 * 1024


def plain(path: Column) -> Column:
    """A path without scheme and authority, and without empty, "." and ".." steps."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    steps = F.aggregate(
        F.split(bare, "/"), F.array().cast("array<string>"),
        lambda done, step: F.when(step.isin("", "."), done).when(
            step == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(step))))
    return F.concat(F.lit("/"), F.array_join(steps, "/"))


def image_format(content: Column) -> Column:
    """png, jpeg or webp by the first bytes, or null; and only if the end is there too: PNG's header
    and closing chunk, JPEG's closing marker, the length that WebP states."""
    at = lambda start, n: F.hex(F.substring(content, start, n))
    size = F.octet_length(content)
    stated = F.conv(F.concat(at(8, 1), at(7, 1), at(6, 1), at(5, 1)), 16, 10).cast("long")
    png = (at(1, 8) == "89504E470D0A1A0A") & (at(13, 4) == "49484452") & (at(-12, 12) == "0000000049454E44AE426082")
    jpeg = (at(1, 3) == "FFD8FF") & (at(-2, 2) == "FFD9")
    webp = (at(1, 4) == "52494646") & (at(9, 4) == "57454250") & (stated + 8 == size)
    return F.when(png, "png").when(jpeg, "jpeg").when(webp, "webp")


def scan(spark: SparkSession, folder: str, limit: int = LIMIT) -> DataFrame:
    """path, length, sha256, format of every file under folder. The bound is part of the listing, so
    longer files are not read: their sha256 and format are null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = plain(F.col("path")).alias("path")
    read = files.where(F.col("length") <= limit).select(path, "length", F.sha2("content", 256).alias("sha256"), image_format(F.col("content")).alias("format"))
    long = files.where(F.col("length") > limit).select(path, "length", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("format"))
    return read.unionAll(long)


def references(rows: DataFrame, key: str, messages: str = "messages") -> DataFrame:
    """key, message, block (places from 0), reference for each image block of rows' messages
    (array of struct with content: array of struct with type, image)."""
    message = rows.select(key, F.posexplode(messages).alias("message", "_m"))
    block = message.select(key, "message", F.posexplode("_m.content").alias("block", "_b"))
    return block.where("_b.type = 'image'").select(key, "message", "block", F.col("_b.image").alias("reference"))


def resolved(found: DataFrame, files: DataFrame, dataset: str, expected: str | None = None) -> DataFrame:
    """found (with a column reference) with path, length, sha256, format, fault.

    A relative reference is looked for beside the dataset's file and one folder further up, an
    absolute one by itself. Fault: "no reference" (null or blank), "missing", "ambiguous" (files with
    different contents at both places), "too long" (nothing but files beyond the scan's bound), "no image"
    (neither PNG, JPEG nor WebP, or torn), "changed" (not the digest in the column `expected`). A
    copy or link with equal bytes is the same image, and the place beside the dataset is named.
    """
    own = found.withColumn("_dataset", F.col(dataset) if dataset in found.columns else F.lit(dataset))
    parent = F.regexp_replace(F.regexp_replace("_dataset", r"/+$", ""), r"/[^/]*$", "")
    near, far = F.concat(parent, F.lit("/"), F.col("reference")), F.concat(parent, F.lit("/../"), F.col("reference"))
    blank = F.col("reference").isNull() | (F.trim("reference") == "")
    absolute = F.col("reference").startswith("/") | F.col("reference").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:/")
    places = F.when(absolute, F.array(plain(F.col("reference")))).otherwise(F.array_distinct(F.array(plain(near), plain(far))))
    # Each reference is looked up once, however many messages hold it.
    asked = own.where(~blank).select("_dataset", "reference").distinct().select("_dataset", "reference", F.posexplode(places).alias("_at", "path"))
    hit = asked.join(files.select("path", "length", "sha256", "format"), "path").groupBy("_dataset", "reference").agg(
        F.min(F.struct("_at", "path", "length", "sha256", "format")).alias("_hit"), F.countDistinct(F.coalesce("sha256", "path")).alias("_n"))
    out = own.join(hit, ["_dataset", "reference"], "left")
    sha = F.col("_hit.sha256")
    fault = F.when(blank, "no reference").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").when(
        sha.isNull(), "too long").when(F.col("_hit.format").isNull(), "no image")
    if expected:
        fault = fault.when(F.col(expected).isNotNull() & (F.col(expected) != sha), "changed")
    sure = F.col("_n") == 1
    one = lambda c: F.when(sure, F.col(f"_hit.{c}")).alias(c)
    return out.select(*found.columns, one("path"), one("length"), one("sha256"), one("format"), fault.alias("fault"))
