"""A catalogue of example pages: a manifest whose sources and images are bound by path and digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.parsers import strict_json_error
from quarryline.operators.selection import first_of, require_empty

from . import eagle, images
from .pinned import pinned

RECORD = ("repository string, commit string, id string, source_path string, sha256 string, license string, render_method string, "
          "images array<struct<page:int,path:string,sha256:string>>")
#: Bytes of an image at most, pages of a catalogue at most, forms of a commit and an id.
IMAGE, PAGES, COMMIT, ID = 16 * 1024 * 1024, 1000, r"^[0-9a-f]{40}\z", r"^real-[0-9a-f]{16}\z"
#: What is asked about a page: of two parts whose value can be seen, and of none.
ASKED, BENCH = "What value is shown for {}?", "What information would require a bench measurement?"


def _inside(path: Column) -> Column:
    """Whether a path stays in its folder."""
    return path.isNotNull() & (path != "") & ~path.startswith("/") & ~path.contains("\\") & ~F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))


def entries(spark: SparkSession, folder: str, publishers: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(pages, faults) of the catalogue in folder: manifest.jsonl, sources/<repository with __>/<source_path>, and images by
    their path. publishers: name and licence of each owner of repositories.

    pages: id, title, publisher, page, repository, revision, license, source_sha256, image_path, image_sha256, questions.
    faults: record (the manifest's line), id, fault: "no record" (no strict object, or a field of another type or missing),
    "unknown publisher", "not pinned" (commit, id or licence), "path outside", "source missing", "source changed", "no schematic", "no
    pages", "no such page", "image missing", "no png" (by name, size or content), "image changed", "repeated page".
    Files are read once each, by Spark; their number of sheets is the highest one that shows a part or net.
    """
    root = images.plain(F.lit(folder))
    lines = pinned(spark, f"{folder}/manifest.jsonl")
    own = lines.select("ordinal", strict_json_error("line").alias("json"), F.from_json("line", RECORD).alias("r")).select("ordinal", "json", "r.*")
    owner = F.substring_index("repository", "/", 1)
    known = spark.createDataFrame([(o, n, x) for o, (n, x) in publishers.items()], "owner string, publisher string, terms string")
    own = own.join(F.broadcast(known), owner == F.col("owner"), "left")
    source = F.concat(root, F.lit("/sources/"), F.replace("repository", F.lit("/"), F.lit("__")), F.lit("/"), "source_path")
    missing = F.greatest(*(F.col(c).isNull() for c in ("repository", "commit", "id", "source_path", "sha256")))
    pinned_well = F.col("commit").rlike(COMMIT) & F.col("id").rlike(ID) & F.col("license").eqNullSafe(F.col("terms"))
    early = F.when(F.col("json").isNotNull() | missing, "no record").when(F.col("publisher").isNull(), "unknown publisher").when(~pinned_well, "not pinned").when(
        ~_inside(F.col("source_path")), "path outside").when(F.size(F.coalesce("images", F.array())) < 1, "no pages")
    own = own.withColumns({"early": early, "source": source})

    files = images.scan(spark, folder, IMAGE)
    facts = eagle.scan(spark, f"{folder}/sources")
    sheets = facts.groupBy("source").agg(F.max("page").alias("n_pages"), F.max("error").alias("error")).withColumnRenamed("source", "file_sha256")
    found = own.join(files.select(F.col("path").alias("source"), F.col("sha256").alias("file_sha256")), "source", "left").join(sheets, "file_sha256", "left")
    middle = F.when(F.col("file_sha256").isNull(), "source missing").when(F.col("file_sha256") != F.col("sha256"), "source changed").when(
        F.col("error").isNotNull() | F.col("n_pages").isNull(), "no schematic")
    found = found.withColumn("fault", F.coalesce("early", middle))
    whole = found.where("fault is not null").select(F.col("ordinal").alias("record"), "id", "fault")

    page = found.where("fault is null").select("*", F.explode("images").alias("image"))
    at = F.concat(root, F.lit("/"), F.col("image.path"))
    page = page.withColumn("image_path", F.when(_inside(F.col("image.path")), at)).join(
        files.select(F.col("path").alias("image_path"), F.col("sha256").alias("image_sha256"), "format", "length"), "image_path", "left")
    late = F.when(F.col("image").isNull() | F.col("image.page").isNull() | ~F.col("image.page").between(1, F.col("n_pages")), "no such page").when(
        F.col("image_path").isNull(), "path outside").when(F.col("length").isNull(), "image missing").when(
        ~F.lower("image_path").endswith(".png") | ~F.col("format").eqNullSafe(F.lit("png")), "no png").when(~F.col("image_sha256").eqNullSafe(F.col("image.sha256")), "image changed")
    name = F.concat("id", F.lit("-p"), F.col("image.page").cast("string"))
    page = page.withColumns({"wrong": late, "entry": name})
    again = page.where("wrong is null").groupBy("entry").count().where("count > 1").select("entry", F.lit(-1).cast("long").alias("record"))
    faults = whole.unionAll(page.where("wrong is not null").select(F.col("ordinal").alias("record"), F.col("entry").alias("id"), F.col("wrong").alias("fault"))).unionAll(
        again.select("record", F.col("entry").alias("id"), F.lit("repeated page").alias("fault")))

    bom, _ = eagle.extract(facts)
    seen = bom.where(F.col("value_visible") & (F.col("value") != "")).select(F.col("source").alias("file_sha256"), F.col("page").cast("int").alias("of"), "refdes")
    first = first_of(seen, ["file_sha256", "of"], [~F.col("refdes").startswith("R"), F.col("refdes")], 2)
    own_rank = F.struct((~F.col("refdes").startswith("R")).alias("rank"), "refdes")
    asked = first.groupBy("file_sha256", "of").agg(F.array_sort(F.collect_list(own_rank)).alias("parts"))
    form = ASKED.split("{}")
    questions = F.concat(F.transform(F.coalesce("parts", F.array().cast("array<struct<rank:boolean,refdes:string>>")), lambda p: F.concat(F.lit(form[0]), p["refdes"], F.lit(form[1]))), F.array(F.lit(BENCH)))
    title = F.regexp_replace(F.substring_index("repository", "/", -1), r"[-_]+", " ")
    title = F.regexp_replace(F.concat(title), r" PCB\z", "")
    title = F.when(F.startswith(title, F.concat("publisher", F.lit(" "))), F.substring(title, F.length("publisher") + 2, F.length(title))).otherwise(title)
    good = page.where("wrong is null").withColumn("of", F.col("image.page")).join(asked, ["file_sha256", "of"], "left")
    pages = good.select(F.col("entry").alias("id"), title.alias("title"), "publisher", F.col("of").alias("page"), "repository", F.col("commit").alias("revision"), "license",
                        F.col("sha256").alias("source_sha256"), "image_path", "image_sha256", questions.alias("questions"))
    return pages, faults


def catalogue(spark: SparkSession, folder: str, publishers: dict[str, tuple[str, str]]) -> DataFrame:
    """The pages of a catalogue in which nothing is wrong, up to PAGES of them; else an error."""
    pages, faults = entries(spark, folder, publishers)
    require_empty(faults, f"{folder} is no sound catalogue")
    n = pages.limit(PAGES + 1).count()
    if not 1 <= n <= PAGES:
        raise ValueError(f"{folder} must have 1 to {PAGES} pages")
    return pages
