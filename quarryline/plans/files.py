"""Queries on files: images that messages refer to, published snapshots, strict JSON Lines. The files are made
from the tables, in the shared folder, and read by the library's sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.durable import settled, shared_folder
from quarryline.sources import images, objects, snapshots, strict_jsonl

from .common import split_sql, table

#: The first 16 bytes and the closing chunk of a PNG file, the markers around a JPEG file.
PNG, IEND, JPEG, EOI = "89504E470D0A1A0A0000000D49484452", "0000000049454E44AE426082", "FFD8FFE0", "FFD9"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page is an image that a message of its own refers to. By page_id modulo 11, image 3 is missing, 4 lies
    beside the dataset and one folder up with other bytes, 5 there with the same ones, 6 is torn, 7 is one folder up, 8 is a JPEG
    file, 9 has another digest than the message says, 10 is named by a path with "..", the rest lie beside the dataset."""
    page = table(spark, sf_dir, "pages").selectExpr("page_id", "cast(coalesce(html, '') as binary) as body", "page_id % 11 as k")
    root = _folder(spark, "images")
    png = F.expr(f"concat(X'{PNG}', body, X'{IEND}')")
    content = F.when(F.col("k") == 8, F.expr(f"concat(X'{JPEG}', body, X'{EOI}')")).when(F.col("k") == 6, F.expr(f"concat(X'{PNG}', body)")).otherwise(png)
    name = F.concat(F.lit("images/"), F.col("page_id").cast("string"), F.lit(".png"))
    near, far = F.struct(F.concat(F.lit("sets/"), name).alias("name"), content.alias("content")), F.struct(name.alias("name"), content.alias("content"))
    other = F.struct(name.alias("name"), F.expr(f"concat(X'{PNG}', X'00', body, X'{IEND}')").alias("content"))
    placed = F.when(F.col("k") == 3, F.array().cast("array<struct<name:string,content:binary>>")).when(F.col("k") == 4, F.array(near, other)).when(
        F.col("k") == 5, F.array(near, far)).when(F.col("k") == 7, F.array(far)).otherwise(F.array(near))
    objects.place(page.select(F.inline(placed)), root)
    reference = F.when(F.col("k") == 10, F.concat(F.lit("../sets/./"), name)).otherwise(name)
    message = F.array(F.struct(F.lit("user").alias("role"), F.array(
        F.struct(F.lit("image").alias("type"), reference.alias("image"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("image"), F.lit("What is this?").alias("text"))).alias("content")))
    asked = images.references(page.select("page_id", message.alias("messages")), "page_id")
    asked = asked.withColumn("expected", F.when(F.col("page_id") % 11 == 9, F.lit("0" * 64)))
    found = images.resolved(asked, images.scan(spark, root), f"{root}/sets/train.jsonl", "expected")
    place = F.regexp_replace("path", f"^{images_root(root)}", "")
    return found.select("page_id", place.alias("place"), "length", "sha256", "format", "fault")


def images_root(folder: str) -> str:
    """The folder as images.plain() writes paths, with a slash at the end."""
    return "/" + folder.split(":", 1)[-1].strip("/") + "/"


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files named by their content; copies are one file."""
    page = table(spark, sf_dir, "pages").where("html is not null").selectExpr("cast(html as binary) as content", "'.html' as extension")
    folder = _folder(spark, "objects")
    objects.store(page, folder)
    found = images.scan(spark, folder, limit=1 << 62)
    return found.select(F.regexp_extract("path", r"([0-9a-f]{64})\.html$", 1).alias("name"), "length", "sha256")


def published_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents published as a snapshot split by source, read again through its manifest."""
    rows = table(spark, sf_dir, "documents").withColumn("source", F.coalesce("source", F.lit("")))
    rows = rows.select("doc_id", "text", "lang", "source", "n_chars", F.expr(SPLIT).alias("split"))
    path = _folder(spark, "snapshot")
    snapshots.publish(rows, path, family="source")
    back = snapshots.verified(spark, path, "doc_id long, text string, lang string, source string, n_chars long", family="source")
    return back.groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars"), F.sum(F.length("text")).alias("read_chars"))


#: The split of a source as the library's bucket rule has it.
SPLIT = "case when conv(substr(sha2(source, 256), 1, 8), 16, 10) % 10 < 2 then 'test' when conv(substr(sha2(source, 256), 1, 8), 16, 10) % 10 = 2 then 'val' else 'train' end"


def strict_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as strict JSON Lines of gold rows, then read with all checks: strict objects,
    unique ids, strict turns, one label for each answer."""
    turn = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    own = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))).alias("m"))
    # Users and assistants in turns, ended by an assistant.
    pairs = F.expr("transform(sequence(0, size(m) div 2 - 1), i -> array(struct('user' as role, m[2 * i].content as content), struct('assistant' as role, m[2 * i + 1].content as content)))")
    rows = own.where("size(m) >= 2").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.flatten(pairs).alias("messages"))
    label = F.expr("transform(sequence(1, size(messages) div 2), i -> struct('value' as type, concat('v', i) as value))")
    folder = _folder(spark, "gold")
    rows.select("id", "messages", label.alias("gold")).write.json(folder)
    read = strict_jsonl.gold(spark, folder)
    last = F.element_at("messages", -1)["content"]
    return settled(read.select("id", F.size("messages").cast("long").alias("n_messages"), F.size("gold").cast("long").alias("n_gold"), F.sha2(last, 256).alias("last_sha256")))


QUERIES = {"image_scan": image_scan, "stored_pages": stored_pages, "published_documents": published_documents, "strict_gold": strict_gold}

_BODY = "encode(coalesce(html, ''))"
ORACLES = {
    "image_scan": f"""
WITH p AS (SELECT page_id, page_id % 11 AS k, CASE page_id % 11 WHEN 8 THEN from_hex('{JPEG}') || {_BODY} || from_hex('{EOI}')
    WHEN 6 THEN from_hex('{PNG}') || {_BODY} ELSE from_hex('{PNG}') || {_BODY} || from_hex('{IEND}') END AS b FROM pages)
SELECT page_id, CASE WHEN k IN (3, 4) THEN NULL WHEN k = 7 THEN 'images/' || page_id || '.png' ELSE 'sets/images/' || page_id || '.png' END AS place,
  CASE WHEN k NOT IN (3, 4) THEN octet_length(b)::BIGINT END AS length, CASE WHEN k NOT IN (3, 4) THEN sha256(b) END AS sha256,
  CASE WHEN k IN (3, 4, 6) THEN NULL WHEN k = 8 THEN 'jpeg' ELSE 'png' END AS format,
  CASE k WHEN 3 THEN 'missing' WHEN 4 THEN 'ambiguous' WHEN 6 THEN 'no image' WHEN 9 THEN 'changed' END AS fault FROM p""",
    "stored_pages": "SELECT DISTINCT sha256(html) AS name, strlen(html) AS length, sha256(html) AS sha256 FROM pages WHERE html IS NOT NULL",
    "published_documents": f"""
SELECT {split_sql("coalesce(source, '')")} AS split, coalesce(source, '') AS source, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars, sum(length(text))::BIGINT AS read_chars
FROM documents GROUP BY ALL""",
    "strict_gold": """
WITH t AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n
    FROM conversations WHERE role IN ('user', 'assistant'))
SELECT 'c' || conv_id AS id, n // 2 * 2 AS n_messages, n // 2 AS n_gold, sha256(text) AS last_sha256 FROM t WHERE n >= 2 AND p = n // 2 * 2""",
}
