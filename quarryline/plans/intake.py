"""Queries on chat requests, metadata, repositories, jobs and split ownership, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import expressions as X
from quarryline.operators import intake as I

from .common import split_sql, table

BLOCK = "array<struct<type:string,text:string,image:string>>"


def request_faults(spark, d):
    """Conversations as requests, by what is wrong with them and what their texts are: every second one
    stops before its last turn, every fifth has a system message, others get images or bad blocks."""
    c = table(spark, d, "conversations")
    k = F.col("conv_id")
    block = lambda kind, text, image: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), F.lit(image).cast("string").alias("image"))
    parts = F.array(block("text", F.col("text"), None), block("image", F.lit(None), "a.png"))
    rich = ((k % 7 == 0) & (F.col("turn") % 2 == 0)) | ((k % 11 == 0) & (F.col("turn") == 1))
    message = F.struct(F.when(k % 13 == 0, F.lit("user")).otherwise(F.col("role")).alias("role"), F.when(~rich, F.col("text")).alias("content"),
                       F.when(rich, parts).cast(BLOCK).alias("blocks"))
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("t"))
    system = F.struct(F.lit("system").alias("role"), F.lit("Be brief.").alias("content"), F.lit(None).cast(BLOCK).alias("blocks"))
    said = F.transform("t", lambda x: x["m"])
    said = F.when(k % 2 == 0, F.slice(said, 1, F.size(said) - 1)).otherwise(said)
    made = whole.select("conv_id", F.when(k % 5 == 0, F.concat(F.array(system), said)).otherwise(said).alias("messages"))
    r = I.requests(made, 8, 2, 1500)
    texts = F.array_join(F.transform("normal", lambda m: I.block_text(m["role"], m["blocks"])), "\n")
    return r.select("conv_id", "fault", F.when(F.col("fault").isNull(), X.digest(texts)).alias("text_sha256"))


def shown_details(spark, d):
    p = table(spark, d, "part")
    name, sha = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("/srv/"), "p_name")).otherwise(F.col("p_name")), X.digest(F.col("p_name"))
    made = p.select("p_partkey", name.alias("served_model_name"), F.when(F.col("p_size") % 2 == 0, F.upper(sha)).otherwise(sha).alias("adapter_sha256"), F.lit("x").alias("path"))
    return I.safe_details(made, ["p_partkey"])


_WORDS = ("Board", "sensor_py", "Arduino-Shield", "x_lib", "pythonic", "bad name", "a/b")
_LICENCES = ("CC-BY-SA-4.0", "CC-BY-SA-3.0", "none")


def collectable_repositories(spark, d):
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % len(xs) + 1).cast("int"))
    r = table(spark, d, "part").select("p_partkey", F.concat(F.regexp_replace("p_brand", "#", "-"), F.lit("/"), pick(_WORDS, "p_partkey")).alias("repository"), pick(_LICENCES, "p_size").alias("licence"))
    return I.collectable(r, ["Brand-11", "Brand-12", "Brand-13", "Brand-21", "Brand-22"], list(_LICENCES[:2]), ["Brand-13"]).select("p_partkey", "repository")


def runnable_jobs(spark, d):
    """Events as jobs and regions as adapters, by what keeps them from running."""
    e = table(spark, d, "events").select((F.col("user_id") % 7).cast("string").alias("adapter"), F.when(F.col("event_id") % 3 == 0, "proposal").otherwise("training").alias("kind"))
    a = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("name"), F.when(F.col("r_regionkey") < 2, "proposal").otherwise("training").alias("kind"),
                                         (F.col("r_regionkey") != 3).alias("ready"), (F.col("r_regionkey") * 1000).cast("int").alias("gpu_mb"))
    return I.runnable(e, a, False, 4500, 1000).groupBy("kind", F.coalesce("reason", F.lit("runnable")).alias("reason")).agg(F.count("*").alias("n"))


def owned_families(spark, d):
    """Documents of the sources that belong to training or validation."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    families = docs.select("source").distinct().withColumn("split", X.family_split(F.col("source")))
    return I.owned(docs, families, "source", ["train", "val"])


def rows_with_view(spark, d):
    """Orders with the market segment of their customer, if that has no debt."""
    segments = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return I.with_view(table(spark, d, "orders").select("o_orderkey", "o_custkey"), segments, ["o_custkey"], "c_mktsegment")


def catalog_order(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"))
    return I.in_catalog_order(p, ["Brand#31", "Brand#12"]).select("id", "rank")


QUERIES = {f.__name__: f for f in (request_faults, shown_details, collectable_repositories, runnable_jobs, owned_families, rows_with_view, catalog_order)}

ORACLES = {
    "request_faults": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS cnt FROM conversations),
        m AS (SELECT conv_id, n, CASE WHEN conv_id % 13 = 0 THEN 'user' ELSE role END AS role, text, (conv_id % 7 = 0 AND turn % 2 = 0) OR (conv_id % 11 = 0 AND turn = 1) AS rich
          FROM c WHERE conv_id % 2 <> 0 OR n < cnt),
        l AS (SELECT *, CASE WHEN conv_id % 5 <> 0 AND first_value(role) OVER (PARTITION BY conv_id ORDER BY n) = 'system' THEN 1 ELSE 0 END AS lead FROM m),
        g AS (SELECT conv_id, count(*) + (CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END) AS n, bool_or(n > lead AND role <> CASE WHEN (n - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END) AS roles,
          bool_or(text IS NULL OR NOT regexp_matches(text, '\\S') OR (rich AND role <> 'user')) AS bad, coalesce(sum(length(text)), 0) + (CASE WHEN conv_id % 5 = 0 THEN 9 ELSE 0 END) AS chars,
          count(*) FILTER (rich) AS images, last(role ORDER BY n) AS final, (CASE WHEN conv_id % 5 = 0 THEN 'Be brief.' || chr(10) ELSE '' END) || string_agg(text, chr(10) ORDER BY n) AS texts
          FROM l GROUP BY conv_id),
        a AS (SELECT DISTINCT conv_id FROM conversations),
        f AS (SELECT conv_id, texts, CASE WHEN coalesce(n, CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END) NOT BETWEEN 1 AND 8 THEN 'messages' WHEN roles THEN 'roles' WHEN bad THEN 'blocks'
          WHEN chars > 1500 THEN 'text' WHEN images > 2 THEN 'images' WHEN coalesce(final, 'system') <> 'user' THEN 'end' END AS fault FROM a LEFT JOIN g USING (conv_id))
        SELECT conv_id, fault, CASE WHEN fault IS NULL THEN sha256(texts) END AS text_sha256 FROM f""",
    "shown_details": f"""SELECT p_partkey, CASE WHEN p_size % 3 <> 0 AND regexp_full_match(p_name, '{I.PLAIN[1:-2]}') THEN p_name END AS served_model_name,
        CASE WHEN p_size % 2 <> 0 THEN sha256(p_name) END AS adapter_sha256 FROM part""",
    "collectable_repositories": f"""WITH r AS (SELECT p_partkey, replace(p_brand, '#', '-') AS owner, {list(_WORDS)}[p_partkey % {len(_WORDS)} + 1] AS name, {list(_LICENCES)}[p_size % 3 + 1] AS licence FROM part)
        SELECT p_partkey, owner || '/' || name AS repository FROM r WHERE regexp_full_match(name, '[A-Za-z0-9_.-]+') AND licence <> 'none'
          AND (owner = 'Brand-13' OR (owner IN ('Brand-11', 'Brand-12', 'Brand-21', 'Brand-22') AND NOT regexp_matches(name, '{I.SOFTWARE}')))""",
    "runnable_jobs": """WITH j AS (SELECT user_id % 7 AS a, CASE WHEN event_id % 3 = 0 THEN 'proposal' ELSE 'training' END AS kind FROM events)
        SELECT kind, CASE WHEN a > 4 OR a = 3 OR (a < 2) <> (kind = 'proposal') THEN 'adapter not ready' WHEN kind = 'proposal' THEN 'publication disabled' WHEN a * 1000 + 1000 > 4500 THEN 'no memory'
          ELSE 'runnable' END AS reason, count(*) AS n FROM j GROUP BY 1, 2""",
    "owned_families": f"SELECT doc_id, source, {split_sql('source')} AS split FROM documents WHERE {split_sql('source')} <> 'test'",
    "rows_with_view": "SELECT o_custkey, o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0",
    "catalog_order": """SELECT p_partkey AS id, row_number() OVER (ORDER BY CASE p_brand WHEN 'Brand#31' THEN 1 WHEN 'Brand#12' THEN 2 ELSE 3 END, p_name, p_partkey) - 1 AS rank FROM part""",
}
