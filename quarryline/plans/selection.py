"""Queries on splits, leakage, duplicates and selections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import expressions as X
from quarryline.operators import selection as S

from .common import split_sql, table


def gated_eval(spark, d):
    """Split-aware gated evaluation: labels against a rule on documents, by the split of the source."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    j = table(spark, d, "labels").join(docs, "doc_id")
    hit = ((F.col("n_chars") >= 200).cast("int") == F.col("quality")).cast("double")
    m = j.groupBy(X.family_split(F.col("source")).alias("split")).agg(F.avg(hit).alias("value"), F.count("*").alias("n"))
    return m.select("split", "n", F.round("value", 6).alias("accuracy"), X.passes(F.col("value"), F.col("n"), F.lit(0.85)).alias("passed"))


def split_counts(spark, d):
    docs = table(spark, d, "documents").select("source", "n_chars")
    return docs.groupBy(X.family_split(F.col("source")).alias("split")).agg(
        F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_families"), F.sum("n_chars").alias("n_chars"))


def split_by_customer(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy(X.family_split(F.col("c_name")).alias("split")).agg(
        F.count("*").alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def _split_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", X.digest(F.col("text")).alias("digest"),
                                               X.family_split(F.col("source")).alias("split"))


def family_leakage(spark, d):
    return S.crossing(_split_docs(spark, d), "lang", "split")


def content_leakage(spark, d):
    return S.crossing(_split_docs(spark, d), "digest", "split")


def holdout_overlap(spark, d):
    def fields(name, key):
        t = table(spark, d, name)
        return t.select(F.col(key).alias("id"), X.digest(F.col("text")).alias("text"),
                        X.digest(F.substring_index("text", ".", 1)).alias("opening"), F.length("text").alias("n_chars"))

    return S.overlap(fields("documents", "doc_id"), fields("benchmark", "item_id"), ["id", "text", "opening", "n_chars"])


def view_family_agreement(spark, d):
    """Families (a source and a size class of 500 characters) of which only one of two languages has documents."""
    docs = table(spark, d, "documents").select("lang", F.concat("source", F.lit(":"), F.floor(F.col("n_chars") / 500).cast("string")).alias("source"))
    return S.disagreement(docs.where("lang = 'fr'"), docs.where("lang = 'es'"), "source")


def content_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.digest(F.col("text")).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


def one_per_family(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return S.first_of(docs, ["source"], [F.col("doc_id").desc()])


def repository_dedup(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id")).select("source", "doc_id")


def seeded_representative(spark, d):
    return S.representative(table(spark, d, "part").select("p_brand", "p_type", "p_partkey"), ["p_brand", "p_type"], "p_partkey", 3407)


def seeded_families(spark, d):
    return S.seeded_top(table(spark, d, "documents"), "source", 8, 3407)


def group_exclusion(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return S.without_groups(p, ["p_brand", "p_size"], p.where("p_retailprice > 990")).select("p_partkey", "p_brand", "p_size")


#: Prefixes of the identifiers from which an absent one is chosen.
PREFIXES = ("R", "C", "U", "L", "D", "Q", "JP")


def absent_identifiers(spark, d):
    """For each nation an identifier that none of its suppliers carries, least by seeded digest."""
    s = table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("nation"),
        F.concat(F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("s_suppkey") % 7 + 1).cast("int")), (F.col("s_suppkey") % 128 + 1).cast("string")).alias("ref"))
    names = F.flatten(F.transform(F.array(*map(F.lit, PREFIXES)), lambda p: F.transform(
        F.sequence(F.lit(1), F.lit(128)), lambda i: F.concat(p, i.cast("string")))))
    pool = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.explode(names).alias("ref"))  # 896 names for each nation
    free = pool.join(s, ["nation", "ref"], "left_anti")
    return free.groupBy("nation").agg(F.min_by("ref", X.seeded(3407, F.col("nation"), F.col("ref"))).alias("ref"))


def first_n_distinct(spark, d):
    return S.first_distinct(table(spark, d, "part"), "p_brand", "p_partkey", 12)


def equally_spaced(spark, d):
    return S.equally_spaced(table(spark, d, "orders"), "o_orderkey", 26)


def unseen_values_anti(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_size").alias("p_name"), X.family_split(F.col("p_brand")).alias("split"))
    seen = p.where("split = 'train'").select(F.lower("p_name").alias("n")).distinct()
    return p.where("split = 'val'").join(seen, F.lower("p_name") == F.col("n"), "left_anti").select("p_partkey", "p_name")


def region_semi(spark, d):
    items = table(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey")
    return table(spark, d, "part").join(items, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


def key_coverage(spark, d):
    return S.coverage(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id")


def label_selection_pins(spark, d):
    """Benchmark items and how many of their sentences stand in documents as well, by digests of sentences."""
    sentence = lambda t: table(spark, d, t).select("*", F.explode(F.split("text", "[.]")).alias("s")).withColumn("s", F.trim("s")).where("s <> ''")
    b = sentence("benchmark").select("item_id", X.digest(F.col("s")).alias("digest")).distinct()
    return b.join(sentence("documents").select(X.digest(F.col("s")).alias("digest")), "digest", "left_semi").groupBy("item_id").agg(F.count("*").alias("n_sentences"))


QUERIES = {f.__name__: f for f in (
    gated_eval, split_counts, split_by_customer, family_leakage, content_leakage, holdout_overlap, view_family_agreement, content_dedup,
    one_per_family, repository_dedup, seeded_representative, seeded_families, group_exclusion, absent_identifiers, first_n_distinct,
    equally_spaced, unseen_values_anti, region_semi, key_coverage, label_selection_pins)}

_SRC, _NAMES = split_sql("source"), "['R','C','U','L','D','Q','JP']"
ORACLES = {
    "gated_eval": f"""SELECT {_SRC} AS split, count(*) AS n, round(avg(CASE WHEN (n_chars >= 200)::INT = quality THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy,
        avg(CASE WHEN (n_chars >= 200)::INT = quality THEN 1.0::DOUBLE ELSE 0 END) >= 0.85 AS passed FROM labels JOIN documents USING (doc_id) GROUP BY 1""",
    "split_counts": f"SELECT {_SRC} AS split, count(*) AS n_docs, count(DISTINCT source) AS n_families, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1",
    "split_by_customer": f"SELECT {split_sql('c_name')} AS split, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1",
    "family_leakage": f"SELECT lang, count(DISTINCT {_SRC}) AS n_splits, count(*) AS n_rows FROM documents WHERE lang IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_SRC}) > 1",
    "content_leakage": f"SELECT sha256(text) AS digest, count(DISTINCT {_SRC}) AS n_splits, count(*) AS n_rows FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_SRC}) > 1",
    "holdout_overlap": """WITH a AS (SELECT doc_id::VARCHAR AS id, sha256(text) AS text, sha256(split_part(text, '.', 1)) AS opening, length(text)::VARCHAR AS n_chars FROM documents),
        b AS (SELECT item_id::VARCHAR AS id, sha256(text) AS text, sha256(split_part(text, '.', 1)) AS opening, length(text)::VARCHAR AS n_chars FROM benchmark)
        SELECT 'id' AS field, (SELECT count(DISTINCT id) FROM a WHERE id IN (SELECT id FROM b)) AS n_shared
        UNION ALL SELECT 'text', (SELECT count(DISTINCT text) FROM a WHERE text IN (SELECT text FROM b))
        UNION ALL SELECT 'opening', (SELECT count(DISTINCT opening) FROM a WHERE opening IN (SELECT opening FROM b))
        UNION ALL SELECT 'n_chars', (SELECT count(DISTINCT n_chars) FROM a WHERE n_chars IN (SELECT n_chars FROM b))""",
    "view_family_agreement": """WITH f AS (SELECT DISTINCT lang, source || ':' || (n_chars // 500) AS source FROM documents WHERE source IS NOT NULL), a AS (SELECT source FROM f WHERE lang = 'fr'), b AS (SELECT source FROM f WHERE lang = 'es')
        SELECT source, 'left' AS side FROM a WHERE source NOT IN (SELECT source FROM b) UNION ALL SELECT source, 'right' FROM b WHERE source NOT IN (SELECT source FROM a)""",
    "content_dedup": "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1",
    "one_per_family": "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1",
    "repository_dedup": "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "seeded_representative": "SELECT p_brand, p_type, arg_min(p_partkey, sha256('3407:' || p_brand || ':' || p_type || ':' || p_partkey)) AS representative, count(*) AS n_members FROM part GROUP BY 1, 2",
    "seeded_families": "WITH s AS (SELECT DISTINCT source FROM documents) SELECT source, row_number() OVER (ORDER BY sha256('3407:' || source), source)::INT AS place FROM s QUALIFY place <= 8",
    "group_exclusion": "SELECT p_partkey, p_brand, p_size FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_size = p.p_size AND q.p_retailprice > 990)",
    "absent_identifiers": f"""WITH s AS (SELECT s_nationkey AS nation, {_NAMES}[s_suppkey % 7 + 1] || (s_suppkey % 128 + 1) AS ref FROM supplier),
        pool AS (SELECT p || i AS ref FROM (SELECT unnest({_NAMES}) AS p), range(1, 129) r(i)), free AS (SELECT n_nationkey AS nation, ref FROM nation, pool)
        SELECT nation, arg_min(ref, sha256('3407:' || nation || ':' || ref)) AS ref FROM free WHERE (nation, ref) NOT IN (SELECT nation, ref FROM s) GROUP BY 1""",
    "first_n_distinct": "SELECT arg_min(p_brand, p_partkey) AS p_brand, min(p_partkey) AS first_at FROM part GROUP BY lower(p_brand) ORDER BY 2 LIMIT 12",
    "equally_spaced": """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank, count(*) OVER () AS n FROM orders)
        SELECT DISTINCT o_orderkey, rank FROM o, range(0, 26) r(i) WHERE rank = round_even(i * (n - 1) / 25.0::DOUBLE, 0)::BIGINT""",
    "unseen_values_anti": f"""WITH p AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_size AS p_name, {split_sql('p_brand')} AS split FROM part)
        SELECT p_partkey, p_name FROM p WHERE split = 'val' AND lower(p_name) NOT IN (SELECT lower(p_name) FROM p WHERE split = 'train')""",
    "region_semi": "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
    "key_coverage": """SELECT count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS matched, count(*) FILTER (d.doc_id IS NULL) AS missing, count(*) FILTER (l.doc_id IS NULL) AS extra
        FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN (SELECT DISTINCT doc_id FROM documents) d USING (doc_id)""",
    "label_selection_pins": """WITH b AS (SELECT DISTINCT item_id, trim(unnest(string_split(text, '.'))) AS s FROM benchmark), d AS (SELECT DISTINCT trim(unnest(string_split(text, '.'))) AS s FROM documents)
        SELECT item_id, count(*) AS n_sentences FROM b WHERE s <> '' AND s IN (SELECT s FROM d) GROUP BY 1""",
}
