"""Queries on the make-up and soundness of snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import expressions as X
from quarryline.operators import audits as A

from .common import split_sql, table


def snapshot_composition(spark, d):
    """Conversations as rows; an assistant's first word stands for an identifier."""
    c = table(spark, d, "conversations")
    word = F.when(F.col("role") == "assistant", F.substring_index("text", " ", 1))
    return A.composition(c.select("conv_id", "role", word.alias("absent")), "conv_id", "role", "absent")


def readability_counts(spark, d):
    """Documents as targets, flagged as long or as marked up."""
    docs = table(spark, d, "documents").withColumn("split", X.family_split(F.col("source")))
    flags = F.filter(F.array(F.when(F.length("text") > 2000, "long"), F.when(F.col("text").contains("#"), "marked")), lambda f: f.isNotNull())
    return A.audit_counts(docs.withColumn("flags", flags), "split", "flags")


def distinct_wordings(spark, d):
    return A.require_wordings(table(spark, d, "region").select("r_regionkey", "r_name"), "r_name", 5)


def probe_counts(spark, d):
    """Orders as conversations, their lines as labelled turns."""
    line = F.struct(F.col("l_linenumber").alias("k"), F.when(F.col("l_returnflag") == "R", "refuse").otherwise("value").alias("type"),
                    (F.col("l_suppkey") % 4).cast("string").alias("ref"))
    turns = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("t"))
    labels = F.transform("t", lambda x: F.struct(x["type"].alias("type"), F.when(x["ref"] != "3", x["ref"]).alias("refdes")))
    return A.probe_counters(turns.select(labels.alias("labels")), "labels")


def populated_sheets(spark, d):
    """Suppliers as sources and line numbers as sheets: parts are lines returned, nets lines not returned in large numbers."""
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("page"), "l_returnflag", "l_quantity")
    return A.populated(x.where("l_returnflag = 'R' and l_quantity > 40"), x.where("l_returnflag <> 'R' and l_quantity > 30"), "source", "page")


def sheet_names(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), "l_partkey", "l_orderkey")
    part = x.select("source", F.concat(F.lit("N"), (F.col("l_partkey") % 60).cast("string")).alias("name"))
    net = x.select("source", F.concat(F.lit("N"), (F.col("l_orderkey") % 90).cast("string")).alias("name"))
    return A.names(part, net, ["source"], "name")


def priority_first(spark, d):
    """The line of an order to show: open ones before accepted ones, none that came back."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    return A.first_by_priority(x, ["l_orderkey"], "l_returnflag", ["N", "A"], "l_linenumber")


def checked_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text").withColumn("split", X.family_split(F.col("source")))
    return A.first_checked(docs, "doc_id", "source", "split", "text", 25).select("doc_id", "split")


def anchors(spark, d):
    """Documents and a quotation of their text in other white space, every third with a word too many."""
    t = F.col("text")
    quote = F.concat(F.lit("\n "), F.regexp_replace(t, " ", " \t"), F.when(F.col("doc_id") % 3 == 0, "zzz!").otherwise("\u2003"))
    return table(spark, d, "documents").select("doc_id", A.anchored(t, quote).alias("found"))


def message_places(spark, d):
    """The first, third and fourth message of each conversation."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    kept = A.at_places(F.col("m"), [0, 2, 3])
    return c.select("conv_id", F.array_join(F.transform(kept, lambda m: m["role"]), ",").alias("roles"),
                    X.digest(F.array_join(F.transform(kept, lambda m: m["text"]), "\n")).alias("text_sha256"))


def changed_artifacts(spark, d):
    """Parts as artifacts: every ninth has grown, every seventh wasn't there before."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    grown = p.withColumn("p_size", F.when(F.col("p_partkey") % 9 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return A.changed(p.where("p_partkey % 7 <> 0"), grown, "p_partkey", ["p_name", "p_size"])


def furthest_state(spark, d):
    """Events of a user as states of a run, their whole values as steps."""
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.floor("value")).alias("step"))
    return A.furthest(e, "user_id", "step", "event_id")


def image_bindings(spark, d):
    """Parts as rows with image records, some of them twice, missing, malformed or of other contents."""
    k, sha = F.col("p_partkey"), X.digest(F.col("p_name"))
    record = lambda page, s: F.struct(page.cast("long").alias("page"), s.alias("sha256"))
    own = F.when(k % 5 == 0, F.upper(sha)).otherwise(sha)
    declared = F.array(record(F.lit(1), own), record(F.when(k % 7 == 0, 1).otherwise(2), sha))
    images = F.when(k % 11 == 0, F.array(sha, sha)).when(k % 13 == 0, F.array(X.digest(F.col("p_brand")))).otherwise(F.array(sha))
    return table(spark, d, "part").select("p_partkey", A.image_fault(k % 4, declared, images).alias("fault"))


def search_hits(spark, d):
    """Parts as results of a search for their brand."""
    url = F.element_at(F.array(*map(F.lit, ("https://a.test/", "HTTP://b.test/", "ftp://c.test/", "javascript:"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    r = table(spark, d, "part").select("p_brand", "p_partkey", "p_name")
    return A.search_results(r, "p_brand", "p_partkey", F.concat(url, F.repeat("p_name", F.lit(60)))).select("p_brand", "p_partkey", F.length("url").alias("chars"), X.digest(F.col("url")).alias("url_sha256"))


QUERIES = {f.__name__: f for f in (snapshot_composition, readability_counts, distinct_wordings, probe_counts, populated_sheets, sheet_names, priority_first,
                                   checked_rows, anchors, message_places, changed_artifacts, furthest_state, image_bindings, search_hits)}

#: White space as Unicode has it, for RE2.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

ORACLES = {
    "snapshot_composition": """SELECT 'rows' AS measure, count(DISTINCT conv_id) AS n FROM conversations UNION ALL SELECT 'turns', count(*) FROM conversations
        UNION ALL SELECT 'absent_identifiers', count(DISTINCT split_part(text, ' ', 1)) FROM conversations WHERE role = 'assistant'
        UNION ALL SELECT 'kind:' || role, count(*) FROM conversations WHERE role IS NOT NULL GROUP BY role""",
    "readability_counts": f"""WITH t AS (SELECT {split_sql('source')} AS split, coalesce(length(text) > 2000 OR contains(text, '#'), false) AS f FROM documents)
        SELECT split, count(*) AS targets, count(*) FILTER (f) AS flagged, count(*) FILTER (NOT f) AS unreviewed FROM t GROUP BY split""",
    "distinct_wordings": "SELECT r_regionkey, r_name FROM region WHERE (SELECT count(DISTINCT r_name) FROM region) = 5",
    "probe_counts": """WITH l AS (SELECT l_orderkey AS o, l_returnflag <> 'R' AS v, l_suppkey % 4 AS s, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_returnflag <> 'R', l_suppkey % 4) AS n FROM lineitem),
        r AS (SELECT o, count(*) AS turns, count(*) FILTER (v) AS vals, count(*) FILTER (v AND n > 1) AS later, count(*) FILTER (v AND n < 3) AS pair,
            max(CASE WHEN n = 1 THEN s END) AS a, max(CASE WHEN n = 2 THEN s END) AS b FROM l GROUP BY o),
        x AS (SELECT *, CASE WHEN pair < 2 THEN 'skipped_no_initial_value_pair' WHEN a = 3 OR b = 3 THEN 'skipped_unsupported_question'
            WHEN a = b THEN 'skipped_repeated_target' ELSE 'paired_source_rows' END AS why FROM r)
        SELECT 'source_rows' AS counter, count(*) AS n FROM x UNION ALL SELECT 'source_rows_with_' || turns || '_turns', count(*) FROM x GROUP BY turns
        UNION ALL SELECT 'source_turns', sum(turns)::BIGINT FROM x UNION ALL SELECT 'source_value_turns', sum(vals)::BIGINT FROM x
        UNION ALL SELECT 'source_value_followups', sum(later)::BIGINT FROM x UNION ALL SELECT why, count(*) FROM x GROUP BY why
        UNION ALL SELECT 'derived_rows', 3 * count(*) FROM x WHERE why = 'paired_source_rows'""",
    "populated_sheets": """WITH s AS (SELECT l_suppkey AS source, l_linenumber AS page FROM lineitem GROUP BY 1, 2
            HAVING bool_or(l_returnflag = 'R' AND l_quantity > 40) AND bool_or(l_returnflag <> 'R' AND l_quantity > 30))
        SELECT source, page FROM s WHERE source IN (SELECT source FROM s GROUP BY source HAVING count(*) >= 2)""",
    "sheet_names": """SELECT l_suppkey AS source, 'N' || (l_partkey % 60) AS name FROM lineitem UNION SELECT l_suppkey, 'N' || (l_orderkey % 90) FROM lineitem""",
    "priority_first": """WITH x AS (SELECT l_orderkey, l_returnflag, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
        SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'A', l_linenumber) = 1""",
    "checked_rows": f"""SELECT doc_id, {split_sql('source')} AS split FROM documents WHERE regexp_matches(text, '[^\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{3000}}]')
        ORDER BY doc_id LIMIT 25""",
    "anchors": f"""WITH t AS (SELECT doc_id, text, chr(10) || ' ' || replace(text, ' ', ' ' || chr(9)) || CASE WHEN doc_id % 3 = 0 THEN 'zzz!' ELSE chr(8195) END AS quote FROM documents)
        SELECT doc_id, contains(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'), ' '), trim(regexp_replace(quote, '{_SPACE}', ' ', 'g'), ' ')) AS found FROM t""",
    "message_places": """WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations)
        SELECT conv_id, coalesce(string_agg(role, ',' ORDER BY n) FILTER (n IN (1, 3, 4)), '') AS roles,
          sha256(coalesce(string_agg(text, chr(10) ORDER BY n) FILTER (n IN (1, 3, 4)), '')) AS text_sha256 FROM m GROUP BY conv_id""",
    "changed_artifacts": """SELECT p_partkey, p_name, CASE WHEN p_partkey % 9 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_partkey % 7 = 0 OR (p_partkey % 9 = 0 AND p_size IS NOT NULL) AS changed_since_start FROM part""",
    "furthest_state": """SELECT user_id, event_id, CASE WHEN event_type <> 'view' THEN floor(value)::BIGINT END AS step FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY coalesce(CASE WHEN event_type <> 'view' THEN floor(value)::BIGINT END, 0) DESC, event_id) = 1""",
    "image_bindings": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'provenance' WHEN p_partkey % 4 = 3 OR (p_partkey % 7 = 0 AND p_partkey % 4 IN (1, 2)) THEN 'fingerprint'
        WHEN p_partkey % 4 = 1 AND p_partkey % 5 = 0 THEN 'form' WHEN p_partkey % 11 = 0 THEN 'images' WHEN p_partkey % 13 = 0 THEN 'differs' END AS fault FROM part""",
    "search_hits": """WITH r AS (SELECT p_brand, p_partkey, ['https://a.test/', 'HTTP://b.test/', 'ftp://c.test/', 'javascript:'][p_partkey % 4 + 1] || repeat(p_name, 60) AS url FROM part
          QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 5)
        SELECT p_brand, p_partkey, length(url[:2048]) AS chars, sha256(url[:2048]) AS url_sha256 FROM r WHERE p_partkey % 4 < 2""",
}
