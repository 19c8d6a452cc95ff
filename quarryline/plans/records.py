"""Queries on records: budgets, lookups, views, grading, series, states and texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import expressions as X
from quarryline.operators import conversations as C
from quarryline.operators import records as R
from quarryline.operators import selection as S
from quarryline.sources.tails import progress

from .common import THE, refuses_sql, table
from .dialogues import _T
from .facts import _BOX, _PADS, _boxes, _pads


def message_trace(spark, d):
    """Traces of conversations under a budget of 400 characters each."""
    t = R.running_budget(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", 400)
    return t.select("conv_id", "turn", F.length("kept").cast("long").alias("n_kept"), X.digest(F.col("kept")).alias("kept_sha256"), "truncated")


def aligned_questions(spark, d):
    a = R.aligned(table(spark, d, "conversations"))
    return a.select("conv_id", "n", X.digest(F.col("question")).alias("question_sha256"), X.digest(F.col("answer")).alias("answer_sha256"))


def graded_metrics(spark, d):
    """Mean score by metric, with a label made for each conversation."""
    t = C.blocked(C.user_turns(table(spark, d, "conversations"))).where("status = 'success'")
    kind = F.element_at(F.array(*map(F.lit, ("value", "refuse", "pins"))), (F.col("conv_id") % 3 + 1).cast("int"))
    made = t.select(kind.alias("type"), "output", F.lit("the").alias("value"), F.array().cast("array<string>").alias("pins"),
                    F.lit("R1.1").alias("query"), F.lit("GND").alias("net"))
    return R.graded(made).groupBy("metric").agg(F.round(F.avg("score"), 6).alias("mean"), F.count("score").alias("n"))


def view_grading(spark, d):
    """Calls that show a region whose left edge is a part's size, against one expected region."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    text = F.format_string("See.<tool_call><function=show_region><parameter=box>[%d, 10, 50, 60]</parameter></function></tool_call>", F.col("p_size"))
    made = p.select("p_partkey", text.alias("output"), F.lit("show_region").alias("function"), F.lit(None).cast("string").alias("label"),
                    F.array(*map(F.lit, (10, 10, 50, 60))).alias("box"), F.lit(0.5).alias("min_iou"))
    return R.view_graded(made).select("p_partkey", "score")


def rollout_totals(spark, d):
    t = C.blocked(C.user_turns(table(spark, d, "conversations")))
    c = t.groupBy("conv_id").agg(F.bool_and(F.col("status") == "success").alias("p"), F.count("*").alias("n"))
    return c.agg(F.count("*").alias("n_rollouts"), F.count_if("p").alias("n_passed"), F.bool_and("p").alias("all_passed"), F.sum("n").alias("n_turns"))


def diagnostic_cap(spark, d):
    c = table(spark, d, "conversations").select("role", "conv_id", "turn", "text")
    return R.capped(c, ["role"], [F.col("conv_id"), F.col("turn")], 3, "text", 40)


def series_extrema(spark, d):
    s = R.series(table(spark, d, "events"), "event_type", ["ts", "event_id"], "value")
    return s.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("least", "most", "last")))


def newest_valid(spark, d):
    e = table(spark, d, "events").where("value > 20")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def approval_ttl(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return R.token_states(e, "user_id", "ts", "event_id", 86400).groupBy("state").agg(F.count("*").alias("n"))


def job_states(spark, d):
    code = F.when(F.col("event_id") % 4 == 0, 0).when(F.col("event_id") % 4 == 1, R.AGAIN).when(F.col("event_id") % 4 == 2, 1)
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind"), R.job_state(code).alias("state")).agg(F.count("*").alias("n"))


def progress_tail(spark, d):
    """The last progress that a user's log reports for a run of 26 steps; each event wrote a mark, and some are of other bars."""
    e = table(spark, d, "events")
    mark = F.format_string(" 12%%| %d/%d [00:01<00:%02d,  %d.5s/it]\r", F.col("event_id") % 97, F.when(F.length("event_type") % 2 == 0, 26).otherwise(27), F.col("event_id") % 60, F.col("event_id") % 9)
    log = e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ts", "event_id", mark.alias("m")))).getField("m"), "").alias("log"))
    found = progress(F.col("log"), F.lit(26))
    return log.select("user_id", found["step"].alias("step"), found["remaining"].alias("remaining"), found["rate"].alias("rate"))


def step_budget(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_rows"))
    return n.withColumn("n_steps", R.steps(F.col("n_rows"), 4, 4, 3, 1000))


def seeded_ranges(spark, d):
    """Twelve sources in seeded order, the first six and the next six."""
    top = S.seeded_top(table(spark, d, "documents"), "source", 12, 7)
    return top.select("source", F.when(F.col("place") <= 6, "first").otherwise("next").alias("arm"))


def content_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("real-"), F.substring(X.digest(F.col("text")), 1, 16)).alias("content_id"))


def union_views(spark, d):
    """Documents and benchmark items as one bag; a view lacks what it has no column for."""
    a = table(spark, d, "documents").select("doc_id", "lang")
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_ids"))


def net_choice(spark, d):
    """For each source one net: named before anonymous ones, then fewest pads, then by name."""
    n = _pads(spark, d).groupBy("source", "net").agg(F.count("*").alias("n_pads"))
    return S.first_of(n, ["source"], [F.col("net").startswith("N$"), F.col("n_pads"), F.col("net")])


def endpoint_budget(spark, d):
    """Questions on nets of several pages, asked with the net's pads only and with all of its source:
    how many exceed a budget of 40 tokens, at 8 for each pad."""
    p = _pads(spark, d)
    net = p.groupBy("source", "net").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("focused")).where("pages > 1")
    whole = p.groupBy("source").agg(F.count("*").alias("full"))
    long = net.join(whole, "source").select("source", F.inline(F.array(*(
        F.struct(F.lit(v).alias("variant"), (F.col(v) * 8).alias("tokens")) for v in ("focused", "full")))))
    return long.groupBy("source", "variant").agg(F.count("*").alias("n"), F.count_if(F.col("tokens") > 40).alias("over"))


def affine_points(spark, d):
    x, y = R.turned(F.col("x1"), F.col("y1"), F.col("label") * 9, F.col("vec_id") % 2 == 1)
    return _boxes(spark, d).select("vec_id", (F.round(x, 4) + 0.0).alias("x"), (F.round(y, 4) + 0.0).alias("y"))


def calculator(spark, d):
    op = F.element_at(F.array(*map(F.lit, ("add", "sub", "mul", "div"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    a, b = F.col("p_retailprice"), (F.col("p_size") % 5).cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(R.calculated(op, a, b), 4).alias("result"))


def value_questions(spark, d):
    """The reference that a question for a value names."""
    name = F.concat(F.lit("R"), F.col("p_partkey").cast("string"))
    q = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("What is the value of "), name, F.lit("?"))).when(
        F.col("p_size") % 3 == 1, F.concat(F.lit("What value is "), name, F.lit("?"))).otherwise(F.concat(F.lit("Where is "), name, F.lit("?")))
    return table(spark, d, "part").select("p_partkey", F.regexp_extract(q, r"^What (?:is the value of|value is) ([A-Z][A-Z0-9_$-]*)\?$", 1).alias("ref"))


def image_masks(spark, d):
    """Image paths in messages replaced by a mark."""
    text = F.concat(F.lit("See images/"), F.substring(X.digest(F.col("p_name")), 1, 12), F.lit(".png and "), "p_name")
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(text, r"images/[0-9a-f]+\.png", "<image>").alias("text"))


def title_cleanup(spark, d):
    raw = F.concat(F.lit("Board_"), F.col("p_name"), F.lit("-PCB"))
    title = F.regexp_replace(F.regexp_replace(raw, r"^Board_|-PCB$", ""), r"[_-]+", " ")
    return table(spark, d, "part").select("p_partkey", title.alias("title"), F.replace(F.url_encode(title), F.lit("+"), F.lit("%20")).alias("quoted"))


def label_lookup(spark, d):
    """Names of nations, regions and brands, looked up among brands, then regions, then nations."""
    named = lambda t, n, i: table(spark, d, t).select(F.col(n).alias("name"), F.col(i).cast("string").alias("id"))
    brand, region, nation = named("part", "p_brand", "p_partkey"), named("region", "r_name", "r_regionkey"), named("nation", "n_name", "n_nationkey")
    asked = nation.union(region).select(F.lower("name").alias("asked")).union(spark.createDataFrame([("Brand#13",), ("nowhere",)], "asked string")).distinct()
    return R.prioritised(asked, "asked", [brand, region, nation])


def cardinality(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return R.matches(c, o, "k").groupBy("matches").agg(F.count("*").alias("n"))


def view_agreement(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    a = p.where("p_size < 40").select("p_partkey", "p_brand")
    b = p.where("p_size > 10").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "other").otherwise(F.col("p_brand")).alias("p_brand"))
    return R.agreement(a, b, ["p_partkey"], ["p_brand"]).groupBy("verdict").agg(F.count("*").alias("n"))


def totals_recomputed(spark, d):
    """Orders by whether their stored number of lines, here from the first line, is the one counted."""
    i = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("stored"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(i, "l_orderkey", "left")
    verdict = F.when(F.col("n").isNull(), "no lines").when(F.col("n") == F.col("stored"), "same").otherwise("differs")
    return o.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def unexpected_residents(spark, d):
    """Suppliers that no row of an approved list (nation, most: what its customers have on average) covers."""
    approved = table(spark, d, "customer").groupBy("c_nationkey").agg((F.sum(F.floor(F.col("c_acctbal") * 100)) / F.count("*") / 100).alias("most"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return s.join(approved, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("s_acctbal") <= F.col("most")), "left_anti").select("s_suppkey")


QUERIES = {f.__name__: f for f in (
    message_trace, aligned_questions, graded_metrics, view_grading, rollout_totals, diagnostic_cap, series_extrema, newest_valid, approval_ttl, job_states,
    progress_tail, step_budget, seeded_ranges, content_ids, union_views, net_choice, endpoint_budget, affine_points, calculator,
    value_questions, image_masks, title_cleanup, label_lookup, cardinality, view_agreement, totals_recomputed, unexpected_residents)}

_PIN = r"(?:^|[^\w$-])[A-Z][A-Z0-9_$-]*\.[A-Z0-9_$+-]+(?:$|[^\w$+-])"
ORACLES = {
    "message_trace": """WITH w AS (SELECT conv_id, turn, text, greatest(0, 400 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS l FROM conversations)
        SELECT conv_id, turn, length(substr(text, 1, l)) AS n_kept, sha256(substr(text, 1, l)) AS kept_sha256, length(text) > l AS truncated FROM w""",
    "aligned_questions": """WITH n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS n FROM conversations WHERE role IN ('user', 'assistant'))
        SELECT conv_id, n, sha256(max(text) FILTER (role = 'user')) AS question_sha256, sha256(max(text) FILTER (role = 'assistant')) AS answer_sha256
        FROM n GROUP BY 1, 2 HAVING count(*) FILTER (role = 'assistant') > 0""",
    "graded_metrics": f"""WITH {_T}, s AS (SELECT conv_id % 3 AS k, output FROM t WHERE status = 'success'), g AS (SELECT CASE k WHEN 0 THEN 'value_exact' WHEN 1 THEN 'refuse_acc' ELSE 'pins_f1' END AS metric,
          CASE k WHEN 0 THEN regexp_matches(output, '{THE}', 'i') WHEN 1 THEN {refuses_sql('output')}
            ELSE NOT regexp_matches(output, '{_PIN}') AND regexp_matches(output, 'isn''t connected|not connected|floating|nothing', 'i') END AS hit FROM s)
        SELECT metric, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END), 6) AS mean, count(*) AS n FROM g GROUP BY 1""",
    "view_grading": """WITH a AS (SELECT p_partkey, p_size, (50 - greatest(p_size, 10)) * 50 AS i FROM part)
        SELECT p_partkey, CASE WHEN p_size < 50 AND i / ((50 - p_size) * 50 + 2000 - i)::DOUBLE >= 0.5 THEN 1.0::DOUBLE ELSE 0 END AS score FROM a""",
    "rollout_totals": f"""WITH {_T}, c AS (SELECT conv_id, bool_and(status = 'success') AS p, count(*) AS n FROM t GROUP BY 1)
        SELECT count(*) AS n_rollouts, count(*) FILTER (p) AS n_passed, bool_and(p) AS all_passed, sum(n)::BIGINT AS n_turns FROM c""",
    "diagnostic_cap": """SELECT role, conv_id, turn, substr(text, 1, 40) AS text, length(text) > 40 AS truncated FROM conversations
        QUALIFY row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) <= 3""",
    "series_extrema": "SELECT event_type, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(last(value ORDER BY ts, event_id), 6) AS last FROM events GROUP BY 1",
    "newest_valid": "SELECT user_id, last(event_id ORDER BY ts, event_id) AS event_id FROM events WHERE value > 20 GROUP BY 1",
    "approval_ttl": """WITH w AS (SELECT ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
        SELECT CASE WHEN n IS NULL THEN 'open' WHEN n <= ts + INTERVAL 86400 SECOND THEN 'used' ELSE 'expired' END AS state, count(*) AS n FROM w GROUP BY 1""",
    "job_states": "SELECT event_type AS kind, CASE event_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'queued' WHEN 2 THEN 'failed' ELSE 'running' END AS state, count(*) AS n FROM events GROUP BY 1, 2",
    "progress_tail": r"""WITH l AS (SELECT user_id, string_agg(format(' 12%| {}/{} [00:01<00:{:02d},  {}.5s/it]', event_id % 97, CASE WHEN length(event_type) % 2 = 0 THEN 26 ELSE 27 END, event_id % 60, event_id % 9) || chr(13), ''
          ORDER BY ts, event_id) AS log FROM events GROUP BY 1), m AS (SELECT user_id, list_last(regexp_extract_all(log, '\d+/26 \[[^\]]*\]')) AS m FROM l)
        SELECT user_id, regexp_extract(m, '^(\d+)/', 1)::BIGINT AS step, regexp_extract(m, '<([\d:]+)', 1) AS remaining, regexp_extract(m, ',\s*([\d.]+)', 1) || ' s/it' AS rate FROM m""",
    "step_budget": "SELECT source, count(*) AS n_rows, least(1000, 3 * ceil(count(*) / 16.0))::BIGINT AS n_steps FROM documents GROUP BY 1",
    "seeded_ranges": """WITH s AS (SELECT DISTINCT source FROM documents), o AS (SELECT source, row_number() OVER (ORDER BY sha256('7:' || source), source) AS place FROM s)
        SELECT source, CASE WHEN place <= 6 THEN 'first' ELSE 'next' END AS arm FROM o WHERE place <= 12""",
    "content_ids": "SELECT doc_id, 'real-' || substr(sha256(text), 1, 16) AS content_id FROM documents",
    "union_views": "WITH u AS (SELECT doc_id, lang FROM documents UNION ALL SELECT item_id, NULL FROM benchmark) SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS n_ids FROM u GROUP BY 1",
    "net_choice": f"""WITH {_PADS}, n AS (SELECT source, net, count(*) AS n_pads FROM p GROUP BY 1, 2)
        SELECT source, net, n_pads FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY net LIKE 'N$%', n_pads, net) = 1""",
    "endpoint_budget": f"""WITH {_PADS}, n AS (SELECT source, net, count(*) AS focused FROM p GROUP BY 1, 2 HAVING count(DISTINCT page) > 1), w AS (SELECT source, count(*) AS whole FROM p GROUP BY 1),
        l AS (SELECT source, 'focused' AS variant, focused * 8 AS t FROM n UNION ALL SELECT source, 'full', whole * 8 FROM n JOIN w USING (source))
        SELECT source, variant, count(*) AS n, count(*) FILTER (t > 40) AS over FROM l GROUP BY 1, 2""",
    "affine_points": f"""WITH {_BOX} SELECT vec_id, round(CASE WHEN vec_id % 2 = 1 THEN -1 ELSE 1 END * (x1 * cos(radians(label * 9)) - y1 * sin(radians(label * 9))), 4) + 0.0::DOUBLE AS x,
        round(x1 * sin(radians(label * 9)) + y1 * cos(radians(label * 9)), 4) + 0.0::DOUBLE AS y FROM b""",
    "calculator": """SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN p_retailprice + p_size % 5 WHEN 1 THEN p_retailprice - p_size % 5 WHEN 2 THEN p_retailprice * (p_size % 5)
        ELSE p_retailprice / nullif((p_size % 5)::DOUBLE, 0) END, 4) AS result FROM part""",
    "value_questions": "SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN 'R' || p_partkey ELSE '' END AS ref FROM part",
    "image_masks": "SELECT p_partkey, 'See <image> and ' || p_name AS text FROM part",
    "title_cleanup": "SELECT p_partkey, regexp_replace(p_name, '[_-]+', ' ', 'g') AS title, url_encode(regexp_replace(p_name, '[_-]+', ' ', 'g')) AS quoted FROM part",
    "label_lookup": """WITH pool AS (SELECT upper(p_brand) AS n, 0 AS rank, p_partkey::VARCHAR AS id FROM part UNION ALL SELECT upper(r_name), 1, r_regionkey::VARCHAR FROM region
          UNION ALL SELECT upper(n_name), 2, n_nationkey::VARCHAR FROM nation), best AS (SELECT n, rank, id FROM pool QUALIFY row_number() OVER (PARTITION BY n ORDER BY rank, id) = 1),
        asked AS (SELECT lower(n_name) AS asked FROM nation UNION SELECT lower(r_name) FROM region UNION SELECT unnest(['Brand#13', 'nowhere']))
        SELECT asked, rank, id FROM asked LEFT JOIN best ON upper(asked) = n""",
    "cardinality": """WITH n AS (SELECT c_custkey, count(o_custkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
        SELECT CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'several' END AS matches, count(*) AS n FROM n GROUP BY 1""",
    "view_agreement": """SELECT CASE WHEN p_size <= 10 THEN 'a only' WHEN p_size >= 40 THEN 'b only' WHEN p_partkey % 7 = 0 THEN 'differs' ELSE 'same' END AS verdict, count(*) AS n FROM part GROUP BY 1""",
    "totals_recomputed": """WITH i AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS s FROM lineitem GROUP BY 1)
        SELECT CASE WHEN n IS NULL THEN 'no lines' WHEN n = s THEN 'same' ELSE 'differs' END AS verdict, count(*) AS n FROM orders LEFT JOIN i ON l_orderkey = o_orderkey GROUP BY 1""",
    "unexpected_residents": """SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM (SELECT c_nationkey, sum(floor(c_acctbal * 100)::BIGINT)::DOUBLE / count(*) / 100 AS most FROM customer GROUP BY 1)
        WHERE c_nationkey = s_nationkey AND s_acctbal <= most)""",
}
