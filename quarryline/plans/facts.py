"""Queries on evidence relations, text rules, geometry, telemetry and JSON, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import expressions as X
from quarryline.functions import parsers as P
from quarryline.operators import evidence as E
from quarryline.operators import ledger as L
from quarryline.operators import selection as S

from .common import refuses_sql, table


# Line items stand in for a netlist: an order is a net, a part with its line is a pad, a supplier a page.
def _pads(spark, d, *keys):
    """keys: those that all else groups by, if the rows are to be dealt by them."""
    i = table(spark, d, "lineitem")
    pads = i.select((F.col("l_suppkey") % 20).alias("source"), F.col("l_linenumber").cast("long").alias("page"),
                    F.when(F.col("l_orderkey") % 10 == 0, F.concat(F.lit("N$"), "l_orderkey")).otherwise(F.col("l_orderkey").cast("string")).alias("net"),
                    F.concat(F.lit("P"), "l_partkey", F.lit("."), "l_linenumber").alias("pad"))
    return (S.dealt(pads, i.count(), *keys) if keys else pads).distinct()


def native_pin_resolution(spark, d):
    """Pin references resolved by their part's connects: odd parts have two pads to a pin."""
    i = table(spark, d, "lineitem")
    refs = i.select((F.col("l_suppkey") % 20).alias("source"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("net"),
                    F.concat(F.lit("P"), "l_partkey").alias("part"), F.lit("G").alias("gate"), F.col("l_linenumber").cast("string").alias("pin"))
    parts = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("part"), "p_partkey")
    # A library has the pins that its parts' references name, up to seven.
    pins = refs.select("source", "part", "gate", F.col("pin").cast("int").alias("n")).where("n <= 7").distinct().join(parts, "part")
    connects = pins.select("source", "part", "gate", F.col("n").cast("string").alias("pin"), F.when(
        F.col("p_partkey") % 2 == 1, F.concat(F.lit("A"), "n", F.lit("  B"), "n")).otherwise(F.concat(F.lit("A"), "n")).alias("pads"))
    nets = E.members(E.net_pads(refs, connects), ["source", "page", "net"])
    return nets.where("n_pads between 2 and 8").select("source", "page", "net", "n_pads", "pads")


def net_members(spark, d):
    return E.members(_pads(spark, d), ["source", "net"])


def pad_net(spark, d):
    return E.pad_net(_pads(spark, d), ["source"])


def pad_conflicts(spark, d):
    return E.conflicts(_pads(spark, d), ["source"])


def trace(spark, d):
    p = _pads(spark, d)
    return E.traced(p, p, ["source"])


def point_status(spark, d):
    p = _pads(spark, d).select("page", "pad", "net")
    q = table(spark, d, "part").select(F.lit(1).cast("long").alias("page"), F.concat(F.lit("P"), "p_partkey", F.lit(".1")).alias("pad"))
    return E.answered(q, E.pad_net(p, ["page"])).groupBy("status").agg(F.count("*").alias("n"))


def cross_page_nets(spark, d):
    return E.across_pages(_pads(spark, d, "source", "net"))


def source_complexity(spark, d):
    return E.complexity(_pads(spark, d))


def eligible_targets(spark, d):
    """Sources with two valued parts or more and a net of two to eight well-formed pads."""
    p = _pads(spark, d)
    nets = p.groupBy("source", "net").agg(F.count("*").alias("n"), F.bool_and(F.col("pad").rlike(r"^[A-Z][A-Z0-9_$-]*\.[A-Z0-9_$+-]+$")).alias("ok")).where("ok and n between 2 and 8")
    parts = p.groupBy("source").agg(F.countDistinct(F.substring_index("pad", ".", 1)).alias("n_parts")).where("n_parts >= 2")
    return nets.groupBy("source").agg(F.count("*").alias("n_nets")).join(parts, "source")


def priority_top2(spark, d):
    """Two parts of each size, brand #13 first, then by name and key."""
    p = table(spark, d, "part").select("p_size", "p_partkey", "p_brand", "p_name")
    return S.first_of(p, ["p_size"], [~F.col("p_brand").endswith("#13"), F.col("p_name"), F.col("p_partkey")], 2)


def value_token_match(spark, d):
    """Documents that state a benchmark item's first word as a value, by that word, and six values with signs,
    blanks and points in them."""
    docs = table(spark, d, "documents").select("text")
    # A word is stated where a run of word characters equals it, so the tokens of a text meet all words in a join.
    words = table(spark, d, "benchmark").select(F.lower(F.regexp_extract("text", r"(?U)\w+", 0)).alias("value")).where("value <> ''").distinct()
    token = F.regexp_extract_all("text", F.lit(r"(?U)(?<![\w.+-])\w+(?!\w|\.\d)"), F.lit(0))
    said = docs.select(F.explode(F.array_distinct(F.transform(token, F.lower))).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    # Each of the others is one literal pattern, and all are counted in one pass.
    signs = ("de la", "c++", "3.5", "version 3", "4.0", "a-b")
    counts = docs.agg(*(F.count_if(X.states_value(F.col("text"), F.lit(v))).alias(f"n{k}") for k, v in enumerate(signs)))
    rest = counts.select(F.inline(F.array(*(F.struct(F.lit(v).alias("value"), F.col(f"n{k}").alias("n")) for k, v in enumerate(signs)))))
    return said.join(words, "value", "left_semi").unionAll(rest)


def keyword_refusal(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count_if(X.refuses(F.col("text"))).alias("n_refusals"), F.count("*").alias("n"))


def think_strip(spark, d):
    c = table(spark, d, "conversations").where("text is not null")
    made = F.concat(F.lit(" <think>a\nb</THINK> "), "text", F.lit("\n"), F.when(F.col("turn") % 2 == 0, "<Think>open").otherwise(""))
    return c.select("conv_id", "turn", X.digest(X.final_answer(made)).alias("answer_sha256"))


def pin_f1(spark, d):
    """Pins named in an answer made of a source's pads against the pads of its nets."""
    nets = _pads(spark, d).groupBy("source", "net").agg(F.array_sort(F.collect_set("pad")).alias("gold"))
    said = F.concat(F.array_join(F.slice("gold", 1, 2), ", "), F.lit(" and P0.9; not P1.1x."))
    pred = X.pins(said)
    score = X.pin_f1(pred, F.col("gold"), said, F.lit("P0.9"), F.lit("P1.1"))
    return nets.select("source", "net", F.round(score, 6).alias("f1"))


def contextual_refusal(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    name = F.concat(F.lit("R"), "p_partkey")
    pad = F.concat(name, F.lit(".1"))
    measured, k = F.col("p_partkey") % 2 == 1, F.col("p_size") % 8
    question = F.when(measured, F.concat(F.lit("What measured voltage was observed at "), pad, F.lit(" during a powered bench test?"))).otherwise(
        F.concat(F.lit("What value is "), name, F.lit(", and what does it connect to?")))
    good = F.when(measured, F.concat(F.lit("In the schematic, no bench measurement for "), pad, F.lit(" is supplied"))).otherwise(
        F.concat(name, F.lit(" is not shown in the schematic")))
    second = F.when(measured, "I cannot infer a measured voltage").otherwise("its value and connections are not shown")
    answer = F.when(k == 0, F.concat(good, F.lit("."))).when(k == 1, F.concat(good, F.lit(". But it is 5V."))).when(k == 2, "").when(
        k == 3, F.concat(good, F.lit(", so "), second)).when(k == 4, second).when(k == 5, F.concat(good, F.lit("\n\t\n"), good)).when(
        k == 6, F.concat(F.lit("<think>no</think>"), F.upper(good))).otherwise(F.replace(good, name, F.lit("RX")))  # no part has this name
    return p.select("p_partkey", P.contextual_refusal(question, answer).alias("v")).select("p_partkey", "v.*")


def tool_call_parse(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    text = F.format_string("See.<tool_call><function=show_region><parameter=box>[%d, 10, 50, 60]</parameter></function></tool_call>", F.col("p_size"))
    return p.select("p_partkey", P.parsed_calls(text).alias("v")).select("p_partkey", "v.*")


def strict_json(spark, d):
    """Events by what is wrong with a line made of their props."""
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 4 == 0, F.concat("props", F.lit(" x"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(
        F.col("event_id") % 4 == 2, F.lit('{"a":1,"a":2}')).otherwise(F.col("props"))
    return e.groupBy(F.coalesce(P.strict_json_error(line), F.lit("ok")).alias("verdict")).agg(F.count("*").alias("n"))


def canonical_digest(spark, d):
    return table(spark, d, "events").select("event_id", F.sha2(P.canonical_udf("C2")("props"), 256).alias("digest"))


def metrics_rollup(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("seconds"), F.when(
        F.col("event_id") % 89 != 0, F.length("props")).cast("long").alias("tokens"))
    return L.poison_sums(e, "user_id", ["seconds", "tokens"], "event_type")


def _jobs(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("value").alias("elapsed"), F.col("ts").alias("created"))


def class_usage(spark, d):
    j = _jobs(spark, d)
    return L.class_usage(j, j.groupBy("kind").agg((F.count("*") * 100.0).alias("budget")))


def fair_queue(spark, d):
    j = _jobs(spark, d)
    usage = L.class_usage(j.where("id % 2 = 0"), j.groupBy("kind").agg((F.count("*") * 100.0).alias("budget")))
    return L.fair_next(j.where("id % 2 = 1"), usage).select("id", "kind", "share")


def event_fold(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", F.when(F.col("event_id") % 3 == 0, "finished").otherwise("attempted").alias("event"))
    return L.folded(e, "user_id").groupBy("state").agg(F.count("*").alias("n"))


def _boxes(spark, d):
    """Boxes within 0 to 1000 from four dimensions of each vector."""
    n = [F.floor(F.pmod(F.abs(F.col("embedding")[i].cast("double")) * 10000, F.lit(500.0))).cast("long") for i in range(4)]
    return table(spark, d, "embeddings").select("vec_id", "label", n[0].alias("x1"), n[1].alias("y1"), (n[0] + n[2] + 1).alias("x2"), (n[1] + n[3] + 1).alias("y2"))


def _pairs(spark, d):
    """All pairs of boxes of a page; pages hold 40 vectors each, as drawings hold a bounded number of parts."""
    b = _boxes(spark, d).withColumn("page", F.floor(F.col("vec_id") / 40))
    c = b.select("page", F.col("vec_id").alias("other"), *(F.col(k).alias(f"o{k}") for k in ("x1", "y1", "x2", "y2")))
    return b.join(c, "page").where("vec_id < other")


_A, _B = ([F.col, ("x1", "y1", "x2", "y2")], [F.col, ("ox1", "oy1", "ox2", "oy2")])


def box_iou(spark, d):
    a, b = ([f(k) for k in ks] for f, ks in (_A, _B))
    return _pairs(spark, d).select("vec_id", "other", F.round(X.iou(a, b), 6).alias("iou"))


def disjoint_pairs(spark, d):
    """For each box the first later one of its page that is apart from it in a small union."""
    near = _pairs(spark, d)
    x, y = ([f(k) for k in ks] for f, ks in (_A, _B))
    fit = near.where((X.iou(x, y) == 0) & (X.area(X.union_box(x, y)) <= 250000))
    return fit.groupBy("vec_id").agg(F.min("other").alias("other"))


def coincident_anchors(spark, d):
    p = _pairs(spark, d)
    return p.where(X.coincident(F.col("x1"), F.col("y1"), F.col("ox1"), F.col("oy1"), F.col("label") * 9, 200.0, 120.0)).select("vec_id", "other")


def bounding_box(spark, d):
    b = _boxes(spark, d)
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(1000), c)).cast("long")
    return b.groupBy("label").agg(clamp(F.min("x1") - 5).alias("x1"), clamp(F.min("y1") - 5).alias("y1"), clamp(F.max("x2") + 5).alias("x2"), clamp(F.max("y2") + 5).alias("y2"))


def physics_exact(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return p.select("p_partkey", P.exact_fraction(F.lit("ohms_law_current"), F.col("p_size").cast("string"), (F.col("p_partkey") % 48 + 1).cast("string")).alias("amps"))


def html_titles(spark, d):
    t = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return table(spark, d, "pages").select("page_id", t.alias("title"), F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0))).cast("long").alias("n_links"))


def url_allowlist(spark, d):
    """Pages by whether their address has an allowed host and neither query nor fragment."""
    host, query = F.try_parse_url("url", F.lit("HOST")), F.try_parse_url("url", F.lit("QUERY"))
    ok = F.col("url").startswith("https://") & host.rlike(r"(^|\.)example\.(com|net)$") & query.isNull() & F.try_parse_url("url", F.lit("REF")).isNull()
    return table(spark, d, "pages").groupBy(F.coalesce(ok, F.lit(False)).alias("allowed")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    native_pin_resolution, net_members, pad_net, pad_conflicts, trace, point_status, cross_page_nets, source_complexity, eligible_targets,
    priority_top2, value_token_match, keyword_refusal, think_strip, pin_f1, contextual_refusal, tool_call_parse, strict_json,
    canonical_digest, metrics_rollup, class_usage, fair_queue, event_fold, box_iou, disjoint_pairs, coincident_anchors, bounding_box,
    physics_exact, html_titles, url_allowlist)}

_PADS = """p AS (SELECT DISTINCT l_suppkey % 20 AS source, l_linenumber::BIGINT AS page, CASE WHEN l_orderkey % 10 = 0 THEN 'N$' || l_orderkey ELSE l_orderkey::VARCHAR END AS net,
    'P' || l_partkey || '.' || l_linenumber AS pad FROM lineitem)"""
_JOBS = "j AS (SELECT event_id AS id, event_type AS kind, value AS elapsed, ts AS created FROM events), g AS (SELECT kind, count(*) * 100.0::DOUBLE AS budget FROM j GROUP BY 1)"
_N = [f"floor((abs(embedding[{i}]::DOUBLE) * 10000) % 500.0::DOUBLE)::BIGINT" for i in (1, 2, 3, 4)]
_BOX = f"b AS (SELECT vec_id, label, {_N[0]} AS x1, {_N[1]} AS y1, {_N[0]} + {_N[2]} + 1 AS x2, {_N[1]} + {_N[3]} + 1 AS y2 FROM embeddings)"
_IOU = "greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0)"
_AREA = "((a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1))"
ORACLES = {
    "native_pin_resolution": """WITH r AS (SELECT l_suppkey % 20 AS source, l_linenumber AS page, l_orderkey AS net, l_partkey AS k FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_linenumber BETWEEN 1 AND 7),
        x AS (SELECT DISTINCT source, page, net, 'P' || k || '.' || unnest(CASE WHEN k % 2 = 1 THEN ['A' || page, 'B' || page] ELSE ['A' || page] END) AS pad FROM r)
        SELECT source, page, net, count(*) AS n_pads, string_agg(pad, ' ' ORDER BY pad) AS pads FROM x GROUP BY 1, 2, 3 HAVING count(*) BETWEEN 2 AND 8""",
    "net_members": f"WITH {_PADS} SELECT source, net, string_agg(DISTINCT pad, ' ' ORDER BY pad) AS pads, count(DISTINCT pad) AS n_pads FROM p GROUP BY 1, 2",
    "pad_net": f"WITH {_PADS} SELECT source, pad, min(net) AS net FROM p GROUP BY 1, 2 HAVING count(DISTINCT net) = 1",
    "pad_conflicts": f"WITH {_PADS} SELECT source, pad, count(DISTINCT net) AS n_nets FROM p GROUP BY 1, 2 HAVING count(DISTINCT net) > 1",
    "trace": f"""WITH {_PADS}, q AS (SELECT DISTINCT source, pad FROM p)
        SELECT p.source, p.pad, p.net, o.pad AS other FROM p JOIN q ON p.source = q.source AND p.pad = q.pad JOIN p o ON o.source = p.source AND o.net = p.net WHERE p.pad <> o.pad""",
    "point_status": f"""WITH {_PADS}, n AS (SELECT page, pad FROM p GROUP BY 1, 2 HAVING count(DISTINCT net) = 1), q AS (SELECT 'P' || p_partkey || '.1' AS pad FROM part)
        SELECT CASE WHEN n.pad IS NULL THEN 'not_recorded_on_page' ELSE 'source_verified' END AS status, count(*) AS n FROM q LEFT JOIN n ON n.page = 1 AND n.pad = q.pad GROUP BY 1""",
    "cross_page_nets": f"WITH {_PADS} SELECT source, net, count(DISTINCT page) AS n_pages, count(*) AS n_endpoints FROM p WHERE net NOT LIKE 'N$%' GROUP BY 1, 2 HAVING count(DISTINCT page) > 1",
    "source_complexity": f"""WITH {_PADS}, s AS (SELECT source, count(*) AS n FROM (SELECT source, net FROM p GROUP BY 1, 2 HAVING count(DISTINCT page) > 1) GROUP BY 1)
        SELECT source, count(DISTINCT split_part(pad, '.', 1)) AS n_parts, count(*) AS n_pads, count(DISTINCT net) AS n_nets, coalesce(min(s.n), 0) AS n_shared FROM p LEFT JOIN s USING (source) GROUP BY source""",
    "eligible_targets": f"""WITH {_PADS}, n AS (SELECT source, net FROM p GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 8 AND bool_and(regexp_matches(pad, '^[A-Z][A-Z0-9_$-]*\\.[A-Z0-9_$+-]+$')))
        SELECT source, count(*) AS n_nets, (SELECT count(DISTINCT split_part(pad, '.', 1)) FROM p WHERE p.source = n.source) AS n_parts FROM n GROUP BY source""",
    "priority_top2": "SELECT p_size, p_partkey, p_brand, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY NOT p_brand LIKE '%#13', p_name, p_partkey) <= 2",
    # A run of word characters, points and signs states the word that it begins with, unless a point and a digit follow.
    "value_token_match": r"""WITH v(value, re) AS (VALUES ('de la','de\s*la'), ('c++','c\+\+'), ('3.5','3\.5'), ('version 3','version\s*3'), ('4.0','4\.0'), ('a-b','a-b')),
          b AS (SELECT DISTINCT lower(regexp_extract(text, '[\pL\pN\pM_]+')) AS value FROM benchmark), r AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[\pL\pN\pM_.+-]+'))) AS r FROM documents),
          t AS (SELECT DISTINCT doc_id, lower(regexp_extract(r, '^([\pL\pN\pM_]+)(?:$|[+-]|\.(?:$|[^\pN]))', 1)) AS value FROM r)
        SELECT value, count(*) AS n FROM t WHERE value <> '' AND value IN (SELECT value FROM b) GROUP BY 1
        UNION ALL SELECT value, count(*) FILTER (regexp_matches(text, '(?:^|[^\pL\pN\pM_.+-])' || re || '(?:$|[^\pL\pN\pM_.]|\.(?:$|[^\pN]))', 'i')) FROM documents, v GROUP BY 1""",
    "keyword_refusal": f"SELECT lang, count(*) FILTER ({refuses_sql("text")}) AS n_refusals, count(*) AS n FROM documents GROUP BY 1",
    "think_strip": r"SELECT conv_id, turn, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS answer_sha256 FROM conversations WHERE text IS NOT NULL",
    "pin_f1": f"""WITH {_PADS}, n AS (SELECT source, net, list_sort(list(DISTINCT pad)) AS gold FROM p GROUP BY 1, 2), m AS (SELECT *, gold[1:2] AS said FROM n)
        SELECT source, net, round(2.0::DOUBLE * len(said) / (len(said) + len(gold)), 6) AS f1 FROM m""",
    "contextual_refusal": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'measurement' ELSE 'missing_component' END AS kind,
        'R' || p_partkey || CASE WHEN p_partkey % 2 = 1 THEN '.1' ELSE '' END AS subject, p_size % 8 IN (0, 3, 6) AS accepted,
        CASE WHEN p_size % 8 IN (0, 3, 6) THEN 'restricted_grammar_match' WHEN p_size % 8 = 2 THEN 'empty_answer' WHEN p_size % 8 = 4 THEN 'no_grounded_absence_statement'
        ELSE 'unrecognized_or_unsupported_claim' END AS reason FROM part""",
    "tool_call_parse": """SELECT p_partkey, CASE WHEN p_size < 50 THEN 'See.' END AS content,
        CASE WHEN p_size < 50 THEN '[{"arguments": {"box": [' || p_size || ', 10, 50, 60]}, "name": "show_region"}]' END AS calls,
        CASE WHEN p_size >= 50 THEN 'unknown function or bad arguments' END AS error FROM part""",
    "strict_json": """SELECT CASE event_id % 4 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not an object' WHEN 2 THEN 'repeated field' ELSE 'ok' END AS verdict, count(*) AS n
        FROM events GROUP BY 1""",
    "canonical_digest": "SELECT event_id, sha256(regexp_replace(props::VARCHAR, '([:,]) +', '\\1', 'g')) AS digest FROM events",
    "metrics_rollup": """WITH e AS (SELECT user_id, event_type, CASE WHEN event_id % 97 <> 0 THEN value END AS s, CASE WHEN event_id % 89 <> 0 THEN length(props) END AS t FROM events)
        SELECT user_id, count(*) AS n_steps, CASE WHEN count(s) = count(*) THEN round(sum(s), 4) END AS seconds, CASE WHEN count(t) = count(*) THEN sum(t)::BIGINT END AS tokens,
        CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) ELSE 'mixed' END AS scope FROM e GROUP BY 1""",
    "class_usage": f"WITH {_JOBS}, u AS (SELECT kind, round(sum(elapsed), 4) AS used FROM j GROUP BY 1) SELECT kind, used, round(used / budget, 6) AS share FROM u JOIN g USING (kind)",
    "fair_queue": f"""WITH {_JOBS}, u AS (SELECT kind, round(round(sum(elapsed), 4) / min(budget), 6) AS share FROM j JOIN g USING (kind) WHERE id % 2 = 0 GROUP BY 1)
        SELECT id, kind, share FROM j JOIN u USING (kind) WHERE id % 2 = 1 ORDER BY share, created, id LIMIT 1""",
    "event_fold": """WITH f AS (SELECT user_id, count(*) FILTER (event_id % 3 <> 0) AS a, count(*) FILTER (event_id % 3 = 0) AS f FROM events GROUP BY 1)
        SELECT CASE WHEN a = 0 THEN 'unopened' WHEN f = 0 THEN 'incomplete' ELSE 'finished' END AS state, count(*) AS n FROM f GROUP BY 1""",
    "box_iou": f"WITH {_BOX} SELECT a.vec_id, c.vec_id AS other, round({_IOU} / ({_AREA} - {_IOU})::DOUBLE, 6) AS iou FROM b a JOIN b c ON c.vec_id // 40 = a.vec_id // 40 AND c.vec_id > a.vec_id",
    "disjoint_pairs": f"""WITH {_BOX} SELECT a.vec_id, min(c.vec_id) AS other FROM b a JOIN b c ON c.vec_id // 40 = a.vec_id // 40 AND c.vec_id > a.vec_id
        WHERE {_IOU} = 0 AND (greatest(a.x2, c.x2) - least(a.x1, c.x1)) * (greatest(a.y2, c.y2) - least(a.y1, c.y1)) <= 250000 GROUP BY 1""",
    "coincident_anchors": f"""WITH {_BOX}, q AS (SELECT a.vec_id, c.vec_id AS other, radians(a.label * 9) AS t, c.x1 - a.x1 AS dx, c.y1 - a.y1 AS dy FROM b a JOIN b c ON c.vec_id // 40 = a.vec_id // 40 AND c.vec_id > a.vec_id)
        SELECT vec_id, other FROM q WHERE abs(dx * cos(t) + dy * sin(t)) <= 200 AND abs(dy * cos(t) - dx * sin(t)) <= 120""",
    "bounding_box": f"WITH {_BOX} SELECT label, greatest(0, least(1000, min(x1) - 5)) AS x1, greatest(0, least(1000, min(y1) - 5)) AS y1, greatest(0, least(1000, max(x2) + 5)) AS x2, greatest(0, least(1000, max(y2) + 5)) AS y2 FROM b GROUP BY 1",
    "physics_exact": """SELECT p_partkey, CASE WHEN (p_partkey % 48 + 1) // gcd(p_size, p_partkey % 48 + 1) = 1 THEN (p_size // gcd(p_size, p_partkey % 48 + 1))::VARCHAR
        ELSE (p_size // gcd(p_size, p_partkey % 48 + 1)) || '/' || ((p_partkey % 48 + 1) // gcd(p_size, p_partkey % 48 + 1)) END AS amps FROM part""",
    "html_titles": "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a href='))::BIGINT AS n_links FROM pages",
    "url_allowlist": """SELECT regexp_matches(url, '^https://([^/?#]*\\.)?example\\.(com|net)(/[^?#]*)?$') AS allowed, count(*) AS n FROM pages GROUP BY 1""",
}
