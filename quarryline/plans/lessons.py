"""Queries on rows made from schematic facts, reviews and circuit specifications, with their SQL.

Line items stand in for a netlist as in facts.py. A sheet is a source and a page, a part of it is one
that has a pad there; a third of the parts count as resistors, and names of nines are made on some
sheets, so that every rule has its cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import expressions as X
from quarryline.operators import evidence as E
from quarryline.operators import lessons as M
from quarryline.operators.selection import dealt

from .common import split_sql, table
from .facts import _PADS, _pads

SHEET = ["source", "page"]


def _bom(spark, d):
    i = table(spark, d, "lineitem")
    n = i.count()
    own = i.select((F.col("l_suppkey") % 20).alias("source"), F.col("l_linenumber").cast("long").alias("page"), F.col("l_partkey").alias("p_partkey"))
    own = dealt(own, n, "p_partkey").distinct().join(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    k = F.col("p_partkey")
    name = F.when(k % 50 == 7, F.concat(F.lit("R"), F.repeat(F.lit("9"), (4 + k % 3).cast("int")))).when(
        k % 3 == 0, F.concat(F.lit("R"), k)).otherwise(F.concat(F.lit("C"), k))
    value = F.when(F.col("p_size") % 10 == 0, "").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("k")))
    found = own.select(*SHEET, name.alias("refdes"), value.alias("value"), (F.col("p_size") % 4 != 0).alias("visible"))
    return dealt(found, n, *SHEET, "refdes").groupBy(*SHEET, "refdes").agg(F.max("value").alias("value"), F.bool_or("visible").alias("visible"))


def _nets(spark, d):
    """Nets of a sheet and their pads, as in facts.py; numbers are dealt and grouped, and names are made of what is left."""
    i = table(spark, d, "lineitem")
    own = i.select((F.col("l_suppkey") % 20).alias("source"), F.col("l_linenumber").cast("long").alias("page"), "l_orderkey", "l_partkey")
    k = dealt(own, i.count(), *SHEET, "l_orderkey").groupBy(*SHEET, "l_orderkey").agg(F.collect_set("l_partkey").alias("k"))
    pads = F.array_sort(F.transform("k", lambda p: F.concat(F.lit("P"), p.cast("string"), F.lit("."), F.col("page").cast("string"))))
    net = F.col("l_orderkey").cast("string")
    return k.select(*SHEET, F.when(F.col("l_orderkey") % 10 == 0, F.concat(F.lit("N$"), net)).otherwise(net).alias("net"), pads.alias("pads"))


def evidence_turns(spark, d):
    """Six turns for each sheet on its recorded facts."""
    t = M.turns(M.targets(_bom(spark, d), _nets(spark, d), SHEET), SHEET)
    return t.select(*SHEET, "turn", "question", "answer", "type", "value", F.array_join("pins", " ").alias("pins"), "query", "net")


def image_turns(spark, d):
    """Four turns for each sheet on what its image shows."""
    t = M.turns(M.targets(_bom(spark, d), _nets(spark, d), SHEET, visible_only=True), SHEET, image_only=True)
    return t.select(*SHEET, "turn", "question", "answer", "type", "value")


def absent_names(spark, d):
    return M.absent_name(_bom(spark, d), SHEET)


def _circuits(spark, d):
    """Parts as integrated circuits; those of odd size have a region."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("U"), k)).when(k % 4 == 1, F.concat(F.lit("IC"), k)).otherwise(F.concat(F.lit("R"), k))
    parts = p.select(k.alias("id"), F.col("p_size").alias("page"), name.alias("refdes"), F.when(
        k % 5 == 0, F.regexp_replace("p_brand", "[^0-9]", "")).when(k % 5 == 1, F.col("p_type")).otherwise(F.col("p_brand")).alias("value"))
    return M.circuits(parts, parts.where("page % 2 = 1"), ["id"]).withColumn("split", X.family_split(F.col("value")))


def routing_lessons(spark, d):
    return M.lessons(_circuits(spark, d))


def scenario_turns(spark, d):
    return M.scenarios(_circuits(spark, d))


def tool_prefix_rows(spark, d):
    return M.tool_prefixes(M.scenarios(_circuits(spark, d))).select("id", "row", "n_turns", X.digest(F.col("history")).alias("history_sha256"))


#: Kinds of question in the order in which parts ask them.
KINDS = ("value", "net_members", "pad_net", *E.REVIEWS)


def source_reviews(spark, d):
    """Questions of all kinds on all pages, asked in turn by the parts, and what answers them."""
    bom, pads = _bom(spark, d).drop("source").distinct(), _pads(spark, d).select("page", "net", "pad").distinct()
    k = F.col("p_partkey")
    page = k % 7 + 1
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % len(KINDS) + 1).cast("int"))
    target = F.when(kind == "net_members", k.cast("string")).when(kind == "pad_net", F.concat(F.lit("P"), k, F.lit("."), page)).otherwise(
        F.when(k % 3 == 0, F.concat(F.lit("R"), k)).otherwise(F.concat(F.lit("C"), k)))
    q = table(spark, d, "part").select("p_partkey", page.alias("page"), kind.alias("kind"), target.alias("target"))
    return E.reviewed(q, bom, pads, ["page"]).select("p_partkey", "kind", "target", "status", "answer", F.array_join("required", "; ").alias("required"), "eligible")


def circuit_specs(spark, d):
    """Orders as circuits: lines 1 to 4 are declared, line 2 twice in some, and lines that were shipped by air are assigned."""
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("spec"), F.concat(F.lit("P."), "l_linenumber").alias("pad"), "l_linenumber", "l_quantity", "l_partkey")
    declared = i.where("l_linenumber <= 4")
    declared = declared.unionByName(i.where("l_linenumber = 2 and l_partkey % 3 = 0"))
    assigned = i.where("l_partkey % 5 <> 0").unionByName(i.where("l_partkey % 7 = 0 and l_partkey % 5 <> 0"))
    return E.assignment_faults(declared, assigned, ["spec"])


def page_change_turns(spark, d):
    """A change of page for each source of the sheets."""
    return M.page_changes(_bom(spark, d).withColumnRenamed("visible", "region"), ["source"])


QUERIES = {f.__name__: f for f in (
    page_change_turns, evidence_turns, image_turns, absent_names, routing_lessons, scenario_turns, tool_prefix_rows, source_reviews, circuit_specs)}

_BOM = f"""{_PADS}, b0 AS (SELECT DISTINCT source, page, regexp_extract(pad, '^P(\\d+)\\.', 1)::BIGINT AS k FROM p),
  b AS (SELECT source, page, CASE WHEN k % 50 = 7 THEN 'R' || repeat('9', (4 + k % 3)::INT) WHEN k % 3 = 0 THEN 'R' || k ELSE 'C' || k END AS refdes,
      max(CASE WHEN p_size % 10 = 0 THEN '' ELSE p_size || 'k' END) AS value, bool_or(p_size % 4 <> 0) AS visible FROM b0 JOIN part ON p_partkey = k GROUP BY 1, 2, 3),
  n AS (SELECT source, page, net, list_sort(list(DISTINCT pad)) AS pads FROM p GROUP BY 1, 2, 3),
  r AS (SELECT source, page, list(length(refdes) - 1) FILTER (regexp_matches(refdes, '^R9999+$')) AS used FROM b GROUP BY 1, 2),
  miss AS (SELECT source, page, 'R' || repeat('9', list_min(list_filter(range(4, 20), lambda x: NOT list_contains(coalesce(used, []), x)))::INT) AS missing FROM r)"""


def _targets_sql(more: str) -> str:
    return f"""{_BOM}, f AS (SELECT source, page, refdes, value, row_number() OVER (PARTITION BY source, page ORDER BY NOT starts_with(refdes, 'R'), refdes) AS i
      FROM b WHERE value <> '' AND regexp_matches(refdes, '^[A-Z][A-Z0-9_$-]*$') {more}),
  best AS (SELECT * FROM n WHERE len(pads) BETWEEN 2 AND 8 QUALIFY row_number() OVER (PARTITION BY source, page ORDER BY starts_with(net, 'N$'), len(pads), net) = 1),
  t AS (SELECT x.source, x.page, x.refdes AS r1, x.value AS v1, y.refdes AS r2, y.value AS v2, net, pads, pads[1] AS q, missing FROM f x
      JOIN f y ON y.source = x.source AND y.page = x.page AND x.i = 1 AND y.i = 2 JOIN best ON best.source = x.source AND best.page = x.page
      JOIN miss ON miss.source = x.source AND miss.page = x.page)"""


_REFUSE = """{'question': 'What value is ' || missing || ', and what does it connect to?',
    'answer': 'There is no ' || missing || ' in the supplied sheet evidence. Its value and connections are not shown.', 'type': 'refuse'},
  {'question': 'What measured voltage was observed at ' || q || ' during a powered bench test?',
    'answer': 'No bench measurement is supplied in this schematic or source evidence. I cannot infer a measured voltage.', 'type': 'refuse'}"""
_C = f"""c0 AS (SELECT p_partkey AS id, p_size AS page, CASE p_partkey % 4 WHEN 0 THEN 'U' || p_partkey WHEN 1 THEN 'IC' || p_partkey END AS refdes,
    CASE p_partkey % 5 WHEN 0 THEN regexp_replace(p_brand, '[^0-9]', '', 'g') WHEN 1 THEN p_type ELSE p_brand END AS value FROM part WHERE p_size % 2 = 1),
  c AS (SELECT *, {split_sql('value')} AS split FROM c0 WHERE refdes IS NOT NULL AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]'))"""
_S = f"""{_C}, step(step, train, val, tool, arg, answer, may_move, clears) AS (VALUES
    ('show', 'Show me @R.', 'Center the view on @R.', 'show_label', '@R', 'Showing @R.', true, false),
    ('value', 'What value is marked for @R?', 'What is the marking for @R?', NULL, NULL, '@R is marked @V.', false, false),
    ('again', 'Remind me what @R is marked.', 'Remind me what @R is marked.', NULL, NULL, '@R is marked @V.', false, false),
    ('review', 'What voltage was measured at @R during startup?', 'Does this drawing establish the measured startup voltage at @R?', NULL, NULL,
      'The schematic does not provide measured startup voltage. A bench measurement is required.', false, false),
    ('search', 'Search online for that part datasheet.', 'Do a web search for that part.', 'web_search', '@V datasheet',
      'The search returned no results. I cannot infer datasheet specifications from an empty result.', false, false),
    ('cleared', 'Search online for that part datasheet.', 'Do a web search for that part.', 'web_search', '@V datasheet',
      'The search returned no results. I cannot infer datasheet specifications from an empty result.', false, true),
    ('explicit', 'Search the public datasheet for @V.', 'Search the public datasheet for @V.', 'web_search', '@V datasheet',
      'The search returned no results. I cannot infer datasheet specifications from an empty result.', false, false)),
  plan(kind, turn, step) AS (VALUES ('discussion', 0, 'show'), ('discussion', 1, 'value'), ('discussion', 2, 'review'), ('discussion', 3, 'again'),
    ('search', 0, 'show'), ('search', 1, 'search'), ('search', 2, 'value'), ('search', 3, 'review'),
    ('stale_focus', 0, 'show'), ('stale_focus', 1, 'cleared'), ('stale_focus', 2, 'explicit'), ('stale_focus', 3, 'value')),
  s AS (SELECT id || '-' || kind AS id, kind, split, turn, plan.step, replace(replace(CASE WHEN split = 'val' THEN val ELSE train END, '@R', refdes), '@V', value) AS question, tool,
    replace(replace(arg, '@R', refdes), '@V', value) AS argument, replace(replace(answer, '@R', refdes), '@V', value) AS answer, may_move, clears
    FROM c, plan JOIN step ON step.step = plan.step)"""
_NEEDS = ", ".join(f"('{k}', '{'; '.join(v)}')" for k, v in E.REVIEWS.items())
ORACLES = {
    "evidence_turns": f"""WITH {_targets_sql('')}, l AS (SELECT source, page, list_zip(range(6), [
      {{'question': 'What value is recorded for ' || r1 || '?', 'answer': r1 || ' has value ' || v1 || ' in the source schematic.', 'type': 'value', 'value': v1, 'pins': NULL, 'query': NULL, 'net': NULL}},
      {{'question': 'Which physical component pads connect to net ' || net || ' on this sheet?', 'answer': 'On this sheet, ' || net || ' connects ' || array_to_string(pads, ', ') || '.', 'type': 'pins', 'value': NULL, 'pins': array_to_string(pads, ' '), 'query': NULL, 'net': net}},
      {{'question': 'Trace ' || q || ': which other physical pads share its net on this sheet?', 'answer': q || ' is on ' || net || ', together with ' || array_to_string(pads[2:], ', ') || '.', 'type': 'pins', 'value': NULL, 'pins': array_to_string(pads[2:], ' '), 'query': q, 'net': net}},
      {{'question': 'What is the specified value of ' || r2 || '?', 'answer': r2 || ' has value ' || v2 || ' in the source schematic.', 'type': 'value', 'value': v2, 'pins': NULL, 'query': NULL, 'net': NULL}},
      {_REFUSE.replace("'type': 'refuse'", "'type': 'refuse', 'value': NULL, 'pins': NULL, 'query': NULL, 'net': NULL")}]) AS x FROM t),
      u AS (SELECT source, page, unnest(x) AS z FROM l)
      SELECT source, page, z[1]::INT AS turn, z[2].question AS question, z[2].answer AS answer, z[2].type AS type, z[2].value AS value, z[2].pins AS pins, z[2].query AS query, z[2].net AS net FROM u""",
    "image_turns": f"""WITH {_targets_sql('AND visible')}, l AS (SELECT source, page, list_zip(range(4), [
      {{'question': 'Read the value shown next to ' || r1 || '.', 'answer': r1 || ' is marked ' || v1 || '.', 'type': 'value', 'value': v1}},
      {{'question': 'And what value is marked for ' || r2 || '?', 'answer': r2 || ' is marked ' || v2 || '.', 'type': 'value', 'value': v2}},
      {_REFUSE.replace("'type': 'refuse'", "'type': 'refuse', 'value': NULL")}]) AS x FROM t), u AS (SELECT source, page, unnest(x) AS z FROM l)
      SELECT source, page, z[1]::INT AS turn, z[2].question AS question, z[2].answer AS answer, z[2].type AS type, z[2].value AS value FROM u""",
    "page_change_turns": f"""WITH {_BOM}, pg AS (SELECT DISTINCT source, page FROM b), o AS (SELECT source, page, row_number() OVER (PARTITION BY source ORDER BY page) AS i FROM pg),
      f AS (SELECT source, page, min(refdes) AS refdes, arg_min(value, refdes) AS value FROM b WHERE value <> '' AND visible GROUP BY 1, 2),
      t AS (SELECT x.source, x.page AS one, y.page AS two, a.refdes AS r1, c.refdes AS r2, c.value AS v2 FROM o x JOIN o y ON y.source = x.source AND x.i = 1 AND y.i = 2
        JOIN f a ON a.source = x.source AND a.page = x.page JOIN f c ON c.source = y.source AND c.page = y.page)
      SELECT source, 0 AS turn, one AS page, 'Show me ' || r1 || '.' AS question, 'show_label' AS tool, r1 AS argument, 'Showing ' || r1 || '.' AS answer, NULL AS expected, true AS may_move, false AS refusal FROM t
      UNION ALL SELECT source, 1, two, 'I changed to page ' || two || '. Read the value of ' || r2 || ' here without moving the view.', NULL, NULL, r2 || ' is marked ' || v2 || '.', v2, false, false FROM t
      UNION ALL SELECT source, 2, two, 'Discuss only: what startup voltage was measured at ' || r2 || ' on this page?', NULL, NULL,
        'The schematic does not provide measured startup voltage. A bench measurement is required.', NULL, false, true FROM t
      UNION ALL SELECT source, 3, two, 'Now explicitly show ' || r2 || ' on this page.', 'show_label', r2, 'Showing ' || r2 || '.', NULL, true, false FROM t""",
    "absent_names": f"WITH {_BOM} SELECT source, page, missing FROM miss",
    "routing_lessons": f"""WITH {_C}, l(kind, train, val, tool, arg) AS (VALUES
        ('search', 'Search the web for the datasheet for @R.', 'Find the manufacturer''s datasheet online for @R.', 'web_search', '@V datasheet'),
        ('followup', 'Search online for that selected part''s datasheet.', 'do a web search for that part', 'web_search', '@V datasheet'),
        ('show', 'Show me @R.', 'Take me to @R on the drawing.', 'show_label', '@R'),
        ('clarify', 'Search for that part online.', 'Look that component up on the web.', NULL, NULL))
      SELECT id || '-p' || page || '-' || refdes || '-' || kind AS id, split, kind, kind <> 'clarify' AS focused,
        replace(CASE WHEN split = 'val' THEN val ELSE train END, '@R', refdes) AS question, tool, replace(replace(arg, '@R', refdes), '@V', value) AS argument FROM c, l""",
    "scenario_turns": f"WITH {_S} SELECT * FROM s",
    "tool_prefix_rows": f"""WITH {_S}, e AS (SELECT id, turn + 1 AS n FROM s WHERE tool IS NOT NULL UNION ALL SELECT DISTINCT id, 0 FROM s)
      SELECT e.id, CASE WHEN n = 0 THEN e.id ELSE e.id || '-tool-' || n END AS row, count(*) AS n_turns,
        sha256(string_agg(question || CASE WHEN n = 0 OR turn < n - 1 THEN chr(10) || answer ELSE '' END, chr(10) ORDER BY turn)) AS history_sha256
      FROM e JOIN s ON s.id = e.id AND (n = 0 OR turn < n) GROUP BY e.id, n""",
    "source_reviews": f"""WITH {_BOM}, kinds(i, kind) AS (VALUES {', '.join(f"({i}, '{k}')" for i, k in enumerate(KINDS))}), need(kind, required) AS (VALUES {_NEEDS}),
      q AS (SELECT p_partkey, kind, p_partkey % 7 + 1 AS page, CASE kind WHEN 'net_members' THEN p_partkey::VARCHAR WHEN 'pad_net' THEN 'P' || p_partkey || '.' || (p_partkey % 7 + 1)
        ELSE CASE WHEN p_partkey % 3 = 0 THEN 'R' ELSE 'C' END || p_partkey END AS target FROM part JOIN kinds ON p_partkey % {len(KINDS)} = i),
      fact AS (SELECT 'value' AS kind, page, refdes AS target, max(value) AS answer FROM b WHERE value <> '' GROUP BY 2, 3
        UNION ALL SELECT 'net_members', page, net, string_agg(DISTINCT pad, ' ' ORDER BY pad) FROM p GROUP BY 2, 3
        UNION ALL SELECT 'pad_net', page, pad, min(net) FROM p GROUP BY 2, 3 HAVING count(DISTINCT net) = 1)
      SELECT p_partkey, kind, target, CASE WHEN required IS NOT NULL THEN 'additional_evidence_required' WHEN answer IS NULL THEN 'not_recorded_on_page' ELSE 'source_verified' END AS status,
        answer, required, answer IS NOT NULL AS eligible FROM q LEFT JOIN fact USING (kind, page, target) LEFT JOIN need USING (kind)""",
    "circuit_specs": """WITH i AS (SELECT l_orderkey AS spec, 'P.' || l_linenumber AS pad, l_linenumber AS n, l_partkey AS k FROM lineitem),
      d AS (SELECT spec, pad, count(*) AS c FROM (SELECT spec, pad FROM i WHERE n <= 4 UNION ALL SELECT spec, pad FROM i WHERE n = 2 AND k % 3 = 0) GROUP BY 1, 2),
      a AS (SELECT spec, pad, count(*) AS c FROM (SELECT spec, pad FROM i WHERE k % 5 <> 0 UNION ALL SELECT spec, pad FROM i WHERE k % 7 = 0 AND k % 5 <> 0) GROUP BY 1, 2),
      f AS (SELECT spec, pad, CASE WHEN d.c IS NULL THEN 'not declared' WHEN d.c > 1 THEN 'declared twice' WHEN a.c IS NULL THEN 'not assigned' WHEN a.c > 1 THEN 'assigned twice' END AS fault
        FROM d FULL JOIN a USING (spec, pad)) SELECT * FROM f WHERE fault IS NOT NULL""",
}
