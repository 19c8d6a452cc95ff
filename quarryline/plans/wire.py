"""Queries on conversations with tools and lessons in the messages that a trainer reads, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions import expressions as X
from quarryline.operators import training_rows as T
from quarryline.operators import views as V
from quarryline.operators import wire as W

from .common import refuses_sql, table
from .lessons import _BOM, _C, _S, SHEET, _bom, _circuits, _nets


def flat(messages: str) -> Column:
    """Messages as one text: role, then texts and images."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), F.array_join(F.transform(m["content"], lambda b: F.coalesce(b["text"], b["image"])), "|"))), "\n")


def wire_messages(spark, d):
    """Each conversation as a talk with tools: a user turn is asked, any other turn is an answer after a call whose
    result it quotes. By conv_id modulo 8 there are two calls in a message (2), a wrong id on the first result (3), a
    missing result (4), an id used twice (5), a label with a blank (6)."""
    c = table(spark, d, "conversations").where("turn is not null and conv_id is not null")
    k, text, turn = F.col("conv_id") % 8, F.coalesce("text", F.lit("")), F.col("turn").cast("string")
    label = F.concat(F.lit('{"label": "'), F.when(k == 6, "R ").otherwise("R"), turn, F.lit('"}'))
    key = F.concat(F.lit("call-"), F.when((k == 5), F.lit("0")).otherwise(turn))
    one = F.struct(key.alias("id"), F.lit("show_label").alias("name"), label.alias("arguments"))
    two = F.struct(F.concat(key, F.lit("b")).alias("id"), F.lit("show_full_sheet").alias("name"), F.lit("{}").alias("arguments"))
    calls = F.when(k == 2, F.array(one, two)).otherwise(F.array(one))
    result = lambda key: W.turn("tool", F.sha2(text, 256), answers=key)
    answered = F.array(W.turn("assistant", None, calls=calls), result(F.when(k == 3, F.concat(key, F.lit("x"))).otherwise(key)))
    answered = F.when(k == 2, F.concat(answered, F.array(result(F.concat(key, F.lit("b")))))).when(k == 4, F.slice(answered, 1, 1)).otherwise(answered)
    said = F.when(F.col("role") == "user", F.array(W.turn("user", text))).otherwise(F.concat(answered, F.array(W.turn("assistant", text))))
    talk = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.cast(f"array<{W.MESSAGES[6:-1]}>").alias("m")))).alias("t"))
    made = W.plain(talk.select("conv_id", F.flatten("t.m").alias("messages")), tools=W.VIEWER)
    return made.select("conv_id", F.size("plain").cast("long").alias("n_plain"), "fault", X.digest(flat("plain")).alias("plain_sha256"))


def _box(k: Column) -> Column:
    """A made region of a name's number."""
    x, y = k * 37 % 900, k * 53 % 900
    return F.array(*(c.cast("int") for c in (x, y, x + 10 + k % 90, y + 10 + k % 70)))


def _view_targets(spark, d):
    """Sheets of lessons.py with a region for each name; nets are given names that can be asked for."""
    number = F.regexp_extract("refdes", r"^.(\d+)$", 1).cast("long") % 100_000
    parts = _bom(spark, d).withColumn("box", F.when(number % 6 != 5, _box(number)))
    nets = _nets(spark, d)
    own = F.regexp_extract("net", r"(\d+)$", 1).cast("long")
    nets = nets.withColumns({"box": _box(own), "net": F.when(F.col("net").startswith("N$"), F.col("net")).otherwise(F.concat(F.lit("NET"), "net"))})
    return V.targets(parts, nets, SHEET)


def view_targets(spark, d):
    t = _view_targets(spark, d)
    return t.select(*SHEET, "first", "value", "net", "one", "other", "missing", *(W.json_box(F.col(c)).alias(c) for c in ("first_box", "net_box", "pair_box")))


def view_lessons(spark, d):
    """One lesson of five tasks for each sheet; its own replies are graded, each by its label."""
    made = V.lessons(_view_targets(spark, d), SHEET, F.concat(F.lit("images/"), F.col("source").cast("string"), F.lit("-"), F.col("page").cast("string"), F.lit(".png")))
    reply = F.filter("messages", lambda m: m["role"] == "assistant")
    pairs = made.select(*SHEET, "messages", F.posexplode(F.arrays_zip(reply.alias("said"), F.col("gold").alias("gold"))).alias("k", "x"))
    graded = V.graded(pairs.select(*SHEET, X.digest(flat("messages")).alias("messages_sha256"), "k", F.get("x.said.content", 0)["text"].alias("output"), "x.gold.*"))
    return graded.select(*SHEET, "messages_sha256", "k", F.inline_outer("scores"))


def view_replies(spark, d):
    """Whole texts of documents as replies: those of even doc_id have to name a label, the others to refuse."""
    t = table(spark, d, "documents").select("doc_id", F.col("text").alias("output"), F.when(F.col("doc_id") % 2 == 0, "view_reply").otherwise("view_refuse").alias("type"),
                                            F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.lit("the").alias("label"), F.lit(None).cast("double").alias("min_iou"))
    # All have a score. inline() would have all texts parsed and graded twice, the first time to filter those without one.
    return V.graded(t).select("doc_id", F.inline_outer("scores"))


#: Parts of the table whose messages are made in one task, and tasks at most.
TASK_PARTS, TASKS = 2_000, 200


def _candidates(spark, d):
    # A candidate's row is small and the messages made of it are not, so rows are dealt by their number; by their bytes all would go to one task.
    tasks = min(table(spark, d, "part").count() // TASK_PARTS + 1, TASKS)
    made = _circuits(spark, d).repartition(tasks, "id").withColumns({"design_id": F.concat(F.lit("d"), F.col("id").cast("string")), "family_id": F.col("value"), "title": F.concat(F.lit("board Ω "), F.col("id").cast("string")),
                                            "box": _box(F.col("id")), "image": F.concat(F.lit("images/"), F.col("id").cast("string"), F.lit(".png"))})
    part = F.concat(F.lit('{"refdes": "'), "refdes", F.lit('"}'))
    return made.withColumns({"evidence": F.concat(F.lit('{"bom": ['), part, F.lit("]}")), "part": part})


def lesson_messages(spark, d):
    return T.lesson_rows(_candidates(spark, d)).select("id", "split", "kind", "fault", F.size("messages").cast("long").alias("n"), X.digest(flat("messages")).alias("messages_sha256"))


def scenario_messages(spark, d):
    return T.scenario_rows(_candidates(spark, d)).select("id", "split", "kind", "fault", F.size("messages").cast("long").alias("n"), X.digest(flat("messages")).alias("messages_sha256"))


QUERIES = {f.__name__: f for f in (wire_messages, view_targets, view_lessons, view_replies, lesson_messages, scenario_messages)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _box_sql(k: str) -> str:
    return f"[{k} * 37 % 900, {k} * 53 % 900, {k} * 37 % 900 + 10 + {k} % 90, {k} * 53 % 900 + 10 + {k} % 70]"


def _json_sql(b: str) -> str:
    return f"('[' || array_to_string({b}, ', ') || ']')"


_UNION = "[least(a.box[1], b.box[1]), least(a.box[2], b.box[2]), greatest(a.box[3], b.box[3]), greatest(a.box[4], b.box[4])]"
_TARGETS = f"""{_BOM}, vp AS (SELECT source, page, refdes, value, regexp_extract(refdes, '^.(\\d+)$', 1)::BIGINT % 100000 AS k, visible FROM b),
  vb AS (SELECT source, page, refdes, value, {_box_sql('k')} AS box, row_number() OVER (PARTITION BY source, page ORDER BY NOT regexp_matches(refdes, '^[UR]'), refdes) AS i FROM vp
    WHERE visible AND k % 6 <> 5 AND regexp_matches(refdes, '^[A-Z][A-Z0-9_]*[0-9][A-Z0-9_]*$')),
  vn AS (SELECT source, page, CASE WHEN starts_with(net, 'N$') THEN net ELSE 'NET' || net END AS net, len(pads) AS n_pads, {_box_sql("regexp_extract(net, '([0-9]+)$', 1)::BIGINT")} AS box FROM n),
  vbest AS (SELECT * FROM vn WHERE n_pads >= 2 AND regexp_matches(net, '^[A-Z][A-Z0-9_+]{{1,15}}$') QUALIFY row_number() OVER (PARTITION BY source, page ORDER BY n_pads, net) = 1),
  vpair AS (SELECT a.source, a.page, a.refdes AS one, b.refdes AS other, {_UNION} AS pair_box FROM vb a JOIN vb b ON a.source = b.source AND a.page = b.page AND a.refdes < b.refdes
    WHERE (least(a.box[3], b.box[3]) <= greatest(a.box[1], b.box[1]) OR least(a.box[4], b.box[4]) <= greatest(a.box[2], b.box[2]))
      AND (greatest(a.box[3], b.box[3]) - least(a.box[1], b.box[1])) * (greatest(a.box[4], b.box[4]) - least(a.box[2], b.box[2])) <= 250000
    QUALIFY row_number() OVER (PARTITION BY a.source, a.page ORDER BY a.i, b.i) = 1),
  vu AS (SELECT source, page, list(length(refdes) - 1) FILTER (regexp_matches(refdes, '^R999+$')) AS used FROM b GROUP BY 1, 2),
  vt AS (SELECT f.source, f.page, f.refdes AS first, f.value, net, one, other, 'R' || repeat('9', list_min(list_filter(range(3, 30), lambda x: NOT list_contains(coalesce(used, []), x)))::INT) AS missing,
    {_json_sql('f.box')} AS first_box, {_json_sql('vbest.box')} AS net_box, {_json_sql('pair_box')} AS pair_box
    FROM vb f JOIN vbest ON vbest.source = f.source AND vbest.page = f.page JOIN vpair ON vpair.source = f.source AND vpair.page = f.page
      JOIN vu ON vu.source = f.source AND vu.page = f.page WHERE f.i = 1 AND (SELECT count(*) FROM vb c WHERE c.source = f.source AND c.page = f.page) >= 3)"""


def _called_sql(tool: str, parameters: str) -> str:
    return f"'<tool_call>' || chr(10) || '<function={tool}>' || chr(10) || {parameters}'</function>' || chr(10) || '</tool_call>'"


def _parameter_sql(key: str, value: str) -> str:
    return f"'<parameter={key}>' || chr(10) || {value} || chr(10) || '</parameter>' || chr(10) || "


def _response_sql(value: str) -> str:
    return f"'<tool_response>' || chr(10) || {value} || chr(10) || '</tool_response>'"


def _talk_sql(*messages: tuple[str, str]) -> str:
    return " || chr(10) || ".join(f"'{role}:' || {text}" for role, text in messages)


_SHOWN = """'{"status": "shown", "label": "' || first || '", "kind": "part", "box": ' || first_box || '}'"""
_NET_SHOWN = """'{"status": "shown", "label": "' || net || '", "kind": "net", "box": ' || net_box || '}'"""
_VIEW_TALK = _talk_sql(
    ("system", _quoted(W.preamble(W.VIEWER) + "\n\n" + V.SYSTEM)), ("user", "'images/' || source || '-' || page || '.png|Show me ' || first || '.'"),
    ("assistant", _called_sql("show_label", _parameter_sql("label", "first"))), ("user", _response_sql(_SHOWN)), ("assistant", "'Showing ' || first || ', marked ' || value || '.'"),
    ("user", "'Zoom to the ' || net || ' net.'"), ("assistant", _called_sql("show_label", _parameter_sql("label", "net"))), ("user", _response_sql(_NET_SHOWN)), ("assistant", "'Showing net ' || net || '.'"),
    ("user", "'Frame ' || one || ' and ' || other || ' together in one view.'"),
    ("assistant", _called_sql("show_region", _parameter_sql("box", "pair_box") + _parameter_sql("label", "one || ' and ' || other"))),
    ("user", _response_sql("""'{"status": "shown", "box": ' || pair_box || '}'""")), ("assistant", "'Showing ' || one || ' and ' || other || ' together.'"),
    ("user", "'Where is ' || missing || '? Show it to me.'"), ("assistant", _called_sql("show_label", _parameter_sql("label", "missing"))),
    ("user", _response_sql("""'{"status": "not_found", "label": "' || missing || '"}'""")), ("assistant", "missing || ' is not on this sheet, so there is nothing to show.'"),
    ("user", "'Zoom back out to the whole sheet.'"), ("assistant", _called_sql("show_full_sheet", "")), ("user", _response_sql("""'{"status": "shown", "view": "full_sheet"}'""")),
    ("assistant", "'Showing the full sheet.'"))

_CAND = f"""{_C}, cand AS (SELECT id, page, refdes, value, split, {_json_sql(_box_sql('id'))} AS box,
    '{{"document": {{"title": "board \\u03a9 ' || id || '", "page": ' || page || '}}, "focused_label": ' AS doc, '{{"refdes": "' || refdes || '"}}' AS part FROM c)"""
_FOCUS = """'{"label": "' || refdes || '", "kind": "part", "box": ' || box || ', "source": "native_region_map"}'"""


def _context_sql(question: str, focused: str, zoomed: str) -> str:
    return (f"{_quoted(T.CONTEXT)} || doc || CASE WHEN {focused} THEN {_FOCUS} ELSE 'null' END || ', \"viewport\": {{\"box\": ' || CASE WHEN {zoomed} THEN box || ', \"full_sheet\": false' "
            f"ELSE '[0, 0, 1000, 1000], \"full_sheet\": true' END || '}}}}' || {_quoted(T.QUESTION)} || {question}")


_PART_SHOWN = """'{"status": "shown", "label": "' || refdes || '", "kind": "part", "box": ' || box || '}'"""
_LESSON_TALK = ("'system:' || " + _quoted(W.preamble(W.AGENT) + "\n\n" + T.LESSON_SYSTEM) + " || chr(10) || 'user:images/' || id || '.png|' || " + _quoted(T.EVIDENCE) +
                """ || '{"bom": [' || part || ']}' || chr(10) || chr(10) || CASE WHEN kind = 'followup' THEN """ + _context_sql("'Show me ' || refdes || '.'", "false", "false") + " || chr(10) || " +
                _talk_sql(("assistant", _called_sql("show_label", _parameter_sql("label", "refdes"))), ("user", _response_sql(_PART_SHOWN)),
                          ("assistant", "'Showing ' || refdes || ', marked ' || value || '.'"), ("user", "''")) + " ELSE '' END || " +
                _context_sql("question", "kind <> 'clarify'", "kind <> 'clarify'") + " || chr(10) || 'assistant:' || CASE kind WHEN 'show' THEN " + _called_sql("show_label", _parameter_sql("label", "refdes")) +
                " WHEN 'clarify' THEN " + _quoted(T.WHICH) + " ELSE " + _called_sql("web_search", _parameter_sql("query", "value || ' datasheet'")) + " END")

ORACLES = {
    "wire_messages": f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS x, conv_id % 8 AS k, row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) AS nth,
    max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
  m AS (SELECT *, CASE WHEN role = 'user' THEN 'user:' || x ELSE 'assistant:' || {_called_sql("show_label", _parameter_sql("label", "'R' || turn"))} || CASE WHEN k = 2 THEN chr(10) ||
      {_called_sql("show_full_sheet", "")} ELSE '' END || chr(10) || 'user:' || {_response_sql('sha256(x)')} || CASE WHEN k = 2 THEN chr(10) || {_response_sql('sha256(x)')} ELSE '' END
      || chr(10) || 'assistant:' || x END AS s, CASE WHEN role = 'user' THEN 1 ELSE 3 END AS n FROM t),
  c AS (SELECT conv_id, k, string_agg(s, chr(10) ORDER BY turn) AS s, sum(n)::BIGINT + 1 AS n, count(*) FILTER (role <> 'user') AS calls FROM m GROUP BY conv_id, k),
  f AS (SELECT *, CASE WHEN calls = 0 THEN NULL WHEN k = 6 THEN 'bad call' WHEN k = 3 THEN 'result out of order' WHEN k = 4 THEN 'unanswered call'
    WHEN k = 5 AND calls > 1 THEN 'repeated call id' END AS fault FROM c)
SELECT conv_id, CASE WHEN fault IS NULL THEN n END AS n_plain, fault, CASE WHEN fault IS NULL THEN sha256('system:' || {_quoted(W.preamble(W.VIEWER))} || chr(10) || s) END AS plain_sha256 FROM f""",
    "view_targets": f"WITH {_TARGETS} SELECT * FROM vt",
    "view_lessons": f"""WITH {_TARGETS}, g(k, metric) AS (VALUES (0, 'view.call_acc'), (1, 'view.reply_acc'), (2, 'view.call_acc'), (3, 'view.reply_acc'), (4, 'view.call_acc'), (4, 'view.region_acc'),
    (5, 'view.reply_acc'), (6, 'view.call_acc'), (7, 'view.refuse_acc'), (8, 'view.call_acc'), (9, 'view.reply_acc'))
  SELECT source, page, sha256({_VIEW_TALK}) AS messages_sha256, k, metric, 1.0::DOUBLE AS score FROM vt, g""",
    "view_replies": f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'view.reply_acc' ELSE 'view.refuse_acc' END AS metric, (CASE WHEN coalesce(trim(text, chr(9) || chr(10) || chr(13) || ' '), '') = '' THEN false
    WHEN doc_id % 2 = 0 THEN regexp_matches(text, '(?:^|[^\\pL\\pN\\pM_$-])the(?:$|[^\\pL\\pN\\pM_$-])', 'i') ELSE {refuses_sql('text')} END)::INT::DOUBLE AS score FROM documents""",
    "lesson_messages": f"""WITH {_CAND}, l(kind, train, val) AS (VALUES ('search', 'Search the web for the datasheet for @R.', 'Find the manufacturer''s datasheet online for @R.'),
      ('followup', 'Search online for that selected part''s datasheet.', 'do a web search for that part'), ('show', 'Show me @R.', 'Take me to @R on the drawing.'),
      ('clarify', 'Search for that part online.', 'Look that component up on the web.')),
    x AS (SELECT cand.*, kind, replace(CASE WHEN split = 'val' THEN val ELSE train END, '@R', refdes) AS question FROM cand, l)
  SELECT id || '-p' || page || '-' || refdes || '-' || kind AS id, split, kind, NULL::VARCHAR AS fault, CASE WHEN kind = 'followup' THEN 7 ELSE 3 END::BIGINT AS n, sha256({_LESSON_TALK}) AS messages_sha256 FROM x""",
    "scenario_messages": f"""WITH {_S.replace(_C, _CAND, 1).replace("FROM c, plan", "FROM cand, plan").replace("SELECT id || '-' || kind AS id, kind", "SELECT id AS cid, doc, part, box, refdes, value, id || '-' || kind AS id, kind")},
    st AS (SELECT *, turn > 0 AND NOT (kind = 'stale_focus' AND turn > 0) AS focused, turn > 0 AS zoomed FROM s),
    p AS (SELECT *, 'user:' || CASE WHEN turn = 0 THEN 'images/' || cid || '.png|' || {_quoted(T.EVIDENCE)} || '{{"page": ' || regexp_extract(doc, '"page": ([0-9]+)', 1) || ', "bom": [' || part ||
        '], "scope": "selected native component; not a full electrical review"}}' || chr(10) || chr(10) ELSE '' END || {_context_sql('question', 'focused', 'zoomed')} AS asked,
      CASE tool WHEN 'show_label' THEN 'assistant:' || {_called_sql("show_label", _parameter_sql("label", "refdes"))} WHEN 'web_search' THEN 'assistant:' || {_called_sql("web_search", _parameter_sql("query", "value || ' datasheet'"))} END AS called,
      CASE tool WHEN 'show_label' THEN 'user:' || {_response_sql(_PART_SHOWN)} WHEN 'web_search' THEN 'user:' || {_response_sql(_quoted(T.NO_RESULTS))} END AS result FROM st),
    e AS (SELECT id, turn AS upto FROM p WHERE tool IS NOT NULL UNION ALL SELECT DISTINCT id, 99 FROM p)
  SELECT p.id || CASE WHEN upto = 99 THEN '-complete' ELSE '-tool-prefix-' || upto END AS id, split, kind, NULL::VARCHAR AS fault,
    (1 + sum(CASE WHEN turn < upto THEN CASE WHEN tool IS NULL THEN 2 ELSE 4 END ELSE 2 END))::BIGINT AS n,
    sha256('system:' || {_quoted(W.preamble(W.AGENT) + chr(10) * 2 + T.SCENARIO_SYSTEM)} || chr(10) || string_agg(asked || coalesce(chr(10) || called, '') || CASE WHEN turn < upto
      THEN coalesce(chr(10) || result, '') || chr(10) || 'assistant:' || answer ELSE '' END, chr(10) ORDER BY turn)) AS messages_sha256
  FROM e JOIN p ON p.id = e.id AND turn <= upto GROUP BY p.id, upto, split, kind""",
}
