"""Conversations with tools as the plain messages that a trainer reads.

messages is an array of structs: role, content (array of structs type, text, image), tool_calls
(array of structs id, name, arguments, a JSON object as text), tool_call_id, name. A message and the
results that follow it are a segment; all rules speak of segments, so no state is carried from message to
message, and the work is in proportion to the conversation's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.expressions import python_stripped as stripped

MESSAGES = ("array<struct<role:string,content:array<struct<type:string,text:string,image:string>>,"
            "tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string,name:string>>")
PLAIN = "array<struct<role:string,content:array<struct<type:string,text:string,image:string>>>>"
#: Calls in one message and characters of a call's id, at most.
CALLS, ID = 4, 128

#: The tools that a model is offered, as JSON, by name.
TOOLS = {
    "show_label": '{"type": "function", "function": {"name": "show_label", "description": "Center the view on a reference designator (such as R1 or U3) or a net label '
                  '(such as SCL) on the current page. The viewer returns where it found the label, or not_found.", "parameters": {"type": "object", "properties": '
                  '{"label": {"type": "string", "description": "Exact reference designator or net name"}}, "required": ["label"]}}}',
    "show_region": '{"type": "function", "function": {"name": "show_region", "description": "Zoom the view onto a rectangle of the current page. Box coordinates are '
                   'integers 0-1000 relative to the full current page image, [x1, y1, x2, y2].", "parameters": {"type": "object", "properties": {"box": {"type": "array", '
                   '"items": {"type": "integer"}, "minItems": 4, "maxItems": 4, "description": "[x1, y1, x2, y2], integers 0-1000 relative to the full current page image, '
                   '[x1, y1, x2, y2]"}, "label": {"type": "string", "description": "Short caption for the region"}}, "required": ["box"]}}}',
    "show_full_sheet": '{"type": "function", "function": {"name": "show_full_sheet", "description": "Zoom out to show the whole current page.", "parameters": {"type": "object", "properties": {}}}}',
    "calculate": '{"type": "function", "function": {"name": "calculate", "description": "Calculate with two finite numbers using add, subtract, multiply or divide.", '
                 '"parameters": {"type": "object", "properties": {"operation": {"type": "string", "enum": ["add", "subtract", "multiply", "divide"]}, "a": {"type": "number"}, '
                 '"b": {"type": "number"}}, "required": ["operation", "a", "b"], "additionalProperties": false}}}',
    "web_search": '{"type": "function", "function": {"name": "web_search", "description": "Search the web via the operator\'s search service. Query leaves the private conversation only '
                  'after approval. Never put private schematic data in queries.", "parameters": {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"], '
                  '"additionalProperties": false}}}',
}
#: The tools of the viewer and of the agent, in the order in which they are offered.
VIEWER, AGENT = ("show_label", "show_region", "show_full_sheet"), ("show_label", "show_region", "show_full_sheet", "calculate", "web_search")
#: The words in front of a system message, around the tools' JSON.
BEFORE, AFTER = "# Tools\n\nYou have access to the following functions:\n\n<tools>", (
    "\n</tools>\n\nIf you choose to call a function ONLY reply in the following format with NO suffix:\n\n<tool_call>\n<function=example_function_name>\n"
    "<parameter=example_parameter_1>\nvalue_1\n</parameter>\n<parameter=example_parameter_2>\nThis is the value for the second parameter\nthat can span\nmultiple lines\n"
    "</parameter>\n</function>\n</tool_call>\n\n<IMPORTANT>\nReminder:\n- Function calls MUST follow the specified format: an inner <function=...></function> block must be "
    "nested within <tool_call></tool_call> XML tags\n- Required parameters MUST be specified\n- You may provide optional reasoning for your function call in natural language "
    "BEFORE the function call, but NOT after\n- If there is no function call available, answer the question like normal with your current knowledge and do not tell the user "
    "about function calls\n</IMPORTANT>")


def preamble(tools: tuple[str, ...]) -> str:
    """What a system message begins with where these tools are offered."""
    return BEFORE + "".join("\n" + TOOLS[t] for t in tools) + AFTER


def parameters(name: Column, arguments: Column, tools: tuple[str, ...] = VIEWER) -> Column:
    """A call's parameters as <parameter=...> blocks, or null where the function is not offered or its
    arguments are not exactly what it takes. Nothing is clamped or converted: a box is four rising
    integers from 0 to 1000, not numbers that could be rounded to some. Numbers of calculate() are
    written in their shortest form."""
    given = F.try_parse_json(arguments)
    form = F.schema_of_variant(given)
    text = lambda path: F.try_variant_get(given, path, "string")
    block = lambda key, value: F.concat(F.lit(f"<parameter={key}>\n"), value, F.lit("\n</parameter>\n"))
    label, query = stripped(text("$.label")), text("$.query")
    box = F.try_variant_get(given, "$.box", "array<bigint>")
    corner = lambda i: F.get(box, i)
    sound = (F.size(box) == 4) & F.forall(box, lambda v: v.between(0, 1000)) & (corner(0) < corner(2)) & (corner(1) < corner(3))
    shown = block("box", F.concat(F.lit("["), F.array_join(box.cast("array<string>"), ", "), F.lit("]")))
    captioned = (form == "OBJECT<box: ARRAY<BIGINT>, label: STRING>") & F.length(label).between(1, 80)
    number = r"^OBJECT<a: (BIGINT|DOUBLE|DECIMAL\(\d+,\d+\)), b: (BIGINT|DOUBLE|DECIMAL\(\d+,\d+\)), operation: STRING>$"
    small = F.abs(F.try_variant_get(given, "$.a", "double")).between(0, 1e100) & F.abs(F.try_variant_get(given, "$.b", "double")).between(0, 1e100)
    in_order = F.array_join(F.transform(F.json_object_keys(arguments), lambda k: F.concat(
        F.lit("<parameter="), k, F.lit(">\n"), F.when(k == "a", text("$.a")).when(k == "b", text("$.b")).otherwise(text("$.operation")), F.lit("\n</parameter>\n"))), "")
    found = {
        "show_label": F.when((form == "OBJECT<label: STRING>") & label.rlike(r"^[A-Za-z0-9_$+./#-]{1,64}\z"), block("label", label)),
        "show_region": F.when(sound & captioned, F.concat(shown, block("label", label))).when(sound & (form == "OBJECT<box: ARRAY<BIGINT>>"), shown),
        "show_full_sheet": F.when(form == "OBJECT<>", ""),
        "calculate": F.when(form.rlike(number) & small & text("$.operation").isin("add", "subtract", "multiply", "divide"), in_order),
        "web_search": F.when((form == "OBJECT<query: STRING>") & F.length(stripped(query)).between(1, 500), block("query", query)),
    }
    out = F.lit(None).cast("string")
    for tool in tools:
        out = F.when(name == tool, found[tool]).otherwise(out)
    return out


def _joined(content: Column) -> Column:
    """The text of blocks that are all text, or null."""
    sound = F.forall(content, lambda b: F.coalesce((b["type"] == "text") & b["text"].isNotNull(), F.lit(False)))
    return F.when(content.isNull(), F.lit(None).cast("string")).when(sound, F.array_join(F.transform(content, lambda b: b["text"]), ""))


def _message(role: str | Column, text: Column) -> Column:
    none = F.lit(None).cast("string")
    block = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.alias("image")))
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), block.alias("content"))


def plain(rows: DataFrame, messages: str = "messages", tools: tuple[str, ...] | None = VIEWER) -> DataFrame:
    """rows with plain (role and content of the messages as a trainer reads them) and fault; plain is null
    where there is a fault.

    The preamble stands before the system message, which is made where there is none. An assistant's calls
    become its text, the results of consecutive tool messages one user message. Without tools (None)
    messages are returned as they are, and it is a fault if they use any.

    Faults, the first in order of messages: "tools not offered", "not text" (content of a system or
    tool message or beside calls), "number of calls", "call id" (null, blank or over 128 characters),
    "bad call" (a function that is not offered, or arguments that it doesn't take), "unasked result", "result out of
    order" (its id is not the next open call's), "result name", "call fields" (a result's fields on a
    message with calls, or calls on a result), "unanswered call" (before another message, or when some results of a
    closing message are there; a conversation may end with calls); and at last "repeated call id".
    """
    names = rows.columns
    own = rows.withColumn("_m", F.col(messages).cast(MESSAGES))
    if tools is None:
        uses = F.exists("_m", lambda m: F.coalesce(m["role"] == "tool", F.lit(False)) | m["tool_calls"].isNotNull())
        same = F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
        return own.select(*names, F.when(~uses, same).alias("plain"), F.when(uses, "tools not offered").alias("fault"))

    none = F.lit(None).cast("string")
    yes = lambda c: F.coalesce(c, F.lit(False))
    leads = yes(F.get("_m", 0)["role"] == "system")
    system = stripped(_joined(F.get("_m", 0)["content"]))
    own = own.withColumns({"_first": F.when(leads, F.coalesce(system, F.lit("\0"))).otherwise(""), "_m": F.when(leads, F.slice("_m", 2, F.size("_m"))).otherwise(F.col("_m"))})
    at = F.filter(F.transform("_m", lambda m, i: F.when(yes(m["role"] == "tool"), none.cast("int")).otherwise(i)), lambda i: i.isNotNull())
    own = own.withColumns({"_at": at, "_n": F.size("_m")})

    def segment(start, k):
        stop = F.coalesce(F.get("_at", k + 1), F.col("_n"))
        m = F.get("_m", start)
        calls = F.when(yes(m["role"] == "assistant"), F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,name:string,arguments:string>>"))).otherwise(
            F.array().cast("array<struct<id:string,name:string,arguments:string>>"))
        made = F.transform(calls, lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), parameters(c["name"], c["arguments"], tools).alias("parameters")))
        results = F.transform(F.slice("_m", start + 2, stop - start - 1), lambda r: F.struct(
            r["tool_call_id"].alias("id"), r["name"].alias("name"), _joined(r["content"]).alias("text"), r["tool_calls"].isNotNull().alias("extra")))
        return F.struct(m.alias("m"), _joined(m["content"]).alias("text"), made.alias("calls"), results.alias("results"), (stop == F.col("_n")).alias("last"))

    own = own.withColumn("_s", F.transform("_at", segment))

    def wrong(s):
        m, calls, results = s["m"], s["calls"], s["results"]
        asks = F.size(calls) > 0
        bad_id = lambda c: yes((stripped(c["id"]) == "") | (F.length(c["id"]) > ID)) | c["id"].isNull()
        results_wrong = F.transform(results, lambda r, j: F.when(j >= F.size(calls), "unasked result").when(
            ~yes(r["id"] == F.get(calls, j)["id"]), "result out of order").when(yes(r["name"] != F.get(calls, j)["name"]), "result name").when(
            r["text"].isNull(), "not text").when(r["extra"], "call fields"))
        own_fault = F.when(asks & (m["tool_call_id"].isNotNull() | m["name"].isNotNull()), "call fields").when(F.size(calls) > CALLS, "number of calls").when(
            F.exists(calls, bad_id), "call id").when(asks & m["content"].isNotNull() & s["text"].isNull(), "not text").when(
            F.exists(calls, lambda c: c["parameters"].isNull()), "bad call")
        open_calls = (F.size(results) < F.size(calls)) & (~s["last"] | (F.size(results) > 0))
        return F.coalesce(own_fault, F.get(F.filter(results_wrong, lambda f: f.isNotNull()), 0), F.when(open_calls, "unanswered call"))

    ids = F.flatten(F.transform("_s", lambda s: F.transform(s["calls"], lambda c: c["id"])))
    first = F.when(F.col("_m").isNull(), "no messages").when(F.col("_first") == "\0", "not text").when(
        (F.col("_n") > 0) & F.coalesce(F.get("_at", 0) > 0, F.lit(True)), "unasked result")
    fault = F.coalesce(first, F.get(F.filter(F.transform("_s", wrong), lambda f: f.isNotNull()), 0), F.when(
        F.size(ids) != F.size(F.array_distinct(ids)), "repeated call id"))

    def written(s):
        m = s["m"]
        text = stripped(F.coalesce(s["text"], F.lit("")))
        calls = F.array_join(F.transform(s["calls"], lambda c: F.concat(
            F.lit("<tool_call>\n<function="), c["name"], F.lit(">\n"), c["parameters"], F.lit("</function>\n</tool_call>"))), "\n")
        answers = F.array_join(F.transform(s["results"], lambda r: F.concat(F.lit("<tool_response>\n"), r["text"], F.lit("\n</tool_response>"))), "\n")
        said = F.when(F.size(s["calls"]) > 0, _message(m["role"], F.concat(text, F.when(text != "", "\n\n").otherwise(""), calls))).otherwise(
            F.struct(m["role"].alias("role"), m["content"].alias("content")))
        return F.when(F.size(s["results"]) > 0, F.array(said, _message("user", answers))).otherwise(F.array(said))

    system_text = F.concat(F.lit(preamble(tools)), F.when(F.col("_first") != "", F.concat(F.lit("\n\n"), "_first")).otherwise(""))
    whole = F.concat(F.array(_message("system", system_text)), F.flatten(F.transform("_s", written)))
    own = own.withColumn("_fault", fault)
    return own.select(*names, F.when(F.col("_fault").isNull(), whole).cast(PLAIN).alias("plain"), F.col("_fault").alias("fault"))


# Messages as MESSAGES has them, and their JSON.


def json_string(c: Column) -> Column:
    """A string as JSON has it with ASCII only: other characters as \\u escapes, those beyond U+FFFF as two."""
    bare = F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    escaped = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    code = F.ascii
    one = lambda x: F.when(code(x) > 0xFFFF, F.concat(
        escaped(F.shiftright(code(x) - 0x10000, 10) + 0xD800), escaped((code(x) - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00))).when(code(x) > 0x7E, escaped(code(x))).otherwise(x)
    return F.when(bare.rlike(r"[^\x00-\x7e]"), F.array_join(F.transform(F.split(bare, ""), one), "")).otherwise(bare)


def json_box(box: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(box.cast("array<string>"), ", "), F.lit("]"))


def turn(role: str, text: Column | None, image: Column | None = None, calls: Column | None = None, answers: Column | None = None) -> Column:
    """One message as wire.MESSAGES has them."""
    none = F.lit(None).cast("string")
    blocks = []
    if image is not None:
        blocks.append(F.struct(F.lit("image").alias("type"), none.alias("text"), image.cast("string").alias("image")))
    if text is not None:
        blocks.append(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), none.alias("image")))
    content = F.array(*blocks) if blocks else F.lit(None).cast("array<struct<type:string,text:string,image:string>>")
    asked = calls if calls is not None else F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>")
    return F.struct(F.lit(role).alias("role"), content.alias("content"), asked.alias("tool_calls"), (none if answers is None else answers).alias("tool_call_id"), none.alias("name"))


def call(identifier: Column, name: Column, arguments: Column) -> Column:
    return F.array(F.struct(identifier.alias("id"), name.alias("name"), arguments.alias("arguments")))
