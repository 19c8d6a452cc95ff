import copy
import json
import random

import pytest

from quarryline.operators import wire


def call(name, arguments, k=0):
    return {"id": f"call-{k}", "name": name, "arguments": json.dumps(arguments)}


def said(role, text, **more):
    return {"role": role, "content": None if text is None else [{"type": "text", "text": text}]} | more


TALK = [
    said("system", " Answer from the image.\n"), said("user", "Show me R1."), said("assistant", None, tool_calls=[call("show_label", {"label": " R1 "})]),
    said("tool", '{"status": "shown"}', tool_call_id="call-0"), said("assistant", "Showing R1."), said("user", "Frame R1 and C2, then zoom out."),
    said("assistant", " Two steps.", tool_calls=[call("show_region", {"label": "R1 and C2", "box": [1, 2, 300, 400]}, 1), call("show_full_sheet", {}, 2)]),
    said("tool", "one", tool_call_id="call-1"), said("tool", "two", tool_call_id="call-2", name="show_full_sheet")]


def plain(spark, talks, tools=wire.VIEWER):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(talks)], f"i int, messages {wire.MESSAGES}")
    got = wire.plain(df.selectExpr("*", "1 as plain_", "2 as _x"), tools=tools).orderBy("i").collect()
    return [(r.plain and [(m.role, [b.text for b in m.content]) for m in r.plain], r.fault) for r in got]


def test_wire_format(spark):
    want = [("system", [wire.preamble(wire.VIEWER) + "\n\nAnswer from the image."]), ("user", ["Show me R1."]),
            ("assistant", ["<tool_call>\n<function=show_label>\n<parameter=label>\nR1\n</parameter>\n</function>\n</tool_call>"]),
            ("user", ['<tool_response>\n{"status": "shown"}\n</tool_response>']), ("assistant", ["Showing R1."]), ("user", ["Frame R1 and C2, then zoom out."]),
            ("assistant", ["Two steps.\n\n<tool_call>\n<function=show_region>\n<parameter=box>\n[1, 2, 300, 400]\n</parameter>\n<parameter=label>\nR1 and C2\n</parameter>\n</function>\n"
                           "</tool_call>\n<tool_call>\n<function=show_full_sheet>\n</function>\n</tool_call>"]),
            ("user", ["<tool_response>\none\n</tool_response>\n<tool_response>\ntwo\n</tool_response>"])]
    bare = [("system", [wire.preamble(wire.VIEWER)])]
    got = plain(spark, [TALK, TALK[1:5], TALK[:3], [], [said("user", "hi")]])
    assert got == [(want, None), (bare + want[1:5], None), (want[:3], None), (bare, None), ([*bare, ("user", ["hi"])], None)]
    tools = wire.preamble(wire.VIEWER).split("<tools>\n")[1].split("\n</tools>")[0].split("\n")
    assert [json.loads(t)["function"]["name"] for t in tools] == list(wire.VIEWER)
    assert [json.dumps(json.loads(t), ensure_ascii=False) for t in wire.TOOLS.values()] == list(wire.TOOLS.values())


def test_without_tools(spark):
    quiet = [said("user", "q"), said("assistant", "a")]
    assert plain(spark, [quiet, TALK], None) == [([("user", ["q"]), ("assistant", ["a"])], None), (None, "tools not offered")]


def edited(edit):
    talk = copy.deepcopy(TALK)
    edit(talk)
    return talk


def swap(t):
    t[7], t[8] = t[8], t[7]


FAULTS = [
    (lambda t: t[3].pop("tool_call_id"), "result out of order"), (lambda t: t[3].update(tool_call_id="other"), "result out of order"),
    (lambda t: t[8].update(tool_call_id="call-1"), "result out of order"), (lambda t: t[7].update(tool_call_id="call-0"), "result out of order"), (swap, "result out of order"),
    (lambda t: t[3].update(name="show_full_sheet"), "result name"), (lambda t: t.pop(), "unanswered call"), (lambda t: t.pop(3), "unanswered call"), (lambda t: t.pop(2), "unasked result"),
    (lambda t: t.insert(4, said("tool", "more", tool_call_id="call-0")), "unasked result"), (lambda t: t.__setitem__(slice(0, 3), []), "unasked result"),
    (lambda t: t[6]["tool_calls"][1].update(id="call-0") or t[8].update(tool_call_id="call-0"), "repeated call id"),
    (lambda t: t[6].update(tool_calls=[call("show_full_sheet", {}, 10 + k) for k in range(5)]), "number of calls"),
    (lambda t: t[2].update(name="x"), "call fields"), (lambda t: t[0].update(content=[{"type": "image", "image": "x.png"}]), "not text"),
    (lambda t: t[6].update(content=[{"type": "image", "image": "x.png"}]), "not text"), (lambda t: t[7].update(content=None), "not text"),
    *((lambda t, i=i: t[2]["tool_calls"][0].update(id=i), "call id") for i in (None, "", " ", "x" * 129)),
    *((lambda t, n=n, a=a: t[2]["tool_calls"][0].update(name=n, arguments=a), "bad call") for n, a in (
        ("show_label", '{"label": "R1; rm"}'), ("show_label", "{}"), ("show_label", "not json"), ("show_label", '["R1"]'), ("show_label", '{"label": 5}'),
        ("show_label", '{"label": "' + "R" * 65 + '"}'), ("show_full_sheet", '{"page": 2}'), ("show_region", '{"box": [0, 0, 10]}'), ("show_region", '{"box": [0, 0, 10, 10.5]}'),
        ("show_region", '{"box": [true, 0, 10, 10]}'), ("show_region", '{"box": [5, 5, 1, 1]}'), ("show_region", '{"box": [0, 0, 1001, 9]}'), ("show_region", '{"box": [0, 0, 9, 9], "label": ""}'),
        ("show_region", '{"box": "0 0 9 9"}'), ("open_url", '{"url": "https://example.com"}'), ("web_search", '{"query": "x"}'), (None, "{}"), ("show_label", None)))]


def test_faults(spark):
    got = plain(spark, [edited(e) for e, _ in FAULTS])
    assert got == [(None, f) for _, f in FAULTS]


def test_a_conversation_may_end_with_calls(spark):
    got = plain(spark, [TALK[:7], edited(lambda t: t.__delitem__(slice(7, 9)))])
    assert [f for _, f in got] == [None, None]


def test_agent_tools(spark):
    ask = lambda name, text: [said("assistant", None, tool_calls=[{"id": "a", "name": name, "arguments": text}])]
    good = {("web_search", '{"query": " x "}'): "<parameter=query>\n x \n</parameter>\n",
            ("calculate", '{"operation": "add", "b": 2, "a": 1.5}'): "<parameter=operation>\nadd\n</parameter>\n<parameter=b>\n2\n</parameter>\n<parameter=a>\n1.5\n</parameter>\n"}
    bad = [("web_search", '{"query": " "}'), ("web_search", '{"query": "x", "n": 1}'), ("web_search", json.dumps({"query": "x" * 501})), ("calculate", '{"operation": "pow", "a": 1, "b": 2}'),
           ("calculate", '{"operation": "add", "a": true, "b": 2}'), ("calculate", '{"operation": "add", "a": 1}'), ("calculate", '{"operation": "add", "a": 1e101, "b": 2}')]
    got = plain(spark, [ask(*k) for k in (*good, *bad)], wire.AGENT)
    assert [f for _, f in got] == [None] * len(good) + ["bad call"] * len(bad)
    assert [m[1][1][0] for m, _ in got[: len(good)]] == [f"<tool_call>\n<function={n}>\n{p}</function>\n</tool_call>" for (n, _), p in good.items()]


def one_by_one(talk):
    """The rules told message by message: open calls, ids seen so far."""
    out, waiting, seen = [("system", wire.preamble(wire.VIEWER))], [], set()
    repeated = False
    for k, m in enumerate(talk):
        text = "".join(b["text"] for b in m["content"] or [])
        if m["role"] == "tool":
            if not waiting:
                return "unasked result"
            if m.get("tool_call_id") != waiting[0]:
                return "result out of order"
            waiting.pop(0)
            block = f"<tool_response>\n{text}\n</tool_response>"
            if talk[k - 1]["role"] == "tool":
                out[-1] = ("user", out[-1][1] + "\n" + block)
            else:
                out.append(("user", block))
            continue
        if waiting:
            return "unanswered call"
        if m.get("tool_calls"):
            waiting = [c["id"] for c in m["tool_calls"]]
            repeated |= len({*waiting} - seen) < len(waiting)
            seen |= {*waiting}
            text = "\n".join("<tool_call>\n<function=show_full_sheet>\n</function>\n</tool_call>" for _ in waiting)
        out.append((m["role"], text))
    if waiting and talk[-1]["role"] == "tool":
        return "unanswered call"
    return "repeated call id" if repeated else out


def test_any_order_of_messages(spark):
    r, talks = random.Random(3), []
    for _ in range(300):
        talk, n = [], 0
        for _ in range(r.randrange(9)):
            kind = r.choice(["user", "call", "call", "tool", "tool", "tool"])
            if kind == "call":
                k = r.randrange(1, 3)
                talk.append(said("assistant", None, tool_calls=[call("show_full_sheet", {}, max(0, n + j - (r.random() < 0.05))) for j in range(k)]))
                n += k
            else:
                done = sum(m["role"] == "tool" for m in talk)
                talk.append(said("user", f"u{len(talk)}") if kind == "user" else said("tool", f"r{len(talk)}", tool_call_id=f"call-{done if r.random() < 0.95 else 0}"))
        talks.append(talk)
    want = [one_by_one(t) for t in talks]
    got = [f if f else [(role, text[0]) for role, text in p] for p, f in plain(spark, talks)]
    assert got == want and len({w if isinstance(w, str) else "" for w in want}) >= 4


def test_empty(spark):
    df = spark.createDataFrame([], f"messages {wire.MESSAGES}")
    assert wire.plain(df).count() == 0
    assert [r.fault for r in wire.plain(spark.createDataFrame([(None,)], f"messages {wire.MESSAGES}")).collect()] == ["no messages"]
