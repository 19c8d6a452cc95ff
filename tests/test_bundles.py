import copy
import hashlib
import json

import pytest

from quarryline.sources import bundles as B


def talk(id, n, system=False):
    messages = [{"role": "system", "content": "s"}] if system else []
    for k in range(n):
        image = [{"type": "image", "image": f"{id}{k // 2}.png"}] if k % 2 == 0 else []
        messages += [{"role": "user", "content": [*image, {"type": "text", "text": f"q{k}"}]}, {"role": "assistant", "content": f"r{k}"}]
    return {"id": id, "messages": messages, "gold": [{"type": "value"}] * n}


ROWS = [talk("a", 3, True), talk("b", 1)]
KEYS = ["a#0", "a#1", "a#2", "b#0"]


def records(bad=()):
    out, cause = [], None
    for k in KEYS:
        cause = None if k.endswith("#0") else cause
        out.append({"key": k, "output": f"answer {k}", "status": "success", "attempted": True, "finish_reason": "stop", "error": None, "elapsed_seconds": 1.5, "usage": {"total_tokens": 3}})
        if cause:
            out[-1] |= {"output": "", "status": "failure", "attempted": False, "finish_reason": "dependency_failed", "error": {"code": "dependency_failed", "caused_by": cause}}
        elif k in bad:
            out[-1] |= {"output": "", "status": "failure", "finish_reason": "error", "error": {"code": "generation_failed"}}
            cause = k
    return out


@pytest.fixture
def made(spark, tmp_path):
    path = tmp_path / "data.jsonl"
    path.write_text("".join(json.dumps(r) + "\n" for r in ROWS))
    sha = hashlib.sha256(path.read_bytes()).hexdigest()

    def write(name, bad=(), meta=(), report=(), settings=(), edit=None):
        own = records(bad)
        if edit:
            edit(own)
        text = "".join(json.dumps(r) + "\n" for r in own)
        m = {"schema_version": 1, "runner": "failure-accounted-benchmark", "dataset_sha256": sha, "history": "generated", "profile": "real-vision", "max_tokens": 64, "temperature": 0.0,
             "images_sha256": {i: "0" * 64 for i in ("a0.png", "a1.png", "b0.png")},
             "deployment": {"model": {"sha256": "1" * 64, "files": []}, "packages": {}, "settings": {"max_seq": 4096, "max_image_size": 1024, "max_tokens": 64, "seed": 1, "four_bit": True} | dict(settings)}} | dict(meta)
        failed = sum(r["status"] == "failure" for r in own)
        r = {"schema_version": 1, "predictions_sha256": hashlib.sha256(text.encode()).hexdigest(), "provenance": m, "profile": m["profile"], "turns": 4, "conversations": 2,
             "attempted_turns": sum(r["attempted"] for r in own), "failed_turns": failed, "successful_turns": 4 - failed, "failure_rate": failed / 4,
             "metrics": {"value.exact": 0.5}, "counts": {"value.exact": 4}} | dict(report)
        for suffix, data in (("", text), (".meta.json", json.dumps(m)), (".report.json", json.dumps(r))):
            (tmp_path / f"{name}.jsonl{suffix}").write_text(data)
        return str(tmp_path / f"{name}.jsonl")
    return B.dataset(spark, str(path)), write


def test_bounds_are_counted_while_reading():
    nested = lambda n: '{"a":' + "[" * n + "]" * n + "}"
    assert B.bounded_error(nested(40)) is None and B.bounded_error(nested(41)) == "too deep"
    assert B.bounded_error('{"a":[' + ",".join(["1"] * 50) + "]}", values=52) is None and B.bounded_error('{"a":[' + ",".join(["1"] * 50) + "]}", values=51) == "too many values"
    assert B.bounded_error('{"[[[{":"]]]","b":"\\"[["}', depth=1) is None
    assert B.bounded_error("[" * 10_000_000) == "too deep"
    assert B.bounded_error('{"a":1,"a":2}') == "repeated field" and B.bounded_error('{"a":1e999}') == "non-finite number" and B.bounded_error(None) == "not JSON"


def test_cases(made):
    cases, _ = made
    got = {r.key: r for r in cases.turns.collect()}
    assert list(got) and set(got) == set(KEYS) and cases.conversations == 2 and cases.images == {"a0.png", "a1.png", "b0.png"}
    assert (got["a#2"].question, got["a#2"].reference, got["a#2"].images) == ("q2", "r2", ["a0.png", "a1.png"])
    assert [tuple(h) for h in got["a#2"].history] == [("system", "s"), ("user", "q0"), ("assistant", "r0"), ("user", "q1"), ("assistant", "r1")]
    assert got["a#1"].images == ["a0.png"] and got["b#0"].history == []


@pytest.mark.parametrize("row", [talk("a#", 1), talk("", 1), talk("a", 1) | {"gold": []}, talk("a", 1) | {"gold": [{"type": "value"}] * 2}, talk("a", 1) | {"gold": [{"type": "Bad"}]},
                                 talk("a", 65), talk("a", 1) | {"messages": list(reversed(talk("a", 1)["messages"]))},
                                 talk("a", 1) | {"messages": [{"role": "user", "content": " "}, {"role": "assistant", "content": "r"}]},
                                 talk("a", 1) | {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "image", "image": "x"}, {"type": "text", "text": "r"}]}]},
                                 talk("a", 1) | {"messages": [{"role": "user", "content": [{"type": "video"}]}, {"role": "assistant", "content": "r"}]}])
def test_unsound_rows(spark, tmp_path, row):
    path = tmp_path / "bad.jsonl"
    path.write_text(json.dumps(row) + "\n" + json.dumps(talk("z", 1)) + "\n")
    with pytest.raises(ValueError):
        B.dataset(spark, str(path))


def test_two_runs_side_by_side(spark, made):
    cases, write = made
    a, b = B.run(spark, write("a", bad=["a#1"]), cases), B.run(spark, write("b", edit=lambda r: r[3].update(output="other")), cases)
    got = {r.key: (r.question, r.a_status, r.b_status, r.kind) for r in B.pairs(a, b, cases).collect()}
    assert got == {"a#0": ("q0", "success", "success", "same"), "a#1": ("q1", "failure", "success", "a fails"), "a#2": ("q2", "failure", "success", "a fails"),
                   "b#0": ("q0", "success", "success", "texts differ")}
    for change in ({"settings": {"seed": 2}}, {"settings": {"agent_tools": True}}, {"meta": {"temperature": 0.5}}, {"meta": {"profile": "other"}}):
        with pytest.raises(ValueError, match="differ"):
            B.pairs(a, B.run(spark, write("c", **change), cases), cases)


BAD = [
    {"meta": {"dataset_sha256": "2" * 64}}, {"meta": {"runner": "x"}}, {"meta": {"history": "none"}}, {"meta": {"images_sha256": {"a0.png": "0" * 64}}}, {"meta": {"max_tokens": 65}},
    {"report": {"predictions_sha256": "2" * 64}}, {"report": {"provenance": {}}}, {"report": {"turns": 5}}, {"report": {"failure_rate": 0.5}}, {"report": {"metrics": {"x": 2}, "counts": {"x": 1}}},
    {"report": {"counts": {}}}, {"settings": {"seed": "1"}}, {"edit": lambda r: r[0].update(finish_reason="length")}, {"edit": lambda r: r[0].update(key="a#9")}, {"edit": lambda r: r[0].update(elapsed_seconds=-1)},
    {"edit": lambda r: r[0].update(usage={"total_tokens": -3})}, {"edit": lambda r: r[0].update(model_fingerprint="x")},
    {"edit": lambda r: [x.update(model_fingerprint=str(k % 2) * 64) for k, x in enumerate(r)]}, {"edit": lambda r: r[1].update(records(["a#1"])[2], key="a#1")}]


@pytest.mark.parametrize("change", BAD)
def test_files_that_disagree(spark, made, change):
    cases, write = made
    with pytest.raises(ValueError):
        B.run(spark, write("x", **copy.copy(change)), cases)
