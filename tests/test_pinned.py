import hashlib
import json

import pytest
from test_images import png

from quarryline.plans import scans
from quarryline.sources import pinned as P


def line(**more):
    image = [{"type": "image", "image": "sheet.png"}, {"type": "text", "text": "Read R1"}]
    row = {"id": "a", "messages": [{"role": "system", "content": [{"type": "text", "text": "s"}]}, {"role": "user", "content": image}, {"role": "assistant", "content": [{"type": "text", "text": "10k"}]}]}
    return row | more


@pytest.fixture
def dataset(tmp_path):
    (tmp_path / "sheet.png").write_bytes(png())

    def write(*rows, name="train.jsonl"):
        path = tmp_path / name
        path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
        return str(path)
    return write


def test_rows_are_of_the_bytes_that_were_checked(spark, dataset, tmp_path):
    path = dataset(line(), "", line(id="b"))
    sha = hashlib.sha256(open(path, "rb").read()).hexdigest()
    rows, used = P.training_rows(spark, path, sha)
    assert sorted((r.id, r.ordinal) for r in rows.collect()) == [("a", 1), ("b", 3)]
    assert {(r.id, r.reference, r.sha256, r.format) for r in used.collect()} == {(i, "sheet.png", hashlib.sha256(png()).hexdigest(), "png") for i in "ab"}
    dataset(line(id="c"))
    assert sorted(r.id for r in rows.collect()) == ["a", "b"]  # what was read is kept
    with pytest.raises(ValueError, match="changed"):
        P.training_rows(spark, path, sha)
    table = spark.createDataFrame([(path, hashlib.sha256(open(path, "rb").read()).hexdigest())], "path string, sha256 string")
    assert P.pinned(spark, path, table).count() == 1
    for other in (table.selectExpr("path", "'x' as sha256"), table.selectExpr("concat(path, '2') as path", "sha256")):
        with pytest.raises(ValueError, match="changed"):
            P.pinned(spark, path, other)


def content(role, *parts):
    return {"role": role, "content": list(parts)}


TEXT, IMAGE = {"type": "text", "text": "t"}, {"type": "image", "image": "sheet.png"}
USER, ANSWER = content("user", IMAGE, TEXT), content("assistant", TEXT)
BAD = [
    ("{", "not JSON"), ("[1]", "not an object"), ('{"id":"x","id":"y"}', "repeated field"), (line(id=""), "no id"), (line(id=None), "no id"), (line(messages=[USER]), "no conversation"),
    (line(messages=[ANSWER, USER]), "roles do not alternate"), (line(messages=[USER, USER, ANSWER]), "roles do not alternate"), (line(messages=[USER, content("system", TEXT)]), "roles do not alternate"),
    (line(messages=[USER, content("assistant")]), "no content"), (line(messages=[USER, content("assistant", IMAGE)]), "neither text nor a user's image"),
    (line(messages=[USER, content("assistant", {"type": "text", "text": " "})]), "neither text nor a user's image"), (line(messages=[USER, ANSWER, USER]), "no final answer"),
    (line(messages=[content("user", TEXT), ANSWER]), "no image"), (line(messages=[{"role": "user", "content": "text"}, ANSWER]), "no content")]


def test_training_faults(spark, dataset):
    path = dataset(*(b for b, _ in BAD), line(id="z"), line(id="z"))
    got = {r.ordinal: r.fault for r in P.training_faults(P.pinned(spark, path)).collect()}
    assert got == {k + 1: f for k, (_, f) in enumerate(BAD)} | {len(BAD) + 2: "repeated id"}
    for rows in ((BAD[0][0],), (), (line(messages=[content("user", {"type": "image", "image": "none.png"}, TEXT), ANSWER]),)):
        with pytest.raises(ValueError):
            P.training_rows(spark, dataset(*rows))


def good(key, output="R1 is 10k."):
    return {"key": key, "output": output, "status": "success", "attempted": True, "finish_reason": "stop", "error": None}


def failed(key):
    return {"key": key, "output": "", "status": "failure", "attempted": True, "finish_reason": "error", "error": {"code": "generation_failed", "caused_by": None}}


def blocked(key, cause):
    return {"key": key, "output": "", "status": "failure", "attempted": False, "finish_reason": "dependency_failed", "error": {"code": "dependency_failed", "caused_by": cause}}


def faults(spark, *records, generated=True):
    df = spark.createDataFrame([tuple(None if r[k] is None else (r[k]["code"], r[k]["caused_by"]) if k == "error" else r[k] for k in ("key", "output", "status", "attempted", "finish_reason", "error"))
                                for r in records], P.RECORD)
    gold = spark.createDataFrame([("a", 3), ("b", 1)], "id string, n_turns int")
    return {(r.key, r.fault) for r in P.chain_faults(df, gold, generated).collect()}


def test_recorded_chains(spark):
    b = good("b#0")
    run = lambda *a, **more: faults(spark, *a, b, **more)
    assert run(good("a#0"), good("a#1"), good("a#2")) == set()
    assert run(good("a#0"), failed("a#1"), blocked("a#2", "a#1")) == set()
    assert run(good("a#0"), failed("a#1"), good("a#2"), generated=False) == set()
    assert run(failed("a#0"), failed("a#1"), good("a#2"), generated=False) == set()
    assert run(failed("a#0"), blocked("a#1", "a#0"), blocked("a#2", "a#1")) == {("a#2", "not blocked by its cause")}
    assert run(failed("a#0"), good("a#1"), failed("a#2")) == {("a#1", "not blocked by its cause"), ("a#2", "not blocked by its cause")}
    assert run(blocked("a#0", "nonexistent"), blocked("a#1", "a#0"), blocked("a#2", "a#0")) == {("a#0", "unsound generation failure")}
    assert run(failed("a#0"), blocked("a#1", "a#0"), good("a#2"), generated=False) == {("a#1", "unsound generation failure")}
    assert run(good("a#0"), good("a#1")) == {("a#2", "no record")}
    assert run(good("a#0"), good("a#1"), good("a#2"), good("a#2"), good("a#3")) == {("a#2", "repeated key"), ("a#3", "no such turn")}
    for bad in ({"finish_reason": "length"}, {"attempted": False}, {"output": ""}, {"output": " R1"}, {"output": "<think>x</think>R1"}, {"error": {"code": "x", "caused_by": None}}):
        assert run(good("a#0"), good("a#1") | bad, good("a#2")) == {("a#1", "unsound success")}
    assert run(good("a#0"), good("a#1") | {"status": "odd"}, good("a#2")) == {("a#1", "unknown status")}
    assert ("a#1", "unsound failure") in run(good("a#0"), failed("a#1") | {"output": "x"}, blocked("a#2", "a#1"))


def test_keys_that_name_no_turn(spark):
    turns = [good("a#0"), good("a#1"), good("a#2"), good("b#0")]
    odd = ["a", "a#01", "a#-1", "a#", "#", "", "a#x", "a#9999999999", "a#3", "c#0", "a#0#0"]
    assert faults(spark, *turns, *map(failed, odd)) == {(k, "no such turn") for k in odd}
    assert faults(spark, *turns, failed("a"), failed("a"), failed(None)) == {("a", "no such turn"), ("a", "repeated key"), (None, "no such turn")}
    assert faults(spark) == {(k, "no record") for k in ("a#0", "a#1", "a#2", "b#0")}
    assert faults(spark, good("a#1"), good("a#1"), good("a#7")) == {("a#0", "no record"), ("a#2", "no record"), ("b#0", "no record"), ("a#1", "repeated key"), ("a#7", "no such turn")}


def test_records_are_dealt_once(spark, sf_dir, capsys):
    scans.recorded_chains(spark, sf_dir).explain()
    assert capsys.readouterr().out.count("Exchange") == 3  # line items, their orders, and records with gold rows


def test_records_of_a_file(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    gold = spark.createDataFrame([("b", 1)], "id string, n_turns int")
    path.write_text(json.dumps(good("b#0")) + "\n")
    sha = hashlib.sha256(path.read_bytes()).hexdigest()
    assert P.benchmark_records(spark, str(path), gold, True, sha).first().output == "R1 is 10k."
    path.write_text(path.read_text().replace("10k", "20k"))
    with pytest.raises(ValueError, match="changed"):
        P.benchmark_records(spark, str(path), gold, True, sha)
    path.write_text(json.dumps(good("b#0") | {"finish_reason": "length"}) + "\n")
    with pytest.raises(ValueError, match="would record"):
        P.benchmark_records(spark, str(path), gold, True)
