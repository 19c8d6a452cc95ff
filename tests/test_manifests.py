import copy
import hashlib
import json

import pytest

from quarryline.operators import lessons
from quarryline.sources import manifests, snapshots


def test_sources_and_their_files(spark, tmp_path):
    folder = tmp_path / "sources"
    sha = {}
    for name in ("a__x/b.sch", "a__x/LICENSE", "c__y/LICENSE", "c__y/d.sch"):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(name)
        sha[name] = hashlib.sha256(name.encode()).hexdigest()
    family = lambda r, s, f, **more: {"repository": r, "revision": "a" * 40, "split": s, "license": "CC-BY-SA-4.0", "license_path": "LICENSE", "license_sha256": sha[f"{r.replace('/', '__')}/LICENSE"],
                                      "sources": [{"path": f, "sha256": sha[f"{r.replace('/', '__')}/{f}"]}]} | more
    good = [family("a/x", "train", "b.sch", excluded_sources=[{"path": "old.sch", "sha256": "0" * 64, "reason": "old"}]), family("c/y", "val", "d.sch")]

    def write(families):
        path = tmp_path / "manifest.json"
        path.write_text(json.dumps({"version": 1, "families": families}, indent=2))
        return str(path)

    rows = manifests.sources(spark, write(good))
    assert {(r.repository, r.kind, r.path, r.reason) for r in rows.collect()} == {
        ("a/x", "source", "b.sch", None), ("a/x", "excluded", "old.sch", "old"), ("a/x", "licence", "LICENSE", None), ("c/y", "source", "d.sch", None), ("c/y", "licence", "LICENSE", None)}
    faults = lambda: {(r.repository, r.path, r.fault) for r in manifests.differing(rows, snapshots.fingerprints(spark, str(folder)), str(folder)).collect()}
    assert faults() == set()
    (folder / "c__y/d.sch").write_text("other")
    (folder / "a__x/LICENSE").unlink()
    assert faults() == {("c/y", "d.sch", "changed"), ("a/x", "LICENSE", "missing")}
    for edit in (lambda f: f[0].update(revision="main"), lambda f: f[0]["sources"][0].update(sha256="x"), lambda f: f[0].update(repository="x"), lambda f: f.append(f[0] | {"split": "test"}),
                 lambda f: f[0]["sources"].append(f[0]["sources"][0]), lambda f: [x.update(sources=[]) for x in f], lambda f: f[1].update(split="dev")):
        bad = copy.deepcopy(good)
        edit(bad)
        with pytest.raises(ValueError):
            manifests.sources(spark, write(bad))


def test_page_changes(spark):
    parts = [("s", 1, "U2", "NE555", True), ("s", 1, "R1", "10k", True), ("s", 1, "A1", "1", True), ("s", 3, "C9", "", True), ("s", 3, "R7", "22k", True), ("s", 3, "R5", "5k", False), ("s", 4, "R0", "1", True),
             ("t", 1, "R1", "1k", True), ("u", 1, "R1", "1k", True), ("u", 2, "R2", "1k", False)]
    rows = lessons.page_changes(spark.createDataFrame(parts, "source string, page long, refdes string, value string, region boolean"), ["source"]).orderBy("turn").collect()
    assert [(r.source, r.turn, r.page, r.tool, r.argument, r.expected, r.may_move, r.refusal) for r in rows] == [
        ("s", 0, 1, "show_label", "R1", None, True, False), ("s", 1, 3, None, None, "22k", False, False), ("s", 2, 3, None, None, None, False, True), ("s", 3, 3, "show_label", "R7", None, True, False)]
    assert rows[1].question == "I changed to page 3. Read the value of R7 here without moving the view." and rows[1].answer == "R7 is marked 22k."
