import copy
import hashlib
import json

import pytest
from test_images import png
from test_sources import SCHEMATIC

from quarryline.sources import catalogue

PUBLISHERS = {"acme": ("Acme", "CC-BY-SA-4.0")}


@pytest.fixture
def corpus(tmp_path):
    source = tmp_path / "sources/acme__Acme-Test_Board-PCB/x/board.sch"
    source.parent.mkdir(parents=True)
    source.write_text(SCHEMATIC.format(pin="a"))
    (tmp_path / "images").mkdir()
    (tmp_path / "images/sheet.png").write_bytes(png())
    (tmp_path / "images/other.png").write_bytes(b"no image")
    sha = lambda p: hashlib.sha256(p.read_bytes()).hexdigest()
    record = {"repository": "acme/Acme-Test_Board-PCB", "commit": "a" * 40, "id": "real-0123456789abcdef", "source_path": "x/board.sch", "sha256": sha(source), "license": "CC-BY-SA-4.0",
              "images": [{"page": 1, "path": "images/sheet.png", "sha256": sha(tmp_path / "images/sheet.png")}]}

    def write(*records):
        (tmp_path / "manifest.jsonl").write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))
        return str(tmp_path)
    return record, write


def test_pages(spark, corpus):
    record, write = corpus
    row = catalogue.catalogue(spark, write(record), PUBLISHERS).collect()
    assert [(r.id, r.title, r.publisher, r.page, r.revision) for r in row] == [("real-0123456789abcdef-p1", "Test Board", "Acme", 1, "a" * 40)]
    assert row[0].questions == ["What value is shown for R1?", catalogue.BENCH] and row[0].image_sha256 == record["images"][0]["sha256"]


def changed(record, **more):
    return copy.deepcopy(record) | more


def image(record, **more):
    return changed(record, images=[record["images"][0] | more])


FAULTS = [
    (lambda r: changed(r, sha256="0" * 64), "source changed"), (lambda r: changed(r, source_path="x/none.sch"), "source missing"), (lambda r: changed(r, source_path="../../etc/passwd"), "path outside"),
    (lambda r: changed(r, repository=None), "no record"), (lambda r: changed(r, repository="other/x"), "unknown publisher"), (lambda r: changed(r, commit="abc"), "not pinned"),
    (lambda r: changed(r, license="MIT"), "not pinned"), (lambda r: changed(r, id="x"), "not pinned"), (lambda r: changed(r, images=[]), "no pages"), (lambda r: changed(r, images=None), "no pages"),
    (lambda r: changed(r, images=[None]), "no such page"), (lambda r: image(r, page=999), "no such page"), (lambda r: image(r, page=0), "no such page"), (lambda r: image(r, path="../x.png"), "path outside"),
    (lambda r: image(r, path="images/none.png"), "image missing"), (lambda r: image(r, path="images/other.png"), "no png"), (lambda r: image(r, sha256="0" * 64), "image changed"),
    (lambda r: changed(r, images=r["images"] * 2), "repeated page"), (lambda r: "[1]", "no record"), (lambda r: '{"id":1,"id":2}', "no record")]


def test_faults(spark, corpus):
    record, write = corpus
    others = [f(record) for f, _ in FAULTS if _ != "repeated page"]
    pages, faults = catalogue.entries(spark, write(record, *others), PUBLISHERS)
    want = {k + 2: f for k, f in enumerate(f for _, f in FAULTS if f != "repeated page")}
    assert {r.record: r.fault for r in faults.collect()} == want and pages.count() == 1
    with pytest.raises(ValueError, match="repeated page"):
        catalogue.catalogue(spark, write(changed(record, images=record["images"] * 2)), PUBLISHERS)
    with pytest.raises(ValueError, match="source changed"):
        catalogue.catalogue(spark, write(changed(record, sha256="0" * 64)), PUBLISHERS)
