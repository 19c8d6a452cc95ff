import hashlib
import json
import os

import pytest

from quarryline.sources import objects, snapshots

SCHEMA = "family_id string, text string, n int"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([("f1", "train", "é", None), ("f1", "train", "b", 2), ("f2", "val", "c", 3)], "family_id string, split string, text string, n int")


@pytest.fixture
def inputs(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("a")
    (tmp_path / "in/deep/b.txt").write_text("b")
    return snapshots.recorded(spark, str(tmp_path / "in"))


def files(spark, *rows):
    return spark.createDataFrame(rows or [("images/x.png", b"x"), ("images/y.png", b"y")], "name string, content binary")


def published(tmp_path):
    return sorted(p for p in os.listdir(tmp_path) if p != "in")


def test_what_was_written_is_what_is_named(spark, rows, inputs, tmp_path):
    one = snapshots.publish(rows, str(tmp_path / "one"), inputs=inputs, files=files(spark))
    assert {(r.split, r.n_rows, r.n_families) for r in one.collect()} == {("train", 2, 1), ("val", 1, 1)} and published(tmp_path) == ["one"]
    snapshots.publish(rows.repartition(3), str(tmp_path / "two"), inputs=inputs, files=files(spark))
    assert snapshots.snapshot_digest(spark, str(tmp_path / "one")) == snapshots.snapshot_digest(spark, str(tmp_path / "two"))
    snapshots.publish(rows, str(tmp_path / "three"), files=files(spark, ("images/x.png", b"x")))
    assert snapshots.snapshot_digest(spark, str(tmp_path / "three")) != snapshots.snapshot_digest(spark, str(tmp_path / "one"))
    found = spark.read.json(str(tmp_path / "one/_manifest/artifacts")).collect()
    assert {"_files/images/x.png", "_files/images/y.png"} < {r.path for r in found} and len(found) >= 4
    for r in found:
        assert hashlib.sha256((tmp_path / "one" / r.path).read_bytes()).hexdigest() == r.sha256
    assert snapshots.verified(spark, str(tmp_path / "one"), SCHEMA, family="family_id").count() == 3


@pytest.mark.parametrize("change", [lambda d: (d / "a.txt").write_text("other"), lambda d: (d / "a.txt").unlink(), lambda d: (d / "new").write_text("n")])
def test_changed_input_stops_before_a_byte_is_visible(spark, rows, inputs, tmp_path, change):
    change(tmp_path / "in")
    with pytest.raises(ValueError, match="changed after planning"):
        snapshots.publish(rows, str(tmp_path / "out"), inputs=inputs)
    assert published(tmp_path) == []


def test_input_that_changes_while_it_is_written(spark, rows, inputs, tmp_path, monkeypatch):
    place = objects.place

    def late(*args):
        (tmp_path / "in/a.txt").write_text("late")
        return place(*args)

    monkeypatch.setattr(objects, "place", late)
    with pytest.raises(ValueError, match="changed after planning"):
        snapshots.publish(rows, str(tmp_path / "out"), inputs=inputs, files=files(spark))
    assert published(tmp_path) == []


def test_torn_publish_leaves_nothing(spark, rows, inputs, tmp_path, monkeypatch):
    def torn(*args):
        raise OSError("disk is full")

    monkeypatch.setattr(objects, "place", torn)
    with pytest.raises(OSError):
        snapshots.publish(rows, str(tmp_path / "out"), inputs=inputs, files=files(spark))
    assert published(tmp_path) == []
    monkeypatch.undo()
    monkeypatch.setattr(snapshots, "_artifacts", torn)
    with pytest.raises(OSError):
        snapshots.publish(rows, str(tmp_path / "out"))
    assert published(tmp_path) == [] and (tmp_path / "in/a.txt").read_text() == "a"


def test_destinations_are_never_overwritten_nor_inside_inputs(spark, rows, inputs, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "old/keep").write_text("keep")
    os.symlink(tmp_path / "in", tmp_path / "alias")
    with pytest.raises(ValueError, match="already exists"):
        snapshots.publish(rows, str(tmp_path / "old"), inputs=inputs)
    for path in ("in/new", "in/deep/x/y", "alias/new"):
        with pytest.raises(ValueError, match="inside the input"):
            snapshots.publish(rows, str(tmp_path / path), inputs=inputs)
    snapshots.require_free(spark, str(tmp_path / "in-other"), [str(tmp_path / "in")])
    assert (tmp_path / "old/keep").read_text() == "keep" and published(tmp_path) == ["alias", "old"] and sorted(os.listdir(tmp_path / "in")) == ["a.txt", "deep"]


def test_tampering_is_noticed(spark, rows, tmp_path):
    def fresh(name):
        snapshots.publish(rows, str(tmp_path / name), files=files(spark))
        return tmp_path / name

    def refuses(path):
        with pytest.raises(ValueError, match="manifest"):
            snapshots.verified(spark, str(path), SCHEMA)

    path = fresh("a")
    (path / "_files/images/x.png").write_bytes(b"other")
    refuses(path)
    path = fresh("b")
    (path / "_files/images/z.png").write_bytes(b"more")
    refuses(path)
    path = fresh("c")
    part = next((path / "split=val").glob("part-*"))
    part.write_text(part.read_text().replace('"c"', '"d"'))
    (part.parent / f".{part.name}.crc").unlink()
    refuses(path)
    path = fresh("d")
    for part in (path / "_manifest/splits").glob("part-*"):
        part.write_text("".join(json.dumps(json.loads(x) | {"n_rows": 9}) + "\n" for x in part.read_text().splitlines()))
        (part.parent / f".{part.name}.crc").unlink()
    refuses(path)


def test_ownership(spark):
    own = spark.createDataFrame([("f1", "s1", "train", ["a.png"]), ("f2", "s1", "val", ["b.png", "none.png"]), ("f1", "s2", "test", ["a.png"]), (" ", None, "train", []), ("f4", "s4", "val", ["c.png"])],
                                "family_id string, source_sha256 string, split string, images array<string>")
    named = spark.createDataFrame([("a.png", "1", "train"), ("b.png", "2", "val"), ("c.png", "1", "val")], "name string, sha256 string, split string")
    assert {tuple(r) for r in snapshots.ownership_faults(own, named).collect()} == {
        ("family_id", " ", "no owner"), ("family_id", "f1", "crosses splits"), ("source_sha256", "s1", "crosses splits"), ("image", "none.png", "not in the manifest"),
        ("image", "a.png", "other split"), ("image digest", "1", "crosses splits")}
    assert snapshots.ownership_faults(own.limit(0), named).count() == 0
