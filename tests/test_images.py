import hashlib
import os
import struct
import zlib

import pytest

from quarryline.sources import images, objects


def png(text=b""):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"tEXt", text) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def webp(body=b"VP8 rest"):
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def ask(spark, folder, *refs, **more):
    found = spark.createDataFrame([(i, r) for i, r in enumerate(refs)], "i int, reference string")
    rows = images.resolved(found, images.scan(spark, str(folder), **more), f"{folder}/nested/test.jsonl").collect()
    return [(r.path and os.path.relpath(r.path, folder), r.format, r.fault) for r in sorted(rows, key=lambda r: r.i)]


def test_both_roots_and_faults(spark, tmp_path):
    put(tmp_path / "nested/sheet.png", png())
    put(tmp_path / "images/up.jpg", b"\xff\xd8\xff\xe0rest\xff\xd9")
    put(tmp_path / "nested/both.png", png(b"a"))
    put(tmp_path / "both.png", png(b"b"))
    put(tmp_path / "nested/w.webp", webp())
    put(tmp_path / "nested/torn.png", png()[:-3])
    put(tmp_path / "nested/torn.webp", webp()[:-1])
    put(tmp_path / "nested/g.gif", b"GIF89a")
    put(tmp_path / "nested/long.png", png(b"x" * 5000))
    absolute = str(tmp_path / "images/up.jpg")
    got = ask(spark, tmp_path, "sheet.png", "images/up.jpg", "both.png", "w.webp", "torn.png", "torn.webp", "g.gif", "long.png", "none.png", "", " ", None,
              "./x/../sheet.png", "../nested/sheet.png", absolute, "file://" + absolute, limit=4000)
    assert got == [("nested/sheet.png", "png", None), ("images/up.jpg", "jpeg", None), (None, None, "ambiguous"), ("nested/w.webp", "webp", None),
                   ("nested/torn.png", None, "no image"), ("nested/torn.webp", None, "no image"), ("nested/g.gif", None, "no image"), ("nested/long.png", None, "too long"),
                   (None, None, "missing"), (None, None, "no reference"), (None, None, "no reference"), (None, None, "no reference"),
                   ("nested/sheet.png", "png", None), ("nested/sheet.png", "png", None), ("images/up.jpg", "jpeg", None), ("images/up.jpg", "jpeg", None)]


def test_alias_is_not_ambiguous(spark, tmp_path):
    put(tmp_path / "nested/sheet.png", png())
    (tmp_path / "sheet.png").symlink_to(tmp_path / "nested/sheet.png")
    assert ask(spark, tmp_path, "sheet.png") == [("nested/sheet.png", "png", None)]


def test_expected_digests_and_references(spark, tmp_path):
    put(tmp_path / "nested/a.png", png())
    sha = hashlib.sha256(png()).hexdigest()
    rows = spark.createDataFrame([("r", [("user", [("image", "a.png", None), ("text", None, "Read R1")]), ("assistant", [("text", None, "10k")])])],
                                 "id string, messages array<struct<role:string,content:array<struct<type:string,image:string,text:string>>>>")
    found = images.references(rows, "id")
    assert [tuple(r) for r in found.collect()] == [("r", 0, 0, "a.png")]
    files = images.scan(spark, str(tmp_path))
    for given, fault in ((sha, None), ("0" * 64, "changed"), (None, None)):
        one = images.resolved(found.selectExpr("*", f"{'null' if given is None else repr(given)} as want"), files, f"{tmp_path}/nested/d.jsonl", "want").collect()
        assert [(r.sha256, r.fault) for r in one] == [(sha, fault)]
    assert images.resolved(found.limit(0), files, f"{tmp_path}/nested/d.jsonl").count() == 0


def test_store_is_idempotent(spark, tmp_path):
    folder = str(tmp_path / "images")
    df = spark.createDataFrame([(png(), ".png")] * 5 + [(b"other", None), (None, ".png"), (b"", ".txt")], "content binary, extension string").repartition(4)
    want = {(hashlib.sha256(c).hexdigest(), e, len(c)) for c, e in ((png(), ".png"), (b"other", ""), (b"", ".txt"))}
    for _ in range(2):
        assert {(r.sha256, r.extension, r.length) for r in objects.store(df, folder).collect()} == want
        assert sorted(os.listdir(folder)) == sorted(s + e for s, e, _ in want)
    assert all(hashlib.sha256(open(f"{folder}/{f}", "rb").read()).hexdigest() == f[:64] for f in os.listdir(folder))


def test_killed_and_repeated_task_leaves_whole_files(spark, tmp_path, monkeypatch):
    """A writer that dies in the middle leaves no file under a digest; the next attempt completes it."""
    store, at = objects._opened(str(tmp_path))
    calls = []

    class Torn:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def move(self, a, b):
            calls.append(a)
            raise OSError("killed")

    with pytest.raises(OSError):
        objects._written(Torn(store), f"{at}/x", b"data")
    assert calls and os.listdir(tmp_path) == []
    objects._written(store, f"{at}/x", b"data")
    objects._written(store, f"{at}/x", b"data")
    assert os.listdir(tmp_path) == ["x"] and (tmp_path / "x").read_bytes() == b"data"


def test_names_stay_inside(spark, tmp_path):
    place = lambda *rows: objects.place(spark.createDataFrame(rows, "name string, content binary").coalesce(1), str(tmp_path / "s"))
    assert {(r.name, r.length) for r in place(("a/b.png", b"1"), ("a/b.png", b"1"), ("c", b"22")).collect()} == {("a/b.png", 1), ("c", 2)}
    for name in ("../x", "a/../../x", "/x", "a//b"):
        with pytest.raises(Exception, match="no path inside"):
            place((name, b"1"))
    with pytest.raises(Exception, match="two contents"):
        place(("d", b"1"), ("d", b"2"))
    assert not (tmp_path / "x").exists()
