import io
import tarfile

import pytest
from pyspark.sql import functions as F

from quarryline.functions import parsers as P
from quarryline.operators import validation as V
from quarryline.sources import archives, eagle, snapshots, strict_jsonl

SCHEMATIC = """<?xml version="1.0"?><eagle><drawing><schematic><libraries><library name="l"><symbols><symbol name="s"><pin name="a"/><text layer="95">&gt;NAME</text>
<text layer="96">&gt;VALUE</text></symbol></symbols><devicesets><deviceset name="d"><gates><gate name="G" symbol="s"/></gates><devices><device name="" package="p">
<connects><connect gate="G" pin="a" pad="1 2"/></connects></device></devices></deviceset></devicesets></library></libraries>
<parts><part name="R1" library="l" deviceset="d" device="" value="10k"/><part name="R2" library="l" deviceset="d" device="" value="22k"/></parts>
<sheets><sheet><instances><instance part="R1" gate="G"/><instance part="R2" gate="G" smashed="yes"><attribute name="NAME" layer="95"/></instance></instances>
<nets><net name="SIG"><segment><pinref part="R1" gate="G" pin="a"/><pinref part="R2" gate="G" pin="{pin}"/></segment></net></nets></sheet></sheets>
</schematic></drawing></eagle>"""


def test_schematic_facts(spark, tmp_path):
    (tmp_path / "a.sch").write_text(SCHEMATIC.format(pin="a"))
    bom, nets = eagle.extract(eagle.scan(spark, str(tmp_path)))
    assert [(r.net, r.pads, r.n_pads) for r in nets.collect()] == [("SIG", "R1.1 R1.2 R2.1 R2.2", 4)]
    assert sorted((r.refdes, r.value, r.value_visible) for r in bom.collect()) == [("R1", "10k", True), ("R2", "22k", False)]


def test_schematics_are_rejected(spark, tmp_path):
    (tmp_path / "b.sch").write_text(SCHEMATIC.format(pin="other"))
    with pytest.raises(ValueError, match="unresolved"):
        eagle.extract(eagle.scan(spark, str(tmp_path)))
    for name, text in (("c", "<?xml version='1.0'?><!DOCTYPE x [<!entity a 'b'>]><eagle/>"), ("d", "binary"), ("e", "<?xml version='1.0'?><eagle><drawing/></eagle>"),
                       ("f", SCHEMATIC.partition("?>")[2]), ("g", "<?xml version='1.0' encoding='no-such'?><eagle/>")):
        (tmp_path / f"{name}.sch").write_text(text)
    assert eagle.scan(spark, str(tmp_path)).where("kind = 'error'").count() == 5


def test_archives(spark, tmp_path):
    def pack(name, files):
        with tarfile.open(tmp_path / name, "w:gz", format=tarfile.PAX_FORMAT, pax_headers={"comment": "abc"}) as t:
            for path, text in files:
                info = tarfile.TarInfo(path)
                info.size = len(text)
                t.addfile(info, io.BytesIO(text.encode()))

    pack("good.tar.gz", [("top/LICENSE", "MIT"), ("top/x/a.sch", "<eagle/>"), ("top/src.c", "no"), ("top/README.md", "r")])
    pack("bad.tar.gz", [("../evil.sch", "x")])
    (tmp_path / "torn.tar.gz").write_bytes(b"no archive")
    rows = archives.scan(spark, str(tmp_path)).collect()
    assert {(r.path, r.kind, r.commit) for r in rows if r.archive == "good.tar.gz"} == {("LICENSE", "licence", "abc"), ("x/a.sch", "schematic", "abc"), ("README.md", "readme", "abc")}
    assert {r.archive for r in rows if r.kind == "error"} == {"bad.tar.gz", "torn.tar.gz"}


@pytest.mark.parametrize("line,fault", [('{"key":"a","output":"b"}', None), ('{"a":1,"a":2}', "repeated field"), ('{"x":{"a":1,"a":2}}', "repeated field"), ('{"a":NaN}', "non-finite constant"),
                                        ('{"a":1e999}', "non-finite number"), ('{"a":1} x', "not JSON"), ("[1]", "not an object"), ("", "not JSON"), (None, "not JSON")])
def test_strict_lines(line, fault):
    assert P.strict_error(line) == fault


def test_strict_files(spark, tmp_path):
    def write(text):
        (tmp_path / "p.jsonl").write_text(text)
        return str(tmp_path / "p.jsonl")

    assert strict_jsonl.predictions(spark, write('{"key":"a#0","output":""}\n')).count() == 1
    for text in ('{"key":"a","output":"x"}\n{"key":"a","output":"y"}\n', '{"key":"a"}\n', '{"key":1,"key":2}\n', ""):
        with pytest.raises(ValueError):
            strict_jsonl.predictions(spark, write(text))
    good = '{"id":"a","gold":[{"type":"value","value":"1"}],"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"r"}]}\n'
    assert strict_jsonl.gold(spark, write(good)).count() == 1
    for old, new in (('"a"', '"a#"'), ('"value":"1"', '"value":" "'), ('"type":"value"', '"type":"odd"'), ('"role":"user"', '"role":"assistant"'), ('"gold":[', '"gold":[{"type":"refuse"},')):
        with pytest.raises(ValueError):
            strict_jsonl.gold(spark, write(good.replace(old, new)))


def test_records(spark):
    rows = [("a", "success", True, "x", "stop", None), ("b", "failure", True, "", "error", "boom"), ("c", "success", False, "x", "stop", None), ("d", "failure", True, "text", "error", "boom"), ("e", "odd", True, "", "", None)]
    df = spark.createDataFrame(rows, "key string, status string, attempted boolean, output string, finish_reason string, error string")
    assert {r.key for r in V.record_faults(df).collect()} == {"c", "d", "e"}
    assert V.round_trip_faults(df, df).count() == 0 and V.round_trip_faults(df, df.limit(0)).count() == 5


def test_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([("f1", "train", "é", None), ("f1", "train", "b", 2), ("f2", "val", "c", 3)], "family_id string, split string, text string, n int")
    path = str(tmp_path / "snap")
    m = {r.split: (r.n_rows, r.n_families) for r in snapshots.publish(rows, path).collect()}
    assert m == {"train": (2, 1), "val": (1, 1)}
    schema = "family_id string, text string, n int"
    assert snapshots.verified(spark, path, schema).count() == 3
    assert snapshots.digest(rows) == snapshots.digest(rows.repartition(5).orderBy(F.rand(1)))
    with pytest.raises(Exception, match="exist"):
        snapshots.publish(rows, path)
    with pytest.raises(ValueError, match="families"):
        snapshots.publish(rows.withColumn("split", F.lit("val")).union(rows), str(tmp_path / "other"))
    spark.createDataFrame([("f9", "z", 1)], schema).write.mode("append").json(path + "/split=val")
    with pytest.raises(ValueError, match="manifest"):
        snapshots.verified(spark, path, schema)
