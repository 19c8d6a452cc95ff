import sqlite3

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from quarryline.sources import ledgers, tails


@pytest.fixture
def file(tmp_path):
    path = tmp_path / "jobs.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE jobs (id TEXT PRIMARY KEY, kind TEXT, status TEXT, created REAL, elapsed INTEGER, reason TEXT)")
        db.executemany("INSERT INTO jobs VALUES (?, ?, ?, ?, ?, ?)", [(f"j{k}", "training" if k % 2 else "research", "queued" if k % 3 else "completed", k * 1.5, k, None if k % 5 else "why")
                                                                    for k in range(1000)])
        db.execute("DELETE FROM jobs WHERE elapsed BETWEEN 100 AND 199")
        db.execute("CREATE TABLE none (id TEXT)")
    return str(path)


def test_whole_table_in_ranges(spark, file):
    df = ledgers.ledger(spark, file)
    assert df.schema.simpleString() == "struct<id:string,kind:string,status:string,created:double,elapsed:bigint,reason:string>"
    assert df.select(F.spark_partition_id()).distinct().count() == 8 and df.count() == 900
    assert df.agg(F.sum("elapsed"), F.countDistinct("id"), F.count("reason")).first()[:] == (sum(range(1000)) - sum(range(100, 200)), 900, 180)
    assert ledgers.ledger(spark, file, "none").count() == 0
    with pytest.raises(Exception, match="no table"):
        ledgers.ledger(spark, file, "other")
    with pytest.raises(Exception, match="no name"):
        ledgers.ledger(spark, file, "jobs; DROP TABLE jobs")


def test_filters(spark, file):
    df = ledgers.ledger(spark, file, partitions=3).where("status = 'queued' and created >= 300 and kind in ('training', 'other') and reason is null and id like 'j3%'")
    want = [k for k in range(200, 1000) if k % 3 and k % 2 and k % 5 and str(k)[0] == "3"]
    assert sorted(r.elapsed for r in df.collect()) == want


def test_what_sqlite_is_asked(file):
    source = ledgers.LedgerSource({"path": file, "table": "jobs", "partitions": "4"})
    reader = source.reader(source.schema())
    left = list(reader.pushFilters([D.EqualTo(("status",), "queued"), D.StringStartsWith(("id",), "j3"), D.GreaterThan(("elapsed",), 990), D.EqualTo(("a", "b"), 1)]))
    assert [type(f) for f in left] == [D.StringStartsWith, D.EqualTo]
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(1, 250), (251, 500), (501, 750), (751, 1000)]
    assert reader.statement(parts[0])[0].endswith("WHERE rowid BETWEEN ? AND ? AND status = ? AND elapsed > ?")
    assert [len(list(reader.read(p))) for p in parts] == [0, 0, 0, 6]


def test_newest_rows_without_reading_all(spark, file):
    got = [r.elapsed for r in ledgers.newest(spark, file, limit=5).collect()]
    assert sorted(got) == [995, 996, 997, 998, 999]
    assert ledgers.newest(spark, file).where("status = 'queued'").count() == sum(k % 3 > 0 for k in range(900, 1000))
    source = ledgers.LedgerSource({"path": file, "table": "jobs", "newest": "created", "limit": "5"})
    reader = source.reader(source.schema())
    assert len(reader.partitions()) == 1 and reader.statement(reader.partitions()[0])[0].endswith("ORDER BY created DESC, rowid DESC LIMIT ?")
    assert list(reader.pushFilters([D.EqualTo(("status",), "queued")])) != []


def test_only_the_tail_of_a_log_is_read(spark, tmp_path):
    bar = " 12%| | {}/{} [00:0{}<01:00,  1.5s/it]\r"
    (tmp_path / "a").mkdir()
    (tmp_path / "a/long.log").write_bytes(bar.format(99, 100, 1).encode() + b"x" * 2_000_000 + b"\xff\n" + bar.format(3, 100, 2).encode() + bar.format(7, 20, 3).encode())
    (tmp_path / "short.log").write_text(bar.format(1, 100, 4))
    (tmp_path / "none.log").write_text("no marks 3/4 [x]")
    found = tails.tails(spark, str(tmp_path)).withColumns({"p": tails.progress(F.col("tail")), "q": tails.progress(F.col("tail"), F.lit(100))})
    got = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert got["long.log"].length > 2_000_000 and got["long.log"].n_read == len(got["long.log"].tail.replace("�", "x")) == tails.TAIL
    assert tuple(got["long.log"].p) == (7, 20, "00:03", "01:00", "1.5 s/it") and tuple(got["long.log"].q)[:3] == (3, 100, "00:02")
    assert tuple(got["short.log"].p)[:2] == (1, 100) and got["none.log"].p is None
