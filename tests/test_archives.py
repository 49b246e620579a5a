"""Archives read in parts and written in parallel, the filter run, and SQLite with pushdown."""

import csv
import io
import json
import sqlite3
import tarfile
import zipfile
from contextlib import closing

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookloom.operators import filter_run
from brookloom.sources import archives, zips


def rows_of(df):
    return sorted((r.member, bytes(r.content)) for r in df.collect())


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    want = [(f"d/{k:03d}.txt", bytes([65 + k % 26]) * (1000 + k)) for k in range(200)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, data in want:
            z.writestr(name, data)
        z.writestr("empty.txt", "")
        z.writestr("other.json", "{}")
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        for name, data in want:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    for name in ("a.zip", "b.tar"):
        df = archives.read_archives(spark, str(tmp_path / name), ".txt", part_bytes=20_000)
        assert df.rdd.getNumPartitions() > 5
        per_task = df.groupBy(F.spark_partition_id()).agg(F.sum(F.length("content")).alias("n")).collect()
        assert len(per_task) > 5 and max(r.n for r in per_task) < 45_000  # no task has much more than its part
        assert rows_of(df) == want


@pytest.mark.parametrize("kind", ["gz", "bz2"])
def test_compressed_tars_are_streams(spark, tmp_path, kind):
    with tarfile.open(tmp_path / f"c.tar.{kind}", f"w:{kind}") as t:
        for k in range(3):
            info = tarfile.TarInfo(f"{k}.txt")
            info.size = 4 * (k > 0)
            t.addfile(info, io.BytesIO(b"data"[: info.size]))
    assert rows_of(archives.read_archives(spark, str(tmp_path), ".txt", part_bytes=1)) == [("1.txt", b"data"), ("2.txt", b"data")]


def test_broken_archives_and_other_files(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(b"no archive")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("good.txt", "good")
        z.writestr("bad.txt", "bad text")
    (tmp_path / "b.zip").write_bytes(data.getvalue().replace(b"bad text", b"bad tex!"))  # its CRC is wrong
    assert rows_of(archives.read_archives(spark, str(tmp_path / "*.zip"))) == [("good.txt", b"good")]
    (tmp_path / "c.rar").write_bytes(b"")
    with pytest.raises(Exception, match="not an archive"):
        archives.read_archives(spark, str(tmp_path / "c.rar")).collect()


def test_archives_are_written_in_parallel(spark, tmp_path):
    """A group that lies in many partitions and part files is one archive that other readers take."""
    files = spark.range(5000).select(F.when(F.col("id") < 4990, "big.zip").otherwise(F.concat(F.lit("s"), F.col("id") % 3, F.lit(".zip"))).alias("archive"), F.format_string("ü/%05d.txt", "id").alias("path"), F.repeat(F.col("id").cast("string"), 50).alias("content")).repartition(7)
    more = spark.createDataFrame([("big.zip", "ü/00001.txt", "second of a name"), ("big.zip", "null", None), (None, "x", "x"), ("big.zip", None, "x")], "archive string, path string, content string")
    folder = tmp_path / "out"
    made = {r.archive: r.members for r in zips.write_archives(files.union(more), str(folder), part_bytes=20_000).collect()}
    assert made == {"big.zip": 4991, "s0.zip": 3, "s1.zip": 4, "s2.zip": 3}
    assert sorted(p.name for p in folder.iterdir()) == sorted(made)
    with zipfile.ZipFile(folder / "big.zip") as z:
        assert z.testzip() is None
        assert z.namelist() == sorted([f"ü/{k:05d}.txt" for k in range(4990)] + ["null"])
        assert z.read("ü/04321.txt") == b"4321" * 50 and z.read("null") == b"" and z.read("ü/00001.txt") == b"1" * 50
    assert rows_of(archives.read_archives(spark, str(folder / "s0.zip"), part_bytes=100)) == sorted((f"ü/{k:05d}.txt", str(k).encode() * 50) for k in range(4990, 5000) if k % 3 == 0)


def test_archives_that_are_there_are_left(spark, tmp_path):
    files = lambda text: spark.createDataFrame([("a.zip", "p", text), ("b.zip", "p", text)], "archive string, path string, content string")
    zips.write_archives(files("first").where("archive = 'a.zip'"), str(tmp_path))
    assert [r.archive for r in zips.write_archives(files("second"), str(tmp_path)).collect()] == ["b.zip"]
    read = lambda name: zipfile.ZipFile(tmp_path / name).read("p")
    assert (read("a.zip"), read("b.zip")) == (b"first", b"second")
    zips.write_archives(files("third"), str(tmp_path), overwrite=True)
    assert read("a.zip") == b"third"
    assert zips.write_archives(files("x").where("false"), str(tmp_path)).collect() == []
    with pytest.raises(ValueError, match="not a file name"):
        zips.write_archives(spark.createDataFrame([("../a.zip", "p", "x")], "archive string, path string, content string"), str(tmp_path))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    broken = spark.range(100).select(F.lit("a.zip").alias("archive"), F.col("id").cast("string").alias("path"), F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        zips.write_archives(broken, str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []


def test_places_beyond_4_gb():
    """The longer forms of the format, without the bytes."""
    entry = zips.listing("a", 1, 2, 3, 5 << 32)
    assert entry[-12:] == b"\x01\x00\x08\x00" + (5 << 32).to_bytes(8, "little") and entry[42:46] == b"\xff" * 4
    end = zips.ending(70_000, 10, 5 << 32)
    assert end.startswith(b"PK\6\6") and end[-22:-18] == b"PK\5\6" and end[-14:-10] == b"\xff" * 4
    small, _, _ = zips.record("m", b"text")
    whole = small + zips.listing("m", __import__("zlib").crc32(b"text"), len(small) - 31, 4, 0)
    assert zipfile.ZipFile(io.BytesIO(whole + zips.ending(1, len(whole) - len(small), len(small)))).read("m") == b"text"


SCORES = ["strategy", "clarity"]
SCHEMA = "thread_id long, puzzle_text string, student_name string, school_name string, mentor_name string, age string, conversation array<struct<submission_id:long,submission_date:string,short_answer:string,long_answer:string,response:string,response_date:string,rubrics:struct<strategy:int,clarity:int>>>"


def message(k, answer, reply, strategy, clarity):
    return {"submission_id": k, "submission_date": "d", "short_answer": answer, "long_answer": "", "response": reply, "response_date": "d", "rubrics": {"strategy": strategy, "clarity": clarity}}


def test_filter_run(spark, tmp_path):
    threads = {
        1: [message(1, "a long enough answer", "ok", 1, 3), message(2, "a long enough second", "fine", 2, 3)],
        2: [message(3, "short", "ok", 3, 3)],
        3: [message(4, "a long enough answer", "ok", 1, 0)],
        4: [message(5, "a long enough answer", "ok", 2, 3), message(6, "x", "", 3, 1)],
    }
    source, out = tmp_path / "in.zip", tmp_path / "out"
    with zipfile.ZipFile(source, "w") as z:
        for k, conversation in threads.items():
            z.writestr(f"thread_{k}.json", json.dumps({"thread_id": k, "puzzle_text": "p &amp; q", "conversation": conversation}))
            if k != 4:
                z.writestr(f"thread_{k}.txt", f"text &lt;{k}&gt;\n\tend")
        z.writestr("thread_9.json", "{broken")
    config = {"short_answer": {"min_length": 10}, "strategy": {"is_rubric": True, "improvement": 1}, "clarity": {"is_rubric": True, "min_value": 3}}
    made = filter_run.filter_archives(spark, str(source), config, SCHEMA, str(out), scores=SCORES)
    # 1 and 4 pass all rules; 4 has no text, so no rubric archive has it; 3 improves and isn't clear; 2 is short
    assert made == {"filtered.zip": 3, "strategy_filtered.zip": 1, "clarity_filtered.zip": 1}
    with zipfile.ZipFile(out / "filtered.zip") as z, zipfile.ZipFile(source) as whole:
        assert z.namelist() == ["thread_1.json", "thread_1.txt", "thread_4.json"]
        assert z.read("thread_4.json") == whole.read("thread_4.json")
        assert z.read("thread_1.txt") == b"text <1> end"
    assert zipfile.ZipFile(out / "clarity_filtered.zip").namelist() == ["thread_1.txt"]

    def table(name):
        return [r for p in sorted((out / name).glob("*.csv")) for r in csv.DictReader(p.open(newline=""))]

    assert sorted((r["thread_id"], r["idx"]) for r in table("conversations")) == [("1", "0"), ("1", "1"), ("2", "0"), ("3", "0"), ("4", "0"), ("4", "1")]
    assert {r["thread_id"] for r in table("main")} == {"1", "4"} and {r["thread_id"] for r in table("strategy_conversations")} == {"1"}
    second = next(r for r in table("main") if (r["thread_id"], r["idx"]) == ("1", "1"))
    assert second["strategy_diff"] == "+1" and second["puzzle_text"] == "p & q" and second["short_answer_diff"]


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "x.db")
    with closing(sqlite3.connect(path)) as c:
        c.execute("CREATE TABLE t (k INTEGER, name TEXT COLLATE NOCASE, v REAL, unused BLOB)")
        c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(k if k % 7 else None, f"N{k % 3}", k / 2, b"x") for k in range(1000)])
        c.execute("DELETE FROM t WHERE rowid BETWEEN 300 AND 500")
        c.execute("CREATE VIEW w AS SELECT k FROM t")
        c.commit()
    return path


def test_sql_that_is_sent(database):
    r = archives.SqliteReader({"path": database, "table": "t", "where": "k > 5 OR name = 'N1'", "parts": "4"}, T.StructType.fromDDL("k int, name string"))
    parts = r.partitions()
    asked = [r.sql(p) for p in parts]
    assert len(parts) == 4
    assert asked[1] == ("""SELECT "k", "name" FROM "t" WHERE (k > 5 OR name = 'N1') AND rowid >= ? AND rowid < ?""", [251, 501])
    with closing(sqlite3.connect(database)) as c:
        plans = [c.execute("EXPLAIN QUERY PLAN " + sql, values).fetchall()[0][3] for sql, values in asked]
    assert all("SEARCH" in p and "INTEGER PRIMARY KEY (rowid" in p for p in plans)  # a range, not a scan


def test_tables_in_parts_and_conditions(spark, database):
    want = [(k, f"N{k % 3}") for k in range(1000) if not 299 <= k <= 499]
    df = archives.read_sqlite(spark, database, "k int, name string", table="t", parts=5)
    assert df.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(((k if k % 7 else None, n) for k, n in want), key=repr)
    assert sorted(r.k for r in df.where("k > 900 AND name = 'N1'").collect()) == [k for k, n in want if k > 900 and k % 7 and n == "N1"]
    assert df.where("name = 'n1'").count() == 0 and df.count() == len(want)
    some = archives.read_sqlite(spark, database, "k int", table="t", where="k BETWEEN 600 AND 620", parts=3)
    assert sorted(r.k for r in some.collect()) == [k for k in range(600, 621) if k % 7]
    assert archives.read_sqlite(spark, database, "k int", query="SELECT k FROM t WHERE k < 10", parts=3).count() == 8
    assert archives.read_sqlite(spark, database, "k int", table="w", parts=3).count() == len(want)  # a view has no rowid
    assert archives.read_sqlite(spark, database, "v double", table="t", parts=3).agg(F.max("v")).first()[0] == 499.5
