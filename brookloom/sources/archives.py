"""Archives, text folders, SQLite tables and thread files as DataFrames."""

from __future__ import annotations

import json
import logging
import sqlite3
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import closing
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import file_system, listed
from .shipping import ship
from .sinks import write_files

_log = logging.getLogger(__name__)
MEMBERS = "archive string, member string, content binary"
_TARS = (".tar", ".tar.gz", ".tgz", ".tar.bz2")


class ArchiveSource(DataSource):
    """spark.read.format("archive").option("path", path).option("suffix", ".txt"): the members of ZIP and TAR files.

    A ZIP or a plain TAR is dealt out in ranges of `part_bytes`: a part reads the members that begin in its range,
    one by one, so no task holds an archive.  A compressed TAR is one part, read as a stream.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


class Part(InputPartition):
    def __init__(self, path: str, low: int, high: int) -> None:
        self.path, self.low, self.high = path, low, high


class ArchiveReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.suffix, self.step = options["path"], options.get("suffix", ""), int(options.get("part_bytes", str(64 << 20)))

    def partitions(self) -> list[InputPartition]:
        """Only names and sizes are looked at here."""
        parts: list[InputPartition] = []
        for info in listed(self.path):
            low = info.path.lower()
            if not low.endswith((".zip", *_TARS)):
                raise ValueError(f"not an archive: {info.path}")
            cuts = range(0, max(info.size, 1), self.step) if low.endswith((".zip", ".tar")) else [0]
            parts += [Part(info.path, at, at + self.step if len(cuts) > 1 else 1 << 62) for at in cuts]
        return parts

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as f:
            for member, content in members_of(partition.path, f, self.suffix, partition.low, partition.high):
                yield partition.path, member, content


def members_of(name: str, data: BinaryIO, suffix: str, low: int = 0, high: int = 1 << 62) -> Iterator[tuple[str, bytes]]:
    """Members with a suffix that aren't empty and begin between two places; ValueError for other kinds of files.

    A broken archive, or member, is logged and passed over.
    """
    kind = name.lower()
    if not kind.endswith((".zip", *_TARS)):
        raise ValueError(f"not an archive: {name}")
    try:
        yield from _zipped(data, suffix, low, high) if kind.endswith(".zip") else _tarred(kind, data, suffix, low, high)
    except (zipfile.BadZipFile, tarfile.TarError, zlib.error, EOFError, OSError, pa.ArrowInvalid) as e:  # the last: a place before the file's begin
        _log.warning("%s is broken: %s", name, e)


def _zipped(data: BinaryIO, suffix: str, low: int, high: int) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(data) as z:
        for i in z.infolist():
            if i.filename.endswith(suffix) and i.file_size and low <= i.header_offset < high:
                try:
                    content = z.read(i)
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as e:
                    _log.warning("%s is broken: %s", i.filename, e)
                    continue
                yield i.filename, content


def _tarred(kind: str, data: BinaryIO, suffix: str, low: int, high: int) -> Iterator[tuple[str, bytes]]:
    with tarfile.open(fileobj=data, mode="r:" if kind.endswith(".tar") else "r|*") as t:
        for i in t:
            if i.offset >= high:
                break
            if i.isfile() and i.name.endswith(suffix) and i.size and i.offset >= low:
                yield i.name, t.extractfile(i).read()
            t.members = []  # else it remembers every header


def read_archives(spark: SparkSession, path: str, suffix: str = "", part_bytes: int = 64 << 20) -> DataFrame:
    """archive, member and content of the members of all archives at a path, in parts of about part_bytes."""
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("path", path).option("suffix", suffix).option("part_bytes", str(part_bytes)).load()


def read_json_archives(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed members of ZIPs of JSON; malformed members are left out."""
    rows = read_archives(spark, path, ".json").select("archive", "member", F.decode("content", "UTF-8").alias("json"))
    # a broken member would be a struct of nulls
    rows = rows.where(F.try_parse_json("json").isNotNull()).withColumn("thread", F.from_json("json", schema))
    return rows.select("archive", "member", "thread.*")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text and doc_id (SHA-256 of the bytes) of all .txt files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.where("length > 0").select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("doc_id"))


def thread_files(spark: SparkSession, path: str) -> DataFrame:
    """thread_id with its .txt and .json path; of several the first by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    pattern = r"(?i)(?:^|/)thread_(\d+)\.(txt|json)$"
    name = F.regexp_extract("path", pattern, 1)
    kind = F.lower(F.regexp_extract("path", pattern, 2))
    found = files.select("path", name.alias("id"), kind.alias("kind")).where("id <> ''")
    return found.groupBy(F.col("id").cast("long").alias("thread_id")).agg(*(F.min(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in ("txt", "json")))


class SqliteSource(DataSource):
    """spark.read.format("sqlite").option("path", file) and .option("table", name) or .option("query", sql), .schema(...): read-only.

    Only the columns of the schema are asked for, the option `where` (SQL) goes into every part's query, and a table is
    dealt out in ranges of its rowid.  Spark's own filters aren't taken over: Spark 4.1 keeps a reader for all
    queries of a DataFrame, so filters pushed for one would hold for the next.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, schema)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema) -> None:
        self.path, self.table, self.query, self.parts = options["path"], options.get("table"), options.get("query"), int(options.get("parts", "1"))
        if (self.table is None) == (self.query is None):
            raise ValueError("name a table or a query")
        self.columns, self.where = schema.fieldNames(), options.get("where")

    def partitions(self) -> list[InputPartition]:
        """Equal ranges of the rowid; the first and the last are open, for rows that come meanwhile.  A query, or a table without a rowid, is one part."""
        ends = (None, None)
        if self.table is not None and self.parts > 1:
            with closing(self.connect()) as c:
                try:
                    ends = c.execute(f"SELECT (SELECT min(rowid) FROM {_quoted(self.table)}), (SELECT max(rowid) FROM {_quoted(self.table)})").fetchone()
                except sqlite3.OperationalError as e:  # WITHOUT ROWID, or a view
                    _log.warning("%s is read in one part: %s", self.table, e)
        low, high = ends
        if low is None or high <= low:
            return [InputPartition((None, None))]
        cuts = sorted({low + (high - low + 1) * k // self.parts for k in range(1, self.parts)} - {low})
        return [InputPartition(x) for x in zip([None, *cuts], [*cuts, None], strict=True)]

    def sql(self, partition: InputPartition) -> tuple[str, list]:
        """What a part asks, and the values in it."""
        low, high = partition.value
        where, values = [f"({self.where})"] if self.where else [], []
        for sign, at in ((">=", low), ("<", high)):
            if at is not None:
                where.append(f"rowid {sign} ?")
                values.append(at)
        columns = ", ".join(_quoted(c) for c in self.columns) or "1"
        source = _quoted(self.table) if self.table is not None else f"({self.query})"
        return f"SELECT {columns} FROM {source}" + (f" WHERE {' AND '.join(where)}" if where else ""), values

    def connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with closing(self.connect()) as c:
            cursor = c.execute(*self.sql(partition))
            while rows := cursor.fetchmany(1000):
                yield from map(tuple, rows)


def read_sqlite(spark: SparkSession, path: str, schema: str, *, table: str | None = None, query: str | None = None, where: str | None = None, parts: int = 1) -> DataFrame:
    """Columns of a table, in parts by rowid, or of a query; where: a condition that SQLite decides.  The file must be where all executors see it."""
    ship(spark)
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").schema(schema).option("path", path).option("parts", str(parts))
    for name, value in (("table", table), ("query", query), ("where", where)):
        reader = reader if value is None else reader.option(name, value)
    return reader.load()


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table in parallel ranges of a column; the driver's jar must be there."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def ensured_files(spark: SparkSession, needed: DataFrame, folder: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """thread_id and the path of the text of each needed thread (thread_id) below a folder; those that aren't there are made.

    make: from the threads without a file to path (thread_<id>.txt) and content of each.
    """
    want = needed.select("thread_id").distinct()
    lacking = want.join(thread_files(spark, folder).where("txt IS NOT NULL"), "thread_id", "left_anti")
    write_files(make(lacking), folder)
    return want.join(thread_files(spark, folder).select("thread_id", F.col("txt").alias("path")), "thread_id", "left")


def read_config(path: str, known: set[str]) -> dict[str, dict]:
    """A filter config (field to rules) from a JSON file on the driver; unknown rules are an error."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    for field, rules in config.items():
        if not isinstance(rules, dict) or set(rules) - known:
            raise ValueError(f"unknown rules of {field}: {sorted(set(rules) - known) if isinstance(rules, dict) else rules}")
    return config


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that aren't JSON are left out."""
    lines = spark.read.text(path).where(F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", schema).alias("row")).select("row.*")


def read_store(spark: SparkSession, path: str, batches: list[int] | None = None, most: int | None = None, collection: str = "batch", order: str = "id") -> DataFrame:
    """A Parquet store, all batches or some, at most `most` rows of each collection in an order; the limit is the feature."""
    rows = spark.read.parquet(path)
    if batches is not None:
        rows = rows.where(F.col("batch").isin(batches))  # prunes folders
    if most is None:
        return rows
    w = Window.partitionBy(collection).orderBy(order)
    return rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most).drop("_place")
