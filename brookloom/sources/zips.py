"""ZIP archives of any size, written in parallel.

Members are deflated where their rows are, into part files: a run of finished ZIP records.  A list of the
records, written as a table, says which part files count, so what a lost or repeated task has left is never
read.  One task for each archive then copies its records one after the other, in a fixed buffer, and ends
the file with one directory of all of them.  Archives are moved to their names when all are done; whatever
happens, the working folder goes.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import file_system
from .shipping import ship

_COPY = 1 << 20
_RECORDS = "archive string, path string, part string, at long, size long, crc long, packed long, plain long"
# Of the ZIP format.
_STAMP = (0, 33)  # 1980-01-01, so that a member's bytes depend on its content alone
_UTF8 = 0x800
_DEFLATED = 8


def record(name: str, content: bytes) -> tuple[bytes, int, int]:
    """A member as a local header and deflated bytes; its CRC and the deflated size."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    data, own = pack.compress(content) + pack.flush(), name.encode()
    crc = zlib.crc32(content)
    return struct.pack("<4s5H3L2H", b"PK\3\4", 20, _UTF8, _DEFLATED, *_STAMP, crc, len(data), len(content), len(own), 0) + own + data, crc, len(data)


def listing(name: str, crc: int, packed: int, plain: int, at: int) -> bytes:
    """A member's entry in the directory; a place beyond 4 GB goes into an extra field."""
    own = name.encode()
    extra = struct.pack("<2HQ", 1, 8, at) if at >= 0xFFFFFFFF else b""
    return struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45 if extra else 20, _UTF8, _DEFLATED, *_STAMP, crc, packed, plain, len(own), len(extra), 0, 0, 0, 0, min(at, 0xFFFFFFFF)) + own + extra


def ending(members: int, size: int, at: int) -> bytes:
    """The end of an archive; large ones have a second, longer one before it."""
    out = b""
    if members >= 0xFFFF or size >= 0xFFFFFFFF or at >= 0xFFFFFFFF:
        out = struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, members, members, size, at) + struct.pack("<4sLQL", b"PK\6\7", 0, at + size, 1)
    return out + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, min(members, 0xFFFF), min(members, 0xFFFF), min(size, 0xFFFFFFFF), min(at, 0xFFFFFFFF), 0)


def _parts(work: str, largest: int):
    """Rows of (archive, path, content) in order become records in part files of about `largest` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(work)
        out, part, at = None, "", 0
        try:
            for batch in batches:
                done = []
                for archive, path, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if out is None or at >= largest:
                        if out is not None:
                            out.close()
                        part, at = f"part-{uuid.uuid4().hex}", 0
                        out = system.open_output_stream(f"{top}/{part}")
                    content = content or b""
                    whole, crc, packed = record(path, content)
                    out.write(whole)
                    done.append((archive, path, part, at, len(whole), crc, packed, len(content)))
                    at += len(whole)
                if done:
                    yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, d, strict=True)) for d in done], schema=_ARROW)
        finally:
            if out is not None:
                out.close()

    return run


_NAMES = [c.split()[0] for c in _RECORDS.split(", ")]
_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _RECORDS.split(", ")])


def _joined(work: str):
    """Records in order of archive and path become archives; a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(work)
        held: dict[str, BinaryIO] = {}
        name, out, file, at, n, listed = None, None, "", 0, 0, None

        def source(part: str) -> BinaryIO:
            if part not in held:
                for f in held.values():
                    f.close()
                held.clear()  # records of a part stand together
                held[part] = system.open_input_file(f"{top}/{part}")
            return held[part]

        def finished() -> pa.RecordBatch:
            listed.seek(0)
            size = 0
            while piece := listed.read(_COPY):
                out.write(piece)
                size += len(piece)
            out.write(ending(n, size, at))
            out.close()
            listed.close()
            return pa.RecordBatch.from_pylist([{"archive": name, "members": n, "file": file}])

        for batch in batches:
            for r in batch.to_pylist():
                if r["archive"] != name:
                    if out is not None:
                        yield finished()
                    name, file, at, n = r["archive"], f"zip-{uuid.uuid4().hex}", 0, 0
                    out, listed = system.open_output_stream(f"{top}/{file}"), tempfile.SpooledTemporaryFile(16 << 20)
                f = source(r["part"])
                f.seek(r["at"])
                left = r["size"]
                while left:
                    piece = f.read(min(left, _COPY))
                    if not piece:
                        raise EOFError(f"{r['part']} is too short")
                    out.write(piece)
                    left -= len(piece)
                listed.write(listing(r["path"], r["crc"], r["packed"], r["plain"], at))
                at += r["size"]
                n += 1
        if out is not None:
            yield finished()
        for f in held.values():
            f.close()

    return run


def write_archives(files: DataFrame, folder: str, *, overwrite: bool = False, part_bytes: int = 256 << 20) -> DataFrame:
    """Write files (archive, path, content: text or bytes) as ZIPs into a folder of a shared file system.

    archive is the ZIP's name in the folder.  One member for a path: of several the one that is smallest as bytes.
    Archives that are there are left as they are unless `overwrite`.  A null content is an empty member; rows
    without an archive or a path are left out.  The rows of what was written: archive and members.
    """
    spark = files.sparkSession
    ship(spark)
    system, top = file_system(folder)
    system.create_dir(top, recursive=True)
    work = f"{folder.rstrip('/')}/.making-{uuid.uuid4().hex}"
    _, inner = file_system(work)
    system.create_dir(inner)
    try:
        rows = files.where("archive IS NOT NULL AND path IS NOT NULL").select("archive", "path", F.col("content").cast("binary").alias("content"))
        if not overwrite:
            there = [(i.base_name,) for i in system.get_file_info(_selector(top)) if i.is_file]
            rows = rows.join(spark.createDataFrame(there, "archive string"), "archive", "left_anti")
        odd = rows.where(F.col("archive").rlike(r"[/\\]") | F.col("archive").isin("", ".", "..") | F.col("archive").startswith(".making-")).select("archive").first()
        if odd:
            raise ValueError(f"not a file name: {odd['archive']}")
        single = rows.groupBy("archive", "path").agg(F.min("content").alias("content"))
        placed = single.repartitionByRange("archive", "path").sortWithinPartitions("archive", "path")
        placed.mapInArrow(_parts(work, part_bytes), _RECORDS).write.parquet(f"{work}/records")
        records = spark.read.schema(_RECORDS).parquet(f"{work}/records")
        records.repartition("archive").sortWithinPartitions("archive", "path").mapInArrow(_joined(work), "archive string, members long, file string").write.parquet(f"{work}/made")
        made = spark.read.parquet(f"{work}/made").collect()  # a row for each archive
        for r in made:
            system.move(f"{inner}/{r['file']}", f"{top}/{r['archive']}")
        return spark.createDataFrame([(r["archive"], r["members"]) for r in made], "archive string, members long")
    finally:
        system.delete_dir(inner)


def _selector(path: str):
    from pyarrow import fs

    return fs.FileSelector(path)
