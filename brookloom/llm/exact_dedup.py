"""Operator 5, exact dedup with an extendible-hash index on shared files.

Every task first reduces its rows to distinct texts: a text that comes again in a later slice is held
back with its largest id and its number, and sent once more when the task ends.  So a hot text reaches
its owner twice for a task, not once for a row.  Keys are the first 64 bits of the text's SHA-256.  The key space is
cut into ranges by the leading bits of the key; an owner task takes all texts of a range, in key
order, and puts them in its index: a directory of 2^depth slots that doubles when an overfull bucket
that fills its slot must split.  Texts of one key are chained in a bucket and compared byte by byte.
Buckets are pages; an owner that holds more than PAGE_BYTES of them writes the ones used longest
ago to the shared folder and reads them back when needed.  As texts arrive in key order, a page is
seldom read again.  On completion each range is one file in the shared folder, named after its range
and written under a temporary name first, so a task that runs again after a lost executor leaves the
same file.  `load` reads such files, so later texts can be checked against a stored index.

The decision for each text (which row stays, how many there are) then joins the rows by the full
SHA-256; Spark's skew join splits the rows of a hot text.  If two different texts of one SHA-256 ever
met, the byte comparison would find them and the job would stop rather than merge them.

Texts are equal when identical; null counts as empty.  Of equal texts the row with the largest id
stays.  Rows with one id and one text are one document repeated: only one of them is kept (see
`deduplicate`); the report gives each row the same answer.  Null ids are smaller than all others.
Texts of any length are compared whole.  Empty tables give empty results.  Extra columns, of whatever name,
are kept by `deduplicate` and make no difference elsewhere.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, drop, scratch, ship, texts_of

#: Distinct keys of a bucket before it splits.
BUCKET = 64
#: Text bytes that an owner holds before pages go to the shared folder.
PAGE_BYTES = 64 << 20
#: Leading key bits that make a range, at least, and the rows of a range beyond which there are more; an owner task takes several ranges.
RANGE_BITS, RANGE_ROWS = 12, 50_000
#: Splits stop here: keys that agree in so many bits stay in one bucket and chain.
MAX_DEPTH = 64


def text_key(text: bytes) -> int:
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "big")


class Bucket:
    __slots__ = ("bytes", "chains", "depth", "page")

    def __init__(self, depth: int) -> None:
        self.depth = depth
        #: key -> entries [compressed text, largest id, rows]
        self.chains: dict[int, list[list]] | None = {}
        self.bytes = 0
        self.page: int | None = None


class ExtendibleIndex:
    """An extendible-hash index of texts; keys agree in their first `skip` bits."""

    def __init__(self, skip: int = 0, capacity: int = BUCKET, page_bytes: int = PAGE_BYTES, store: PageStore | None = None, key_bits: int = 64) -> None:
        self.skip, self.capacity, self.page_bytes, self.store, self.key_bits = skip, capacity, page_bytes, store, key_bits
        self.depth = 0
        self.directory = [Bucket(0)]
        self.used: OrderedDict[int, Bucket] = OrderedDict()
        self.bytes = 0
        self.compared = self.chained = self.paged = 0

    def slot(self, key: int) -> int:
        return key >> (self.key_bits - self.skip - self.depth) & ((1 << self.depth) - 1)

    def _open(self, bucket: Bucket) -> Bucket:
        if bucket.chains is None:
            bucket.chains = pickle.loads(self.store.read(bucket.page))
            self.bytes += bucket.bytes
        self.used[id(bucket)] = bucket
        self.used.move_to_end(id(bucket))
        return bucket

    def _page_out(self, current: Bucket) -> None:
        while self.store is not None and self.bytes > self.page_bytes and len(self.used) > 1:
            _, old = self.used.popitem(last=False)
            if old is current:
                self.used[id(old)] = old
                continue
            old.page = self.store.write(pickle.dumps(old.chains, 5))
            old.chains = None
            self.bytes -= old.bytes
            self.paged += 1

    def add(self, key: int, text: bytes, largest: int | None, rows: int) -> None:
        bucket = self._open(self.directory[self.slot(key)])
        chain = bucket.chains.setdefault(key, [])
        for entry in chain:
            self.compared += 1
            if zlib.decompress(entry[0]) == text:
                entry[1] = largest if entry[1] is None else entry[1] if largest is None else max(entry[1], largest)
                entry[2] += rows
                return
        self.chained += bool(chain)
        packed = zlib.compress(text, 1)
        chain.append([packed, largest, rows])
        bucket.bytes += len(packed) + 100
        self.bytes += len(packed) + 100
        while len(bucket.chains) > self.capacity and bucket.depth < min(MAX_DEPTH, self.key_bits) - self.skip:
            bucket = self._split(bucket, key)
        self._page_out(bucket)

    def _split(self, bucket: Bucket, key: int) -> Bucket:
        """Halve a bucket, doubling the directory if it has one slot only; the half that holds key."""
        if bucket.depth == self.depth:
            self.directory = [b for b in self.directory for _ in (0, 1)]
            self.depth += 1
        halves = Bucket(bucket.depth + 1), Bucket(bucket.depth + 1)
        shift = self.key_bits - self.skip - bucket.depth - 1
        for k, chain in bucket.chains.items():
            half = halves[k >> shift & 1]
            half.chains[k] = chain
            half.bytes += sum(len(e[0]) + 100 for e in chain)
        # slots that point to a bucket are neighbours, as slots follow the leading bits
        first = self.slot(key) >> (self.depth - bucket.depth) << (self.depth - bucket.depth)
        half_width = 1 << (self.depth - bucket.depth - 1)
        for k in (0, 1):
            for i in range(first + k * half_width, first + (k + 1) * half_width):
                self.directory[i] = halves[k]
        self.used.pop(id(bucket), None)
        for half in halves:
            self.used[id(half)] = half
        return halves[key >> shift & 1]

    def buckets(self) -> Iterator[Bucket]:
        last = None
        for b in self.directory:
            if b is not last:
                yield self._open(b)
                self._page_out(b)
            last = b

    def find(self, key: int, text: bytes) -> tuple[int | None, int] | None:
        """(largest id, rows) of a text, or None."""
        for packed, largest, rows in self._open(self.directory[self.slot(key)]).chains.get(key, ()):
            if zlib.decompress(packed) == text:
                return largest, rows
        return None


class PageStore:
    """Pages and index files of one range in a folder that any file system of pyarrow can hold."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, path = file_system(folder)
        self.path = f"{path}/{name}"
        self.pages = 0

    def write(self, data: bytes) -> int:
        self.pages += 1
        self._put(f"{self.path}.page{self.pages}", data)
        return self.pages

    def read(self, page: int) -> bytes:
        with self.fs.open_input_stream(f"{self.path}.page{page}") as f:
            return f.read()

    def _put(self, path: str, data: bytes) -> None:
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(part) as f:
            f.write(data)
        self.fs.move(part, path)

    def close(self, index: ExtendibleIndex) -> None:
        """The index as one file: depth, and each bucket with its depth and chains; pages go."""
        part = f"{self.path}.ehx.{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(part) as f:
            pickle.dump({"skip": index.skip, "depth": index.depth, "key_bits": index.key_bits}, f, 5)
            for b in index.buckets():  # a bucket at a time, so pages stay out
                pickle.dump((b.depth, b.chains), f, 5)
            pickle.dump(None, f, 5)
        self.fs.move(part, f"{self.path}.ehx")
        for k in range(1, self.pages + 1):
            self.fs.delete_file(f"{self.path}.page{k}")


def file_system(folder: str):
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        parts = urlsplit(folder)
        if parts.scheme == "file":
            found, path = fs.LocalFileSystem(), parts.path
        else:
            found, path = fs.FileSystem.from_uri(folder)
    else:
        found, path = fs.LocalFileSystem(), folder
    found.create_dir(path, recursive=True)
    return found, path


def load(folder: str, name: str) -> ExtendibleIndex:
    """A range's index as it was stored."""
    found, path = file_system(folder)
    with found.open_input_file(f"{path}/{name}.ehx") as f:
        stored = pickle.load(f)
        index = ExtendibleIndex(skip=stored["skip"], key_bits=stored["key_bits"])
        index.depth, index.directory = stored["depth"], []
        while (bucket := pickle.load(f)) is not None:
            b = Bucket(bucket[0])
            b.chains = bucket[1]
            index.directory += [b] * (1 << (index.depth - bucket[0]))
    return index


#: Bytes of repeated texts that a task holds back before it sends them on.
HELD_BYTES = 8 << 20
_FOUND = T.StructType([T.StructField("text_sha256", T.StringType()), T.StructField("keep_id", T.LongType()), T.StructField("group_size", T.LongType())])
_SENT = T.StructType([T.StructField("owner", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("text", T.BinaryType()), T.StructField("largest", T.LongType()), T.StructField("n", T.LongType())])


def build(docs: DataFrame, folder: str, *, text_col: str = "text", id_col: str = "doc_id", capacity: int = BUCKET, key_of: Callable[[bytes], int] = text_key, key_bits: int = 64) -> DataFrame:
    """Index all texts in `folder`; a row for each distinct text: text_sha256, keep_id, group_size."""
    spark = docs.sparkSession
    ship(spark)
    skip = min(max(RANGE_BITS, (docs.select(F.lit(1)).count() // RANGE_ROWS).bit_length()), 24, key_bits)

    def sent_as(texts: dict[bytes, list], keys: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k >> (key_bits - skip) for k in keys], pa.int32()),
                pa.array([k - (1 << 63) if key_bits == 64 else k for k in keys], pa.int64()),  # signed order as unsigned
                pa.array(list(texts), pa.binary()),
                pa.array([e[0] for e in texts.values()], pa.int64()),
                pa.array([e[1] for e in texts.values()], pa.int64()),
            ],
            names=_SENT.names,
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # keys of what this task has sent
        held: dict[bytes, list] = {}
        size = 0
        for whole in batches:
            for batch in bounded(whole):
                local: dict[bytes, list] = {}
                for text, i in zip(texts_of(batch, "t"), batch.column("i").to_pylist(), strict=True):
                    text = text or b""
                    entry = held.get(text) or local.setdefault(text, [None, 0])
                    entry[1] += 1
                    if i is not None and (entry[0] is None or i > entry[0]):
                        entry[0] = i
                keys = {t: key_of(t) for t in local}
                again = [t for t, k in keys.items() if k in seen]
                for text in again:
                    held[text] = local.pop(text)
                    size += len(text)
                if local:
                    yield sent_as(local, [keys[t] for t in local])
                seen.update(keys.values())
                if size > HELD_BYTES:
                    yield sent_as(held, [key_of(t) for t in held])
                    held, size = {}, 0
        if held:
            yield sent_as(held, [key_of(t) for t in held])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, name = None, None

        def finish() -> Iterator[pa.RecordBatch]:
            if index is None:
                return
            for b in index.buckets():
                rows = []
                for chain in b.chains.values():
                    seen = set()
                    for packed, largest, n in chain:
                        sha = hashlib.sha256(zlib.decompress(packed)).hexdigest()
                        if sha in seen:
                            raise ValueError(f"two different texts have the SHA-256 {sha}")
                        seen.add(sha)
                        rows.append((sha, largest, n))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[c] for r in rows], pa.int64()) for c in (1, 2))], names=_FOUND.names)
            index.store.close(index)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("owner", "key", "text", "largest", "n")]
            for owner, key, text, largest, n in zip(*columns, strict=True):
                if owner != name:
                    yield from finish()
                    name = owner
                    index = ExtendibleIndex(skip=skip, capacity=capacity, store=PageStore(folder, f"range-{owner:05d}"), key_bits=key_bits)
                index.add(key + (1 << 63) if key_bits == 64 else key, text, largest, n)
        yield from finish()

    sent = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"), F.col(f"`{id_col}`").cast("long").alias("i")).mapInArrow(send, _SENT)
    owned = sent.repartition("owner").sortWithinPartitions("owner", "key")
    return owned.mapInArrow(own, _FOUND)


def find_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """For each row: id_col, keep_id, group_size, kept, text_sha256 (of the text as UTF-8)."""
    spark = docs.sparkSession
    folder = scratch(spark, "exact-index")
    found = build(docs, folder, text_col=text_col, id_col=id_col, **options)
    # the decisions are small; they are written so that the index isn't built again for a lost task
    decided_at = scratch(spark, "exact-decisions")
    found.write.parquet(decided_at)
    decided = spark.read.schema(_FOUND).parquet(decided_at)
    drop(spark, folder)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256).alias("text_sha256"))
    out = rows.join(decided, "text_sha256")
    return out.select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """docs with one row for each distinct text: the one of the largest id."""
    keep = find_duplicates(docs, text_col=text_col, id_col=id_col, **options).where("kept").select(F.col("keep_id").alias("_keep"), F.col("text_sha256").alias("_sha")).distinct()
    columns = docs.columns
    inner = [f"_in{k}" for k in range(len(columns))]  # no clash with the columns of the decision
    own = dict(zip(columns, inner, strict=True))
    rows = docs.toDF(*inner).withColumn("_own_sha", F.sha2(F.coalesce(F.col(own[text_col]).cast("string"), F.lit("")), 256))
    out = rows.join(keep, (F.col("_own_sha") == F.col("_sha")) & F.col(own[id_col]).eqNullSafe(F.col("_keep")))
    return out.dropDuplicates(["_own_sha"]).select(*(F.col(i).alias(c) for c, i in own.items()))
