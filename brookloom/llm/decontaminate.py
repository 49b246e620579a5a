"""Operator 1, benchmark decontamination.

A broadcast hash set of normalised test n-grams is scanned against the word windows of every
training text; each hit is verified word by word; hit spans or whole documents can be removed.

Words are the runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters.  A window is 13
consecutive words of an item; an item of fewer words, but not none, is one window.

Only a bounded set is broadcast: items stream through the driver and form blocks of at most about
MAX_WINDOWS windows; a longer item is spread over several.  One block is the usual case and needs no
shuffle.  With more, each block's hits (spans and items by the hash of the text) are a table of their own
in the shared folder; they are merged and joined to the rows in the end, so texts are read once for a block
and never written.

Defined cases: a null or empty text has no words and is never contaminated; texts of any length are read
whole; an item without words is ignored; a null item id counts as the empty string; repeated item ids count
once; repeated rows are judged one by one; an empty benchmark hits nothing; an empty table gives an empty
one; an input column that has the name of an output column is replaced by `find_contamination` and kept by
`decontaminate`; all other columns are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, add_columns, as_bytes, bounded, cut, ship, state_udf, texts_of, words_of

N = 13
#: Windows of a broadcast block: about 100 bytes each in Python.
MAX_WINDOWS = 500_000
#: A document is contaminated if at least a twentieth of its words are hit.
SHARE = 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class NgramIndex:
    """Windows of some items: word numbers -> items, with a hash per window for the fast scan."""

    def __init__(self, n: int = N) -> None:
        self.n, self.words, self.items = n, _Vocabulary(), []
        self.windows: dict[int, dict[bytes, list[int]]] = {}
        self.hashes: dict[int, np.ndarray] = {}
        self.size = 0

    def add(self, name: str, words: list[bytes]) -> None:
        if not words:
            return
        at = len(self.items)
        self.items.append(name)
        ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in words], dtype=np.int32)
        length = min(self.n, len(ids))
        own = self.windows.setdefault(length, {})
        for i in range(len(ids) - length + 1):
            found = own.setdefault(ids[i : i + length].tobytes(), [])
            if not found:
                self.size += 1
            if not found or found[-1] != at:
                found.append(at)

    def close(self) -> NgramIndex:
        for length, own in self.windows.items():
            rows = np.frombuffer(b"".join(own), dtype=np.int32).reshape(-1, length)
            self.hashes[length] = np.unique(_hash(rows.T))
        return self

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit word ranges (start, end), in order, and the names of the items that occur."""
        if not words or not self.words:
            return [], set()
        ids = np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))
        missing = np.concatenate(([0], np.cumsum(ids == 0)))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for length, hashes in self.hashes.items():
            if len(ids) < length:
                continue
            at = np.flatnonzero(missing[length:] == missing[:-length])
            if not len(at):
                continue
            h = _hash([ids[at + k] for k in range(length)])
            found = np.searchsorted(hashes, h)
            found[found == len(hashes)] = 0
            for i in at[hashes[found] == h].tolist():
                if got := self.windows[length].get(ids[i : i + length].tobytes()):  # equal hashes may differ
                    spans.append((i, i + length))
                    items.update(self.items[k] for k in got)
        return merged(spans), items


def _hash(columns: Iterable[np.ndarray]) -> np.ndarray:
    total = None
    with np.errstate(over="ignore"):
        for c in columns:
            c = c.astype(np.uint64)
            total = c if total is None else (total ^ (total >> np.uint64(29))) * _MULTIPLIER + c
    return total


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def blocks(benchmark: DataFrame, text_col: str, item_col: str, n: int, most: int) -> Iterator[NgramIndex]:
    """Indexes of about `most` windows at most; the first one may be empty."""
    index, first = NgramIndex(n), True
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator()
    for row in rows:
        words = words_of(None if row["t"] is None else row["t"].encode())
        length = min(n, len(words))
        for start in range(0, len(words) - length + 1, most):
            index.add(row["i"] or "", words[start : start + most + length - 1])
            if index.size >= most:
                yield index.close()
                index, first = NgramIndex(n), False
    if first or index.items:
        yield index.close()


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_STATE = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))]
#: Fixed value: a word, in a text that isn't lower-cased.
_WORD_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _spans(found: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in found]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_text_col: str = "text", item_col: str = "item_id", n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with n_words, hit_spans (word ranges) and hit_items (sorted names) for each row."""
    indexes = blocks(benchmark, item_text_col, item_col, n, max_windows)
    index, more = next(indexes), next(indexes, None)
    if more is None:

        def compute(batches):
            for batch in batches:
                words = [words_of(t) for t in texts_of(batch, text_col)]
                found = [index.scan(w) for w in words]
                yield [[len(w) for w in words], [_spans(f[0]) for f in found], [sorted(f[1]) for f in found]]

        return add_columns(docs, _STATE, compute, [text_col])
    return _with_hits(docs, _hits(docs, [index, more], indexes, text_col), text_col)


def _hits(docs: DataFrame, first: list[NgramIndex], others: Iterator[NgramIndex], text_col: str) -> DataFrame:
    """key (hash of the text), spans and items of every text that any block hits."""
    spark = docs.sparkSession
    ship(spark)
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"))
    parts = []
    for index in chain(first, others):

        def run(batches, index=index):
            for whole in batches:
                for batch in bounded(whole):
                    found = {}
                    for t in texts_of(batch, "t"):
                        spans, items = index.scan(words_of(t))
                        if spans:
                            found[hashlib.sha256(t).digest()] = (_spans(spans), sorted(items))
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([f[0] for f in found.values()], arrow_type(_SPANS)), pa.array([f[1] for f in found.values()], pa.list_(pa.string()))], names=schema.names)

        parts.append(cut(texts.mapInArrow(run, schema), "decontaminate")[0])
    # a text's hits in all blocks, of which there are no more than it has words
    joined = reduce(DataFrame.union, parts).groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merge(batches):
        for batch in batches:
            spans = [_spans(merged([(x["start"], x["end"]) for x in s])) for s in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, arrow_type(_SPANS)), batch.column("items")], names=schema.names)

    return cut(joined.mapInArrow(merge, schema), "decontaminate")[0]


def _with_hits(docs: DataFrame, hits: DataFrame, text_col: str) -> DataFrame:
    new = {f.name.lower() for f in _STATE}
    kept = [c for c in docs.columns if c.lower() not in new]
    inner = [f"_in{k}" for k in range(len(kept))]
    text = F.col(f"`{text_col}`").cast("string")
    named = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner, strict=True)), F.unhex(F.sha2(text, 256)).alias("_key"), F.coalesce(F.regexp_count(text, F.lit(_WORD_SQL)), F.lit(0)).cast("long").alias("n_words"))
    out = named.join(hits, F.col("_key") == F.col("key"), "left")
    none = lambda c, f: F.coalesce(c, F.array().cast(f.dataType))
    return out.select(*(F.col(i).alias(c) for i, c in zip(inner, kept, strict=True)), "n_words", none("spans", _STATE[1]).alias("hit_spans"), none("items", _STATE[2]).alias("hit_items"))


def judged(found: DataFrame, share: int = SHARE) -> DataFrame:
    """Add n_hit, n_items, items_sha256 and contaminated to the rows of find_contamination."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("hit_items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", "hit_items"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
    )


def without_spans(text: bytes | None, spans: list[tuple[int, int]]) -> bytes | None:
    """The text without the hit words and what stands between them; the rest is joined by a space."""
    if not text or not spans:
        return text
    words = list(_WORD.finditer(text))
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : words[start].start()])
        at = words[end - 1].end()
    kept.append(text[at:])
    return b" ".join(k.strip() for k in kept if k.strip())


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """The rows and columns of docs without what the benchmark holds.

    mode "documents" drops contaminated rows; "spans" cuts every hit span from the text and keeps
    all rows; "both" drops contaminated rows and cuts the spans of the others.
    """
    if mode not in ("documents", "spans", "both"):
        raise ValueError(f"unknown mode {mode}")
    columns = docs.columns
    renamed = [f"_in{i}" for i in range(len(columns))]  # no clash with the columns of the judgement
    own = renamed[columns.index(text_col)]
    if mode == "documents":
        return _without_contaminated(docs.toDF(*renamed), benchmark, own, **options).toDF(*columns)
    out = judged(find_contamination(docs.toDF(*renamed), benchmark, text_col=own, **options))
    if mode == "both":
        out = out.where(~F.col("contaminated"))

    def compute(batches):
        for batch in batches:
            spans = batch.column("hit_spans").to_pylist()
            cuts = [without_spans(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts_of(batch, own), spans, strict=True)]
            yield [[None if c is None else c.decode() for c in cuts]]

    out = add_columns(out, [T.StructField(own, T.StringType())], compute, [own, "hit_spans"])
    return out.select(*(F.col(r).alias(c) for r, c in zip(renamed, columns, strict=True)))


def _without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str, *, item_text_col: str = "text", item_col: str = "item_id", n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of docs that aren't contaminated; from one block only verdicts come back from Python."""
    indexes = blocks(benchmark, item_text_col, item_col, n, max_windows)
    index, more = next(indexes), next(indexes, None)
    if more is not None:
        found = _with_hits(docs, _hits(docs, [index, more], indexes, text_col), text_col)
        return judged(found).where(~F.col("contaminated")).select(docs.columns)
    ship(docs.sparkSession)

    def compute(slices):
        for (texts,) in slices:
            keep = []
            for t in as_bytes(texts):
                words = words_of(t)
                hit = sum(b - a for a, b in index.scan(words)[0])
                keep.append(not (hit > 0 and SHARE * hit >= len(words)))
            yield keep

    return docs.where(state_udf(compute, T.BooleanType(), F.col(f"`{text_col}`").cast("string")))


def items_digest(names: Iterable[str]) -> str:
    """sha256 of distinct names, sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(k for k, _ in groupby(sorted(names))).encode()).hexdigest()
