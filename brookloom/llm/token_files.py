"""Operator 2, token ids as binary files of patched frame-of-reference blocks.

A block holds up to BLOCK ids.  Its minimum is subtracted; the differences are packed at the width
that holds PERCENTILE of them; the others are exceptions, stored as a list of positions and high bits
beside the packed low bits.  A file holds the blocks of consecutive documents, with an index of block
starts, so a range of ids is read without decoding what stands before it.

A file, all numbers little-endian:
  magic "PFOR0001", then u32: documents, ids, blocks, ids of a full block
  documents x (i64 id, u8 id is not null, u32 tokens)
  blocks x (u32 offset of the block from the first one)
  blocks, each: u32 minimum, u8 width, u8 width of high bits, u16 exceptions,
    packed low bits (width bits for each id), u16 x exceptions (positions), packed high bits
  u32: crc32 of all that stands before it

Documents come in ascending id order: rows are range-partitioned by id and sorted, each task writes
files of at most FILE_TOKENS ids (or one document's) named after its partition, under a temporary
name first.  A list of files (partition, number, ids before it) is kept beside them; it has a row for
each file, not for each document.

Defined cases: null and empty texts give the end id only; null ids come first; rows of one id come in
the order of a hash of their texts, then of their texts; repeated rows are all written; a text of any
length is encoded whole, and stands in one file; an empty table writes no file; only the id and the text
column are read, so other columns, of whatever name, make no difference.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, cut, drop, scratch, ship, texts_of, tidied
from .exact_dedup import file_system

MAGIC = b"PFOR0001"
BLOCK = 256
PERCENTILE = 0.9
FILE_TOKENS = 2_000_000
#: Distinct pieces of text whose ids a Python worker remembers (about 200 bytes each); beyond, it keeps the half that was met most.
CACHE = 200_000


# ---- blocks


def pack_rows(values: np.ndarray, width: int) -> np.ndarray:
    """Each row of values in width bits a number, as a row of bytes."""
    rows, n = values.shape
    length = (n * width + 7) // 8
    if not length:
        return np.zeros((rows, 0), np.uint8)
    groups = -(-n // 8)  # eight numbers fill `width` bytes
    eights = np.zeros((rows, groups * 8), np.uint64)
    eights[:, :n] = values
    eights = eights.reshape(rows * groups, 8)
    out = np.zeros((rows * groups, width), np.uint8)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        shifted = eights[:, j] << np.uint64(shift)
        for k in range(-(-(width + shift) // 8)):
            out[:, first + k] |= (shifted >> np.uint64(8 * k)).astype(np.uint8)
    return out.reshape(rows, groups * width)[:, :length]


def unpack_rows(data: np.ndarray, n: int, width: int) -> np.ndarray:
    """The n numbers of each row of bytes."""
    rows = len(data)
    if not width or not n:
        return np.zeros((rows, n), np.uint32)
    groups = -(-n // 8)
    whole = data if data.shape[1] == groups * width else np.pad(data, ((0, 0), (0, groups * width - data.shape[1])))
    whole = np.ascontiguousarray(whole).reshape(rows * groups, width)
    kind = np.uint32 if width <= 25 else np.uint64
    out = np.empty((rows * groups, 8), np.uint32)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        value = np.zeros(rows * groups, kind)
        for k in range(-(-(width + shift) // 8)):
            value |= whole[:, first + k].astype(kind) << kind(8 * k)
        out[:, j] = (value >> kind(shift)) & kind((1 << width) - 1)
    return out.reshape(rows, groups * 8)[:, :n]


def pack_ragged(values: np.ndarray, width: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Numbers of their own widths at their own first bits, in `size` bytes; no two share a bit."""
    out = np.zeros(size, np.uint8)
    if not len(values):
        return out
    shifted = values.astype(np.uint64) << (start & 7).astype(np.uint64)
    first, most = start >> 3, -(-int((width + (start & 7)).max()) // 8)
    total = np.zeros(size + most, np.int64)
    for k in range(most):
        # bits are apart, so a sum of bytes is their union
        total += np.bincount(first + k, weights=(shifted >> np.uint64(8 * k)).astype(np.uint8), minlength=size + most).astype(np.int64)
    return total[:size].astype(np.uint8)


def unpack_ragged(data: np.ndarray, width: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The numbers that pack_ragged put at some bits."""
    if not len(width):
        return np.zeros(0, np.uint32)
    first, shift = start >> 3, (start & 7).astype(np.uint64)
    value = np.zeros(len(width), np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    for k in range(-(-int((width + (start & 7)).max()) // 8)):
        value |= padded[first + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> shift) & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))).astype(np.uint32)


_LENGTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Bits that each number below 2^32 needs."""
    x = x.astype(np.uint32, copy=False)
    if not x.size or x.max() < 1 << 16:
        return _LENGTHS[x]
    high = x >> np.uint32(16)
    return np.where(high > 0, _LENGTHS[high] + np.uint8(16), _LENGTHS[x & np.uint32(0xFFFF)])


#: Blocks that are packed at once.
_AT_ONCE = 4096
#: The head of a block.
_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("high", "u1"), ("n", "<u2")])


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[list[bytes], np.ndarray]:
    """The blocks of some ids, in stretches, and the offset of each block; the last offset is the end."""
    full = len(ids) // block
    out, offsets = [], [np.zeros(1, np.int64)]
    stretches = [ids[at * block : min(full, at + _AT_ONCE) * block].reshape(-1, block) for at in range(0, full, _AT_ONCE)]
    if full * block < len(ids):
        stretches.append(ids[full * block :].reshape(1, -1))
    for rows in stretches:
        data, ends = _encode_rows(rows, percentile)
        out.append(data)
        offsets.append(offsets[-1][-1] + ends)
    return out, np.concatenate(offsets)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch of `size` numbers."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def _encode_rows(rows: np.ndarray, percentile: float) -> tuple[bytes, np.ndarray]:
    """The blocks of some rows of ids, and where each ends."""
    rows = rows.astype(np.uint32, copy=False)
    count, n = rows.shape
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    need = _bit_length(rest)  # as bytes
    # the smallest width that holds the percentile of a block's ids
    at = int(np.ceil(percentile * n)) - 1
    width = np.partition(need, at, axis=1)[:, at].astype(np.int64)
    over = need > width[:, None]
    exceptions = over.sum(axis=1)
    high_width = np.where(exceptions > 0, need.max(axis=1).astype(np.int64) - width, 0)
    packed, tail = (n * width + 7) // 8, (exceptions * high_width + 7) // 8
    sizes = _HEAD.itemsize + packed + 2 * exceptions + tail
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.zeros(int(ends[-1]), np.uint8)
    head = np.zeros(count, _HEAD)
    head["low"], head["width"], head["high"], head["n"] = low, width, high_width, exceptions
    out[starts[:, None] + np.arange(_HEAD.itemsize)] = head.view(np.uint8).reshape(count, _HEAD.itemsize)
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        data = pack_rows(rest[which] & np.uint32((1 << w) - 1), w)
        out[(starts[which] + _HEAD.itemsize)[:, None] + np.arange(data.shape[1])] = data
    row, column = np.nonzero(over)
    places = starts + _HEAD.itemsize + packed
    out[_ragged(places, 2 * exceptions)] = column.astype("<u2").view(np.uint8)
    own = high_width[row]
    number = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]  # within its block
    tails = np.cumsum(tail) - tail
    high = pack_ragged(rest[row, column] >> width[row].astype(np.uint32), own, 8 * tails[row] + number * own, int(tail.sum()))
    out[_ragged(places + 2 * exceptions, tail)] = high
    return out.tobytes(), ends


def decode_blocks(body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of some blocks: where they start in body (bytes), and ids of each."""
    heads = body[starts[:, None] + np.arange(_HEAD.itemsize)].reshape(-1).view(_HEAD)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(int(begins[-1]), np.uint32)
    width, e, high_width = heads["width"].astype(np.int64), heads["n"].astype(np.int64), heads["high"].astype(np.int64)
    packed = (sizes * width + 7) // 8
    for n, w in {*zip(sizes.tolist(), width.tolist(), strict=True)}:
        which = np.flatnonzero((sizes == n) & (width == w))
        data = body[(starts[which] + _HEAD.itemsize)[:, None] + np.arange((n * w + 7) // 8)]
        out[(begins[which][:, None] + np.arange(n)).ravel()] = unpack_rows(data, n, w).ravel()
    places = starts + _HEAD.itemsize + packed
    row = np.repeat(np.arange(len(e)), e)
    column = body[_ragged(places, 2 * e)].view("<u2").astype(np.int64)
    own = high_width[row]
    number = np.arange(len(row)) - (np.cumsum(e) - e)[row]
    high = unpack_ragged(body, own, 8 * (places + 2 * e)[row] + number * own)
    out[begins[row] + column] |= high << width[row].astype(np.uint32)
    return out + np.repeat(heads["low"], sizes)


# ---- files


def encode_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    stretches, offsets = encode_blocks(ids, block)
    table = np.zeros(len(doc_ids), np.dtype([("id", "<i8"), ("known", "u1"), ("n", "<u4")]))
    table["id"] = [i or 0 for i in doc_ids]
    table["known"] = [i is not None for i in doc_ids]
    table["n"] = lengths
    data = b"".join([MAGIC, struct.pack("<IIII", len(doc_ids), len(ids), len(offsets) - 1, block), table.tobytes(), offsets[:-1].astype("<u4").tobytes(), *stretches])
    return data + struct.pack("<I", zlib.crc32(data))


class TokenFile:
    """Reads one file; `ids(a, b)` decodes the blocks that hold that range only."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC or len(data) < 28 or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole token file")
        documents, self.n, blocks, self.block = struct.unpack_from("<IIII", data, 8)
        kind = np.dtype([("id", "<i8"), ("known", "u1"), ("n", "<u4")])
        table = np.frombuffer(data, kind, documents, 24)
        self.doc_ids = [int(i) if k else None for i, k in zip(table["id"], table["known"], strict=True)]
        self.lengths = table["n"].astype(np.int64)
        at = 24 + documents * kind.itemsize
        self.starts = np.frombuffer(data, "<u4", blocks, at).astype(np.int64)
        self.body = np.frombuffer(data, np.uint8, len(data) - 4 - at - 4 * blocks, at + 4 * blocks)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n if end is None else end
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        sizes = np.minimum(self.block, self.n - np.arange(first, last + 1) * self.block)
        return decode_blocks(self.body, self.starts[first : last + 1], sizes)[start - first * self.block : end - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, first id's place in this file, ids) of each document, decoding a stretch of blocks at a time."""
        ends = np.cumsum(self.lengths)
        step = 1024 * self.block
        at, held = 0, np.zeros(0, np.uint32)
        base = 0
        for i, n, end in zip(self.doc_ids, self.lengths.tolist(), ends.tolist(), strict=True):
            while base + len(held) < end:
                more = self.ids(base + len(held), min(self.n, base + len(held) + step))
                held = np.concatenate((held[at - base :], more))
                base = at
            yield i, at, held[at - base : end - base]
            at = end


# ---- text to ids


#: What a tokenizer file must say for pieces to be encoded apart; any other file gets whole texts.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"
#: Words that normaliser and pre-tokenizer leave as they are, once in lower case: their tokens are those of the BPE model alone.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


@lru_cache(maxsize=2)
def tokenizer(path: str, cache: int = CACHE) -> Vocabulary:
    return Vocabulary(path, cache)


class Vocabulary:
    """A tokenizer file and the ids of pieces of text, in one flat array.

    Where the file lower-cases, drops white space and splits letters from other characters, neither a
    token nor a normalisation reaches across ASCII white space; only then is a text cut into pieces.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        self.cache = cache
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        said = json.loads(self.library.to_str())
        model, before = said["model"], (said["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.special = [t["content"].encode() for t in said["added_tokens"]]
        split = before[0] if before else {}
        self.by_piece = (
            said["normalizer"] == _NORMALIZER
            and len(before) == 2
            and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": _PATTERN}, "Removed", True)
            and (before[1]["type"], before[1]["add_prefix_space"], before[1]["use_regex"]) == ("ByteLevel", False, False)
            and (model["type"], model["end_of_word_suffix"], model["dropout"]) == ("BPE", _WORD_END, None)
            and bool(self.special)
            and all(t.startswith(b"<|") for t in self.special)
        )
        if self.by_piece:
            self.words = Tokenizer.from_file(path)
            self.words.normalizer = normalizers.Sequence([])
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends_word = np.zeros(self.library.get_vocab_size(), bool)
            self.ends_word[[i for t, i in self.library.get_vocab().items() if t.endswith(_WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.start, self.size, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def shrink(self, most: int) -> None:
        """Keep the pieces that were met in the most batches."""
        keep = np.zeros(len(self.size), bool)
        keep[np.argsort(-self.met, kind="stable")[:most]] = True
        names = [p for p, k in zip(self.place, keep.tolist(), strict=True) if k]
        self.flat = self.flat[np.repeat(keep, self.size)]
        self.size, self.met = self.size[keep], self.met[keep] // 2
        self.start = np.cumsum(self.size) - self.size
        self.place = dict(zip(names, range(len(names)), strict=True))

    def places(self, pieces: list[bytes]) -> np.ndarray:
        """The place of each of some distinct pieces; new ones are encoded."""
        new = [p for p in pieces if p not in self.place]
        if new:
            if len(self.place) + len(new) > self.cache:
                self.shrink(self.cache // 2)
                new = [p for p in pieces if p not in self.place]
            names, ids, size = self.encode(new)
            base = len(self.place)
            self.place.update(zip(names, range(base, base + len(names)), strict=True))
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
            self.flat = np.concatenate((self.flat, ids))
            self.size = np.concatenate((self.size, size))
            self.met = np.concatenate((self.met, np.zeros(len(size), np.int64)))
        at = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        self.met[at] += 1
        return at

    def encode(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Pieces in some order, their ids and how many each has; the library gets many pieces in a call.

        A word's last token ends in </w>, so words stand between spaces and are told apart by that.
        Other pieces stand between special tokens.
        """
        plain, words, others = [], [], []
        for p in pieces:
            if _PLAIN.fullmatch(p):
                plain.append(p)
            elif p in (b".", b",") or p.decode().isalpha():
                words.append(p)
            else:
                others.append(p)
        done, ids, size = [], [], []
        for library, own, change in ((self.words, plain, str.lower), (self.library, words, str)):
            said = library.encode_batch_fast([change(b" ".join(own[at : at + 64]).decode()) for at in range(0, len(own), 64)], add_special_tokens=False)
            x = np.fromiter(chain.from_iterable(e.ids for e in said), np.uint32)
            ends = np.flatnonzero(self.ends_word[x])
            if len(ends) != len(own):
                others += own
                continue
            done += own
            ids.append(x)
            size.append(np.diff(ends, prepend=-1))
        number = self.library.token_to_id(self.special[-1].decode())
        groups = [others[at : at + 256] for at in range(0, len(others), 256)]
        for group, e in zip(groups, self.library.encode_batch_fast([self.special[-1].join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            x = np.array(e.ids, np.uint32)
            done += group
            ids.append(x[x != number])
            size.append(np.diff(np.concatenate(([-1], np.flatnonzero(x == number), [len(x)]))) - 1)
        return done, np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *size])

    def whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that go to the library as they are, and how many each has."""
        found = [np.array(e.ids, np.uint32) for e in self.library.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)


_BLANK = np.zeros(256, bool)
_BLANK[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
#: The second byte of Latin letters from U+00C0 to U+00FF.
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def cut_texts(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """Runs without ASCII white space of all texts, A-Z lower-cased, and how many each text has.

    A stop or comma at the end of a run, after a Latin letter, is a piece of its own, as it is for the tokenizer.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    blank = _BLANK[data]
    after = np.append(blank[1:], True)
    at = np.flatnonzero(((data == 0x2E) | (data == 0x2C)) & after)
    at = at[at > 1]
    before, second = data[at - 1], data[at - 2]
    at = at[((before >= 0x61) & (before <= 0x7A)) | (_LATIN[before] & (second == 0xC3))]
    stop = np.zeros(len(data) + 1, bool)
    stop[at] = True
    starts = np.flatnonzero(~blank & (np.insert(blank[:-1], 0, True) | stop[:-1]))
    ends = np.flatnonzero(~blank & (after | stop[1:]))
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts + 1, out=offsets[1:])
    pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~blank])])
    return pieces, np.diff(np.searchsorted(starts, begins))


def _listed(column: pa.BinaryArray) -> list[bytes]:
    """A binary column without nulls as a list; cheaper than to_pylist."""
    if not len(column):
        return []
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).tolist()
    whole = data.to_pybytes() if data is not None else b""
    return [whole[i:j] for i, j in pairwise(at)]


def encode_texts(texts: list[bytes | None], path: str, cache: int = CACHE) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, without special tokens, as the tokenizers library gives them for each whole text; where each text ends.

    Each distinct piece is encoded by the library once, many pieces in a call.  A text that may hold a
    special token goes to the library whole.
    """
    known = tokenizer(path, cache)
    texts = [t or b"" for t in texts]
    alone = np.array([bool(t) and (not known.by_piece or b"<|" in t) for t in texts], bool)
    pieces, counts = cut_texts([b"" if a else t for t, a in zip(texts, alone.tolist(), strict=True)])
    coded = pieces.dictionary_encode()
    at = known.places(_listed(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
    size = known.size[at]
    out = known.flat[_ragged(known.start[at], size)]
    total = np.concatenate(([0], np.cumsum(size)))
    ends = total[np.cumsum(counts)]
    if not alone.any():
        return out, ends
    more, sizes = known.whole([texts[k] for k in np.flatnonzero(alone)])
    out = np.insert(out, np.repeat(ends[alone], sizes), more)
    added = np.zeros(len(texts), np.int64)
    added[alone] = sizes
    return out, ends + np.cumsum(added)


# ---- Spark

_FILES = T.StructType([T.StructField("partition", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("tokens", T.LongType())])


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id", block: int = BLOCK, file_tokens: int = FILE_TOKENS, cache: int = CACHE) -> DataFrame:
    """Write all documents to folder; the list of files with `before`, the ids of all files before each.  cache: pieces that a worker remembers."""
    spark = docs.sparkSession
    ship(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        fs, path = file_system(folder)
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        held = number = 0
        done: list[tuple] = []

        def flush() -> None:
            nonlocal held, number
            if not doc_ids:
                return
            name = f"part-{partition:06d}-{number:05d}.pfor"
            temporary = f"{path}/_{name}.{uuid.uuid4().hex}"  # names with _ are not read as data
            with fs.open_output_stream(temporary) as f:
                f.write(encode_file(doc_ids, lengths, np.concatenate(parts), block))
            fs.move(temporary, f"{path}/{name}")
            done.append((partition, number, name, held))
            doc_ids.clear(), lengths.clear(), parts.clear()
            held, number = 0, number + 1

        for whole in batches:
            for batch in bounded(whole, 2 << 20):
                ids, ends = encode_texts(texts_of(batch, "t"), tokenizer_path, cache)
                ids = np.insert(ids, ends, end_id)  # after each document
                ends = (ends + np.arange(1, len(ends) + 1)).tolist()
                start = 0
                for i, end in zip(batch.column("i").to_pylist(), ends, strict=True):
                    if held and held + end - start > file_tokens:
                        flush()
                    doc_ids.append(i)
                    lengths.append(end - start)
                    parts.append(ids[start:end])
                    held += end - start
                    start = end
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64()))], names=_FILES.names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    list_at = f"{folder}/_files"
    # rows of one id, or of no id, are spread over partitions by a hash of their texts
    order = [F.col("i").asc_nulls_first(), F.xxhash64("t")]
    in_order = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("t").asc_nulls_first())
    in_order.mapInArrow(tidied(write), _FILES).write.mode("overwrite").parquet(list_at)
    files = spark.read.schema(_FILES).parquet(list_at)
    # a partition's ids first, then running sums inside it: neither has more rows than there are files
    totals = files.groupBy("partition").agg(F.sum("tokens").alias("t"))
    before = totals.withColumn("b", F.sum("t").over(Window.orderBy("partition")) - F.col("t")).select("partition", "b")
    own = F.sum("tokens").over(Window.partitionBy("partition").orderBy("number")) - F.col("tokens")
    return files.join(before, "partition").withColumn("before", F.col("b") + own).select("file", "tokens", "before")


_DIGEST = T.StructType([T.StructField("file", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """file and content of all token files in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select(F.substring_index("path", "/", -1).alias("file"), "content")


def digest_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens and ids_crc32 of each document."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                rows = [(i, at, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())) for i, at, ids in TokenFile(content.as_py()).documents()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array([r[c] for r in rows], pa.int64()) for c in range(4))], names=_DIGEST.names)

    found = read_files(spark, folder).mapInArrow(tidied(read), _DIGEST)
    return found.join(files.select("file", "before"), "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files that the folder's list names back whole: doc_id and ids of each document.

    Files that an earlier run into the folder has left aren't in the list.
    """
    ship(spark)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for i, _, ids in TokenFile(content.as_py()).documents():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=schema.names)

    named = spark.read.schema(_FILES).parquet(f"{folder}/_files").select("file")
    return read_files(spark, folder).join(named, "file", "left_semi").select("content").mapInArrow(read, schema)


def token_digest(docs: DataFrame, tokenizer_path: str, *, folder: str | None = None, **options) -> DataFrame:
    """Write docs to a folder, read them back and return a digest for each document.

    folder: where the token files stay; without it they are written to the shared folder and dropped when read back.
    """
    spark = docs.sparkSession
    own = folder or scratch(spark, "tokens")
    files = write_token_files(docs, own, tokenizer_path, **options)
    found, _ = cut(digest_token_files(spark, own, files), "token-digest")
    if folder is None:
        drop(spark, own)
    return found
