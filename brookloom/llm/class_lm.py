"""Operator 12, scores of a class-based bigram model in the manner of Brown et al.

Every word of the training texts has a class; a text's probability is that of its classes, each given the
one before, times that of its words, each given its class.  Classes come from exchange clustering, which
moves words to where they raise the likelihood of the class bigrams:

- `SEEDS` frequent words are exchanged one by one, with the exact change of the likelihood, on their bigram counts;
- all of the `FREQUENT` most frequent words are then exchanged in `ROUNDS` passes over the corpus, on counts of
  each word beside each class, every other word at a time;
- all other words go where the classes beside all their places in the corpus make them likeliest.

A pass sums tables whose size is a parameter's (words by classes), never the corpus's; these are all that
the driver sees.  The vocabulary itself, which grows with the corpus, is a table and is joined.  Texts are
read once: blocks of about `BLOCK` tokens hold the places of their words in a list of their own, so a word is
looked up once a block however often it is there.  After that, class counts cover every training token.

Smoothing: a class after a class has `ALPHA` counts more, spread as the classes are; a share of the
probability, as large as that of words seen once, goes to unknown words as one event; after an unknown word
a class is as likely as it is anywhere.  So the known words and the unknown one sum to 1 after each word.

Defined cases: null and empty texts are one end token, which is a word like others, stands before the first
word too and counts as a token; texts of any length are read whole; repeated rows are scored, and learned
from, one by one; ties in frequency go by bytes; without training texts every token is unknown with
probability 1 and every score 0; an empty table gives an empty one; extra columns are kept where asked for,
but for those that have the name of an output column.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, bounded, cut, drop, forget, ship, texts_of, tidied

CLASSES, SEEDS, FREQUENT, ROUNDS, SWEEPS = 64, 1024, 8192, 2, 8
BLOCK = 2_500_000
#: A word that is at least one of so many tokens in some block may be a frequent one.
SHARE = 500_000
ALPHA = 5.0
END = b""
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_UNKNOWN = 255
SCORES = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]


class _Places(dict):
    """The place of each word in a list that grows; the end is the first."""

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        return at


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z in lower case, and the end."""
    return [*text.translate(_LOWER).split(), END] if text else [END]


# ---- blocks


def encode(docs: DataFrame, *, text_col: str, train: Column, keep: list[str], block: int = BLOCK) -> tuple[DataFrame, str]:
    """The texts as blocks: their rows, lengths, training marks, and tokens as places in the block's list of words."""
    spark = docs.sparkSession
    ship(spark)
    sent = docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(train, F.lit(False)).alias("_train"), F.col(f"`{text_col}`").alias("_text"))
    row = T.StructType([*(docs.schema[c] for c in keep), T.StructField("_lm", T.BooleanType())])
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(row)), T.StructField("lengths", T.BinaryType()), T.StructField("train", T.BinaryType()),
        T.StructField("ids", T.BinaryType()), T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("n", T.LongType())])
    arrow = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in schema])
    kind = arrow.field("rows").type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        places, rows, lengths, marks, ids, size = _Places({END: 0}), [], [], [], [], 0

        def closed() -> pa.RecordBatch:
            every, long = np.concatenate(ids), np.array(lengths, np.int32)
            mark = np.concatenate(marks)
            counts = np.bincount(every[np.repeat(mark, long)], minlength=len(places)).astype(np.int32)
            all_rows = pa.concat_arrays(rows)
            values = [
                pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(all_rows)], pa.int32()), all_rows), pa.array([long.tobytes()]), pa.array([mark.tobytes()]),
                pa.array([pa.compress(every.tobytes(), "zstd", asbytes=True)]), pa.array([list(places)], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int32())), pa.array([int(counts.sum())])]
            return pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

        for whole in batches:
            for batch in bounded(whole):
                texts, mark = texts_of(batch, "_text"), batch.column(len(keep))
                at = 0
                for k, text in enumerate(texts):
                    own = tokens(text)
                    ids.append(np.fromiter(map(places.__getitem__, own), np.int32, len(own)))
                    lengths.append(len(own))
                    size += len(own)
                    if size >= block or k + 1 == len(texts):
                        some = [*(batch.column(i).slice(at, k + 1 - at) for i in range(len(keep))), pa.nulls(k + 1 - at, pa.bool_())]
                        rows.append(pa.StructArray.from_arrays([c.cast(kind.field(i).type) for i, c in enumerate(some)], fields=list(kind)))
                        marks.append(np.array(mark.slice(at, k + 1 - at).to_pylist(), bool))
                        at = k + 1
                        if size >= block:
                            yield closed()
                            number += 1
                            places, rows, lengths, marks, ids, size = _Places({END: 0}), [], [], [], [], 0
        if size:
            yield closed()

    return _kept(sent.mapInArrow(tidied(run), schema), "lm-blocks")


def _kept(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df written to the shared folder; its rows are large, so pages and row groups are looked at every few."""
    return cut(df, tag, **{"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 4, "parquet.page.size.row.check.max": 16, "parquet.block.size.row.check.min": 4, "parquet.block.size.row.check.max": 16})


class Block:
    """One block as arrays; ids are places in its words, of which the end is the first."""

    def __init__(self, one: pa.RecordBatch) -> None:
        get = lambda name, kind: np.frombuffer(one.column(one.schema.get_field_index(name))[0].as_buffer(), kind)
        self.lengths = get("lengths", np.int32)
        self.ids = np.frombuffer(pa.decompress(get("ids", np.uint8), 4 * int(self.lengths.sum()), "zstd"), np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = get("train", np.bool_)

    def before(self) -> np.ndarray:
        """The token before each token."""
        out = np.empty_like(self.ids)
        out[1:] = self.ids[:-1]
        out[self.starts] = 0
        return out

    def learned(self, *columns: np.ndarray) -> list[np.ndarray]:
        """The values of the training tokens."""
        if self.train.all():
            return list(columns)
        mark = np.repeat(self.train, self.lengths)
        return [c[mark] for c in columns]


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            yield one, Block(one)


def _words(one: pa.RecordBatch) -> pa.Array:
    return one.column(one.schema.get_field_index("words")).flatten()


def placed(words: pa.Array, place: dict[bytes, int]) -> np.ndarray:
    """The places of some words in a list; the place after the last for those that aren't in it."""
    n, get = len(place), place.get
    return np.fromiter((get(w, n) for w in words.to_pylist()), np.int64, len(words))


# ---- frequent words


def frequent(blocks: DataFrame, seeds: int, most: int) -> list[bytes]:
    """At most about `most` frequent words, the most frequent first, the end among the first `seeds`.

    Words are ranked by their number in the blocks in which they aren't rare; how many there are in all is
    counted later.  The grade of a word, a step of the logarithm, decides, so a grade is in or out as a whole.
    """
    listed = blocks.select("n", F.explode(F.arrays_zip("words", "counts")).alias("x")).where((F.col("x.counts") > 0) & (F.col("x.counts") >= F.col("n") / SHARE))
    counted, path = cut(listed.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("n")), "lm-counts")
    grade = F.floor(F.log2("n") * 16)
    grades = sorted((r for r in counted.groupBy(grade.alias("g")).agg(F.count("*").alias("k")).collect()), key=lambda r: -r["g"])
    above, least = 0, 0
    for r in grades:
        if above + r["k"] > most:
            least = r["g"] + 1
            break
        above += r["k"]
    found = {bytes(r["word"]): r["n"] for r in counted.where(grade >= least).collect()}
    drop(blocks.sparkSession, path)
    words = sorted((w for w in found if w != END), key=lambda w: (-found[w], w))
    words.insert(min(len(words), seeds - 1), END)
    return words


def beside(blocks: DataFrame, words: list[bytes], code: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each of some words stands before and after each code, over all training texts.

    code: of each of the words; all other words have the last code.  Tasks sum up what they read, parts of the
    sums by word follow; words times codes is bounded by parameters.
    """
    n, place = len(words), {w: k for k, w in enumerate(words)}
    code = np.append(code, n_codes - 1).astype(np.int64)
    schema = "word int, after binary, before binary"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, before = np.zeros((n + 1) * n_codes, np.int64), np.zeros((n + 1) * n_codes, np.int64)
        for one, block in _blocks(batches):
            local = placed(_words(one), place)
            row, column = local * n_codes, code[local]
            left, right = block.learned(block.before(), block.ids)
            for at in range(0, len(left), 1 << 20):
                a, b = left[at : at + (1 << 20)], right[at : at + (1 << 20)]
                after += np.bincount(row[a] + column[b], minlength=len(after))
                before += np.bincount(row[b] + column[a], minlength=len(before))
        yield from _rows(after.reshape(-1, n_codes), before.reshape(-1, n_codes), range(n))

    def _rows(after: np.ndarray, before: np.ndarray, which: Iterable[int]) -> Iterator[pa.RecordBatch]:
        which = [k for k in which if after[k].any() or before[k].any()]
        for at in range(0, len(which), 1000):
            some = which[at : at + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([after[k].tobytes() for k in some], pa.binary()), pa.array([before[k].tobytes() for k in some], pa.binary())], names=["word", "after", "before"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, before = np.zeros((n, n_codes), np.int64), np.zeros((n, n_codes), np.int64)
        for batch in batches:
            for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                after[k] += np.frombuffer(a, np.int64)
                before[k] += np.frombuffer(b, np.int64)
        yield from _rows(after, before, range(n))

    after, before = np.zeros((n, n_codes)), np.zeros((n, n_codes))
    summed = blocks.select("lengths", "train", "ids", "words").mapInArrow(tidied(sums), schema).repartition("word").mapInArrow(tidied(total), schema)
    for r in summed.toLocalIterator():
        after[r["word"]] += np.frombuffer(r["after"], np.int64)
        before[r["word"]] += np.frombuffer(r["before"], np.int64)
    return after, before


# ---- exchange


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange_seeds(pairs: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of words by exchange: each in turn goes where the likelihood of the class bigrams is highest, until none moves.

    pairs: counts of word by next word; the last column and row, if there is one more than words to be
    classed, are all other words, which keep a class of their own.
    """
    n = len(pairs) - 1
    code = np.arange(n) % classes
    both = np.append(code, classes)
    to, by = np.zeros((n + 1, classes + 1)), np.zeros((n + 1, classes + 1))  # counts of word by class after it and before it
    np.add.at(to.T, both, pairs.T)
    np.add.at(by.T, both, pairs)
    cells = np.zeros((classes + 1, classes + 1))
    np.add.at(cells, both, to)
    loops = np.diag(pairs)
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            g = code[w]
            s, p, loop = to[w].copy(), by[w].copy(), loops[w]
            s[g] -= loop
            p[g] -= loop
            cells[g] -= s
            cells[:, g] -= p
            cells[g, g] -= loop
            out, into = s.sum() + loop, p.sum() + loop
            own = cells[:classes]
            gain = (_xlogx(own + s) - _xlogx(own)).sum(1) + (_xlogx(cells[:, :classes] + p[:, None]) - _xlogx(cells[:, :classes])).sum(0)
            k = np.arange(classes)
            middle = cells[k, k]
            gain += _xlogx(middle + s[k] + p[k] + loop) - _xlogx(middle + s[k]) - _xlogx(middle + p[k]) + _xlogx(middle)
            rows, columns = own.sum(1) + p[k], cells[:, :classes].sum(0) + s[k]  # the neighbours' sums have the word wherever it goes
            gain -= _xlogx(rows + out) - _xlogx(rows) + _xlogx(columns + into) - _xlogx(columns)
            best = int(np.argmax(gain))
            if gain[best] <= gain[g] + 1e-9:
                best = g
            cells[best] += s
            cells[:, best] += p
            cells[best, best] += loop
            if best != g:
                moved += 1
                code[w] = best
                for table, counts in ((to, pairs[:, w]), (by, pairs[w])):
                    table[:, g] -= counts
                    table[:, best] += counts
        if not moved:
            break
    return code


def likeliest(after: np.ndarray, before: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """For each word and class, the log-likelihood of the classes beside the word if it is of that class."""
    k = len(cells) - 1
    log = np.log(cells + 0.5)
    out, into = np.log(cells.sum(1) + 0.5 * len(cells))[:k], np.log(cells.sum(0) + 0.5 * len(cells))[:k]
    return after @ log[:k].T + before @ log[:, :k] - after.sum(1)[:, None] * out - before.sum(1)[:, None] * into


def class_cells(after: np.ndarray, before: np.ndarray, code: np.ndarray, classes: int) -> np.ndarray:
    """Counts of class by next class; the last is all other words'."""
    cells = np.zeros((classes + 1, classes + 1))
    np.add.at(cells, code, after)
    others = np.zeros((classes + 1, classes + 1))
    np.add.at(others, code, before)
    cells[classes] = others[:, classes]
    cells[classes, classes] = 0
    return cells


def exchange_round(after: np.ndarray, before: np.ndarray, code: np.ndarray, classes: int, may: np.ndarray) -> np.ndarray:
    """Classes after those words that may have moved at once; a word is left out of its own class when that is judged."""
    cells = class_cells(after, before, code, classes)
    worth = likeliest(after, before, cells)
    placed = np.flatnonzero(code < classes)
    own = code[placed]
    row, column = np.maximum(cells[own] - after[placed], 0), np.maximum(cells[:, own].T - before[placed], 0)
    half = 0.5 * len(cells)
    stay = (after[placed] * np.log(row + 0.5)).sum(1) + (before[placed] * np.log(column + 0.5)).sum(1)
    stay -= after[placed].sum(1) * np.log(row.sum(1) + half) + before[placed].sum(1) * np.log(column.sum(1) + half)
    worth[placed, own] = stay
    return np.where(may | (code == classes), worth.argmax(1), code)


def cluster(blocks: DataFrame, words: list[bytes], classes: int, seeds: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes and counts of the frequent words, and the counts of class by next class that they give."""
    n, few = len(words), min(seeds, len(words))
    after, before = beside(blocks, words[:few], np.arange(few), few + 1)
    pairs = np.zeros((few + 1, few + 1))
    pairs[:few], pairs[few, :few] = after, before[:, few]
    code = np.append(exchange_seeds(pairs, classes), np.full(n - few, classes))
    for k in range(rounds + 1):
        after, before = beside(blocks, words, code, classes + 1)
        if k == rounds:
            break
        may = np.zeros(n, bool) if k == 0 else (np.arange(n) + k) % 2 == 0  # the first pass places the words without a class
        code = exchange_round(after, before, code, classes, may)
    return code, before.sum(1).astype(np.int64), class_cells(after, before, code, classes)


# ---- all other words


def placed_rest(blocks: DataFrame, words: list[bytes], code: np.ndarray, cells: np.ndarray) -> DataFrame:
    """word, n and class of every training word that isn't a frequent one."""
    n, place, end = len(words), {w: k for k, w in enumerate(words)}, words.index(END)
    m = len(cells)
    code = np.append(code, m - 1).astype(np.uint8)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The classes before and after each place of a word, two bytes a place, by block."""
        for one, block in _blocks(batches):
            own_words = _words(one)
            local = placed(own_words, place)
            of = code[local]
            left, right = of[block.before()], np.full(len(block.ids), code[end])  # the end is last, and no rare word
            right[:-1] = of[block.ids[1:]]
            at = np.flatnonzero((local == n)[block.ids] & np.repeat(block.train, block.lengths))
            at = at[np.argsort(block.ids[at], kind="stable")]
            which, first = np.unique(block.ids[at], return_index=True)
            sides = np.stack([left[at], right[at]], 1).reshape(-1)
            offsets = np.append(2 * first, 2 * len(at)).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(sides.tobytes())])
            batch = pa.RecordBatch.from_arrays([own_words.take(pa.array(which)), column], names=["word", "sides"])
            for k in range(0, len(which), 20_000):
                yield batch.slice(k, 20_000)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a word: words come in order, the last of a batch may go on in the next."""
        held, held_sides = None, np.zeros((1, 2 * m))

        def classed(names: pa.Array, sides: np.ndarray) -> pa.RecordBatch:
            worth = likeliest(sides[:, m:], sides[:, :m], cells)
            return pa.RecordBatch.from_arrays([names, pa.array(sides[:, m:].sum(1).astype(np.int64)), pa.array(worth.argmax(1).astype(np.int32))], names=["word", "n", "class"])

        for batch in batches:
            for part in (batch.slice(k, 5000) for k in range(0, batch.num_rows, 5000)):
                names, column = part.column(0), part.column(1)
                fresh = np.ones(len(names), bool)
                fresh[1:] = np.array(pc.not_equal(names[1:], names[:-1]))
                of = np.cumsum(fresh) - 1
                offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
                data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.int64)
                data[1::2] += m
                rows = np.repeat(of, np.diff(offsets))
                sides = np.bincount(rows * 2 * m + data, minlength=(of[-1] + 1) * 2 * m).reshape(-1, 2 * m).astype(np.float64)
                names = names.filter(pa.array(fresh))
                if held is not None and held[0] == names[0]:
                    sides[0] += held_sides[0]
                elif held is not None:
                    yield classed(held, held_sides)
                if len(names) > 1:
                    yield classed(names[:-1], sides[:-1])
                held, held_sides = names[-1:], sides[-1:]
        if held is not None:
            yield classed(held, held_sides)

    rows = blocks.select("lengths", "train", "ids", "words").mapInArrow(tidied(found), "word binary, sides binary")
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(tidied(settled), "word binary, n bigint, class int")


# ---- the model


@dataclass
class ClassModel:
    """words, counts, code: the frequent words; rest: the others as a table; moves: counts of class by next class."""

    words: list[bytes]
    counts: np.ndarray
    code: np.ndarray
    rest: DataFrame
    moves: np.ndarray
    n: int
    types: int
    singles: int


_KNOWN = ["codes", "ends", "bases", "known", "moves"]


def looked_up(blocks: DataFrame, words: list[bytes], counts: np.ndarray, code: np.ndarray, rest: DataFrame, classes: int) -> tuple[DataFrame, str]:
    """The blocks with the class of each token, what the counts of its words give each text, and counts of class by next class of the training texts."""
    spark = blocks.sparkSession
    few = spark.createDataFrame([(w, int(n), int(k)) for w, n, k in zip(words, counts, code, strict=True) if n], "word binary, n long, class int")  # bounded
    listed = blocks.select(F.col("block").alias("of"), F.posexplode("words").alias("at", "word"))
    met = listed.join(rest.unionByName(few), "word").select("of", (F.col("at").cast("long") * 256 + F.col("class")).alias("place"), "n")
    schema = T.StructType([*(blocks.schema[c] for c in ("rows", "lengths", "train")), *(T.StructField(c, T.BinaryType()) for c in _KNOWN[:-1]), T.StructField(_KNOWN[-1], T.ArrayType(T.IntegerType()))])
    arrow = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in schema])

    def run(one: pa.Table, found: pa.Table) -> pa.Table:
        one = one.combine_chunks().to_batches()[0]
        block, size = Block(one), one.column(one.schema.get_field_index("types"))[0].as_py()
        own, seen = np.full(size, _UNKNOWN, np.uint8), np.zeros(size, np.int64)
        place = found.column("place").to_numpy()
        own[place >> 8], seen[place >> 8] = place & 255, found.column("n").to_numpy()
        codes, of = own[block.ids], lambda x: np.add.reduceat(x[block.ids], block.starts).tobytes()
        left, right = block.learned(own[block.before()], codes)
        moves = np.bincount(left.astype(np.int64) * classes + right, minlength=classes * classes).astype(np.int32)
        made = [codes.tobytes(), of(np.log10(np.maximum(seen, 1))), of(np.log10(seen + 1.0)), of((seen > 0).astype(np.int64))]
        columns = [one.column(one.schema.get_field_index(c)) for c in ("rows", "lengths", "train")] + [pa.array([x], pa.binary()) for x in made] + [pa.array([moves], pa.list_(pa.int32()))]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    left = blocks.select("block", "rows", "lengths", "train", "ids", F.size("words").alias("types"))
    return _kept(left.groupBy("block").cogroup(met.groupBy("of")).applyInArrow(run, schema), "lm-classes")


def _fit(blocks: DataFrame, classes: int, seeds: int, most: int, rounds: int) -> tuple[ClassModel, DataFrame]:
    spark = blocks.sparkSession
    words = frequent(blocks, seeds, most)
    code, counts, cells = cluster(blocks, words, classes, seeds, rounds)
    forget(spark)
    rest, _ = cut(placed_rest(blocks, words, code, cells), "lm-words")
    forget(spark)
    known, _ = looked_up(blocks, words, counts, code, rest, classes)
    forget(spark)
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    more = rest.agg(F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("singles")).first()
    moves = np.zeros(classes * classes)
    for r in known.select(F.posexplode("moves").alias("at", "n")).where("n > 0").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each cell at most
        moves[r["at"]] = r["n"]
    types, singles = more["types"] + int((counts > 0).sum()), more["singles"] + int((counts == 1).sum())
    return ClassModel(words, counts, code, rest, moves.reshape(classes, classes), total, types, singles), known


def _scored(known: DataFrame, model: ClassModel, keep: list[str]) -> DataFrame:
    classes = len(model.moves)
    n, types = model.n, model.types
    size = model.moves.sum(0)
    share = (size + 1e-300) / max(size.sum(), 1)
    after = (model.moves + ALPHA * share) / (model.moves.sum(1)[:, None] + ALPHA)
    unknown = (model.singles + 1) / (n + 2) if n else 1.0
    step = np.log10(np.vstack([after, share]))
    step = step - np.log10(np.maximum(size, 1)) + (np.log10(1 - unknown) if unknown < 1 else 0)
    # by class before and class, with the unknown word's last
    table = np.full((256, 256), np.log10(unknown))
    table[:classes, :classes], table[_UNKNOWN, :classes] = step[:classes], step[classes]
    table, floor = table.reshape(-1), -np.log10(n + types + 1)
    end = int(model.code[model.words.index(END)]) if model.counts[model.words.index(END)] else _UNKNOWN
    schema = T.StructType([*(known.schema["rows"].dataType.elementType[c] for c in keep), *(T.StructField(*f) for f in SCORES)])
    arrow = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(batch.schema.get_field_index(name))[k].as_buffer(), kind)  # noqa: B023, E731
                codes, lengths = get("codes", np.uint8), get("lengths", np.int32)
                starts = np.cumsum(lengths) - lengths
                left = np.empty_like(codes)
                left[1:] = codes[:-1]
                left[starts] = end
                value = table[left.astype(np.int32) * 256 + codes]
                rows = batch.column(0).slice(k, 1).flatten()
                columns = [rows.field(c) for c in keep]
                columns += [lengths, get("known", np.int64), np.full(len(lengths), n), get("bases", np.float64) + lengths * floor, get("ends", np.float64) + np.add.reduceat(value, starts)]
                yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return known.select("rows", "lengths", *_KNOWN[:-1]).mapInArrow(tidied(run), schema)


def fit(docs: DataFrame, *, text_col: str = "text", train: Column | None = None, classes: int = CLASSES, seeds: int = SEEDS, most: int = FREQUENT, rounds: int = ROUNDS) -> ClassModel:
    """A model of the texts of those rows that train holds for (all, if None)."""
    blocks, path = encode(docs, text_col=text_col, train=F.lit(True) if train is None else train, keep=[])
    model, _ = _fit(blocks, classes, seeds, most, rounds)
    drop(docs.sparkSession, path)
    return model


def score(docs: DataFrame, model: ClassModel, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns `keep`) with n_tokens, n_known, train_tokens, base_score and score of each text under a model."""
    keep = _own(docs, keep)
    blocks, path = encode(docs, text_col=text_col, train=F.lit(False), keep=keep)
    known, _ = looked_up(blocks, model.words, model.counts, model.code, model.rest, len(model.moves))
    drop(docs.sparkSession, path)
    return _scored(known, model, keep)


def fit_and_score(docs: DataFrame, *, train: Column, text_col: str = "text", keep: list[str] | None = None, classes: int = CLASSES, seeds: int = SEEDS, most: int = FREQUENT, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """As `fit` on the rows that train holds for and `score` of all rows, reading the texts once."""
    keep = _own(docs, keep)
    blocks, path = encode(docs, text_col=text_col, train=train, keep=keep, block=block)
    model, known = _fit(blocks, classes, seeds, most, rounds)
    drop(docs.sparkSession, path)
    return _scored(known, model, keep)


def _own(docs: DataFrame, keep: list[str] | None) -> list[str]:
    new = {name for name, _ in SCORES}
    return [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
