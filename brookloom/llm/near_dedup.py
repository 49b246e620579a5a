"""Operator 6, near-dedup with BagMinHash signatures.

A text is the multiset of its shingles of SHINGLE consecutive words (a text of fewer words, but not
none, is one shingle).  Each shingle owns a Poisson process over (weight, time), kept as a hierarchy of
weight intervals: the root is split into dyadic intervals [0,1), [1,2), [2,4), ..., whose processes are
independent with rates in proportion to their lengths, and an interval is split into its halves, a point
going to one of them by the next bit of its place.  A shingle that occurs w times owns the points below
w; the walk down to w is one comparison of a point's place with w, so about log2(w) processes are read.
Every point belongs to one of M signature components; a component is the earliest point of the text.  Two
texts agree in a component with a chance equal to their weighted Jaccard similarity.  Points come in order
of time from a hash of the shingle, so those after the time by which all components are filled are never
made; a text with an unfilled component is done again with a longer time.

Signatures are banded (BANDS x ROWS).  Texts that share a bucket are candidates; every link is
verified on the exact multisets: sum of minima over sum of maxima at least THRESHOLD.

Texts of one word sequence are one node, so copies are never paired.  Buckets are never paired out
either: the member that shares the most buckets (in a group of near copies the one that the others
are edits of) is the bucket's pivot, and each member is verified against it.  The members of a pivot are
cut into parts of about PART, and a part gets the pivot's text once.  Where a bucket then still holds
several components, its members outside the pivot's component are compared with all members whose size
allows the similarity, exactly and in tiles of about BLOCK x BLOCK by matrix products; a tile returns a
forest of its links.  What a bucket's members are told of it goes to parts of about PART of them, so that no
join by bucket or by pivot has one task for a whole bucket.  A pair in one component needs no test, as its link changes nothing.  So no link
between nodes that share a bucket is lost, no task gets more than tiles, and no pairs are written out.
Components come from alternating large-star and small-star rounds on tables in the shared folder; leaves
of stars are pointed to one of their pivots first, so that the hub of a star is not one task.

At similarity 0.8 a pair shares no bucket with a chance of (1 - 0.8^ROWS)^BANDS, 2e-5.

Defined cases: null texts and texts without a word are near nothing and are classes of their own; texts
of any length are read whole; repeated rows are copies of each other; null ids are kept and count as larger
than all others when the class id (the smallest id of the class) is chosen; an empty table gives an empty
result; extra columns, of whatever name, are kept by `deduplicate` and make no difference elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, as_bytes, bounded, cut, drop, ship, state_udf, texts_of, tidied

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 5
M = BANDS * ROWS
#: Members of a block when a bucket is compared in blocks.
BLOCK = 128
#: Nodes whose keys may be broadcast (about 60 bytes each); beyond, the join shuffles.
MAX_BROADCAST = 500_000
#: Members of a pivot that are verified at a time, and the most pivots of more members whose counts are broadcast.
PART, HOT = 256, 1000
_U = np.uint64


# ---- shingles and signatures


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random number for each byte, and the multiplier of the places in a word; odd, so it has an inverse.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)
_SPACE = 0x20
_powers: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, n of each; those of up to 4 million places are kept."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for step in (_STEP, _BACK):
        p = np.full(n, step, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= 4 << 20:
        _powers[:] = made
    return made[0], made[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and how many words each text has."""
    data = np.frombuffer(b" ".join([*texts, b""]).translate(WORD_TABLE), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    blank = data == _SPACE
    starts = np.flatnonzero(~blank & np.insert(blank[:-1], 0, True)) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1 if len(data) else starts
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    power, back = _powers_to(len(data))
    # a polynomial of a word's bytes, from running sums; the power of its place is taken out
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power, out=run[1:])
    h = mixed((run[ends] - run[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return h, np.diff(np.searchsorted(starts, begins))


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its distinct shingle hashes, ascending, and how often each occurs."""
    h, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    multiplier = _U(0x9E3779B97F4A7C15)
    whole = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for k in range(n):
        whole = mixed(whole * multiplier + h[k : k + len(whole)])
    out = []
    for end, size in zip(ends.tolist(), counts.tolist(), strict=True):
        if size >= n:
            out.append(np.unique(whole[end - size : end - n + 1], return_counts=True))
        elif size:
            total = np.full(1, size, np.uint64)
            for x in h[end - size : end]:
                total = mixed(total * multiplier + x)
            out.append((total, np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    both = int(a[1].sum() + b[1].sum()) - low
    return low / both if both else 0.0


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int = M, seed: int = 1) -> np.ndarray:
    """A row of m numbers (64 bits) for each multiset; none may be empty."""
    out = np.full((len(sets), m), np.inf)
    weight = np.array([s[1].sum() for s in sets], np.float64)
    limit = np.log(m / 0.05) / np.maximum(weight, 1)
    todo = np.arange(len(sets))
    while len(todo):
        _fill(out, [sets[i] for i in todo], todo, limit[todo], m, seed)
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        limit[todo] *= 2
    return mixed(out.view(np.uint64))


def _fill(out: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, limit: np.ndarray, m: int, seed: int) -> None:
    """Lower the components of some rows to their earliest points before the limit."""
    sizes = [len(s[0]) for s in sets]
    row = np.repeat(rows, sizes)
    until = np.repeat(limit, sizes)
    shingle = np.concatenate([s[0] for s in sets])
    weight = np.concatenate([s[1] for s in sets]).astype(np.float64)
    flat = out.reshape(-1)
    lower, length, level = 0.0, 1.0, 0
    while len(row):
        with np.errstate(over="ignore"):
            state = mixed(shingle + _U((seed * 0x9E3779B97F4A7C15 + level * 0xD1B54A32D192ED03) & (2**64 - 1)))
        r, t, end, w = row, np.zeros(len(row)), until, weight
        k = 0
        while len(r):
            k += 1
            with np.errstate(over="ignore"):
                x = mixed(state + _U(k * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            # most points come too late, which a comparison of the random numbers shows; the exact test follows
            near = (x >> _U(11)) >= (np.exp((t - end) * (length * m)) * 2.0**53 * (1 - 1e-9)).astype(np.uint64)
            if not near.all():
                r, t, end, w, state, x = r[near], t[near], end[near], w[near], state[near], x[near]
            t = t - np.log(((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (length * m)
            live = t <= end
            if not live.all():
                r, t, end, w, state, x = r[live], t[live], end[live], w[live], state[live], x[live]
            if not len(r):
                break
            y = mixed(x)
            own = (y >> _U(32)) % _U(m)
            inside = lower + length * ((y & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < w
            at = r * m + own.astype(np.int64)
            np.minimum.at(flat, at[inside], t[inside])
        lower, length, level = lower + length, (1.0 if level == 0 else length * 2), level + 1
        more = weight > lower
        row, until, shingle, weight = row[more], until[more], shingle[more], weight[more]


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each band of each signature."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mixed(key * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


# ---- Spark

_FEATURES = T.StructType([T.StructField("id", T.LongType()), T.StructField("own", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def node_of(text: bytes | None) -> bytes | None:
    """A hash of a text's words; null without any."""
    words = text.translate(WORD_TABLE).split() if text else None
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in bounded(whole, 1 << 20):
            texts = texts_of(batch, "t")
            nodes = [node_of(t) for t in texts]
            first: dict[bytes, int] = {}
            for k, n in enumerate(nodes):
                if n is not None:
                    first.setdefault(n, k)
            # of the rows of a node in this batch one carries its bands
            bands: list[list[int] | None] = [None] * len(texts)
            sizes: list[int | None] = [None] * len(texts)
            if first:
                sets = shingle_sets([texts[k] for k in first.values()])
                for k, own, keys in zip(first.values(), sets, band_keys(signatures(sets)), strict=True):
                    bands[k], sizes[k] = keys, int(own[1].sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("i").cast(pa.int64()),
                    batch.column("own").cast(pa.int64()),
                    pa.array(nodes, pa.binary()),
                    pa.array(sizes, pa.int32()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=_FEATURES.names,
            )


class _Corpus:
    """Texts by node, for verification."""

    def __init__(self, docs: DataFrame, features: DataFrame) -> None:
        self.docs = docs
        # the row that speaks for a node: its smallest id, and the hash of that row's text
        self.reps = features.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), F.col("own").alias("own"))).alias("rep"))

    def texts(self, nodes: DataFrame) -> DataFrame:
        """node and text of some nodes (one row each)."""
        wanted = self.reps.join(nodes, "node").select("node", F.col("rep.id").alias("_id"), F.col("rep.own").alias("_own"))
        wanted, self.path = cut(wanted, "near-wanted")
        side = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST else wanted
        rows = self.docs.select(F.coalesce("i", F.lit((1 << 63) - 1)).alias("_id"), F.col("own").alias("_own"), "t")
        return rows.join(side, ["_id", "_own"]).select("node", "t").dropDuplicates(["node"])


_PAIR = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def verified(pairs: DataFrame, corpus: _Corpus, threshold: float) -> tuple[DataFrame, list[str]]:
    """The pairs (a, pivot b) of nodes at the threshold; paths to drop when they have been used."""
    spark = pairs.sparkSession
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts, texts_at = cut(corpus.texts(nodes), "near-texts")
    drop(spark, corpus.path)
    hot = F.broadcast(pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > max(PART, pairs.count() // HOT)))  # HOT rows at most
    placed = pairs.join(hot, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce(F.ceil(F.col("n") / PART), F.lit(1))))
    members = placed.join(texts, F.col("a") == F.col("node")).select("b", "part", F.lit(1).alias("side"), "a", "t")
    pivots = placed.select("b", "part").distinct().join(texts, F.col("b") == F.col("node")).select("b", "part", F.lit(0).alias("side"), F.col("b").alias("a"), "t")
    rows = members.unionByName(pivots).repartition("b", "part").sortWithinPartitions("b", "part", "side")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in batches:
            for batch in bounded(whole, 2 << 20):
                keep = []
                for side, own in zip(batch.column("side").to_pylist(), shingle_sets([t or b"" for t in texts_of(batch, "t")]), strict=True):
                    if side == 0:  # the pivot of the rows that follow
                        held = own
                    keep.append(side == 1 and similarity(own, held) >= threshold)
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links, links_at = cut(rows.mapInArrow(tidied(check), _PAIR), "near-links")
    drop(spark, texts_at)
    return links, [links_at]


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """node and root (one node of its component) of all nodes of the links a-b, a node standing as a in few of them; and the table's path.

    Every a points to one of its b; its others are linked to that one.  So the leaves of a star are gone before
    any join on its hub, and rounds run on what is linked as b only.
    """
    spark = links.sparkSession
    links = links.where("a <> b")
    leaves, leaves_at = cut(links.groupBy("a").agg(F.min("b").alias("t")), "near-leaves")
    inner = links.join(leaves, "a").select("b", "t").where("b <> t")
    # a node that is an a and a b keeps its own pointer
    both = leaves.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("b"), "t")
    edges, at = cut(inner.unionByName(both).select(F.greatest("b", "t").alias("a"), F.least("b", "t").alias("b")).distinct(), "near-edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        new, new_at = cut(moved.union(low.select("a", F.col("m").alias("b"))).distinct(), "near-edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(spark, at)
        edges, at = new, new_at
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("t"), F.col("b").alias("r"))
    # pointers of leaves, and those of inner nodes; a join of two written tables, so that a common root is split
    found = leaves.join(roots, "t", "left").select(F.col("a").alias("node"), F.coalesce("r", "t").alias("root"))
    inside = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    whole, whole_at = cut(found.join(inside.select("node"), "node", "left_anti").unionByName(inside), "near-roots")
    drop(spark, leaves_at, at)
    return whole, whole_at


def overlaps(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], width: int = 4096) -> np.ndarray:
    """Weighted Jaccard similarity of each multiset of one list to each of another.

    A shingle that occurs w times is w columns of a 0-1 matrix, so the sums of minima are a matrix
    product, taken over `width` columns at a time.
    """

    def columns(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [int(s[1].sum()) for s in sets])
        shingle = np.concatenate([np.repeat(s[0], s[1]) for s in sets])
        level = np.concatenate([np.arange(n) for s in sets for n in s[1].tolist()] or [np.zeros(0, np.int64)]) if any((s[1] > 1).any() for s in sets) else np.zeros(len(row), np.int64)
        with np.errstate(over="ignore"):
            return row, shingle + mixed(level.astype(np.uint64)) * (level > 0)

    (row_a, a), (row_b, b) = columns(left), columns(right)
    shared = np.intersect1d(a, b)
    total = np.zeros((len(left), len(right)))
    for at in range(0, len(shared), width):
        part = shared[at : at + width]
        matrices = []
        for row, x, n in ((row_a, a, len(left)), (row_b, b, len(right))):
            place = np.searchsorted(part, x)
            place[place == len(part)] = 0
            hit = part[place] == x
            m = np.zeros((n, len(part)), np.float32)
            m[row[hit], place[hit]] = 1
            matrices.append(m)
        total += matrices[0] @ matrices[1].T
    size_a, size_b = (np.array([s[1].sum() for s in side], float) for side in (left, right))
    return total / np.maximum(size_a[:, None] + size_b[None, :] - total, 1)


def _links_of_tile(held: list[tuple], threshold: float) -> list[tuple[bytes, bytes]]:
    """Links of a tile that join components: a forest, so at most one for each member.  held: side, node, root, text."""
    left = [r for r in held if r[0] == 0]
    right = [r for r in held if r[0] == 1]
    if not left or not right:
        return []
    x, y = (shingle_sets([r[3] for r in side]) for side in (left, right))
    parent: dict[bytes, bytes] = {}

    def top(k: bytes) -> bytes:
        while parent.setdefault(k, k) != k:
            k = parent[k] = parent[parent[k]]
        return k

    out = []
    for k, j in zip(*(z.tolist() for z in np.nonzero(overlaps(x, y) >= threshold)), strict=True):
        a, b = top(left[k][2]), top(right[j][2])
        if a != b:
            parent[a] = b
            out.append((left[k][1], right[j][1]))
    return out


def _part(n: str) -> Column:
    """Which of its bucket's parts of about PART members a node is in, of n members (null: one part)."""
    return F.pmod(F.xxhash64("node"), F.coalesce(F.ceil(F.col(n) / PART), F.lit(1)))


def _parts(n: str | Column) -> Column:
    """A row for each part of a bucket of n members (null: one part)."""
    size = F.col(n) if isinstance(n, str) else n
    return F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.ceil(size / PART), F.lit(1)) - 1))


def near_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """For each row: id_col, class_id (the smallest id of its class), class_size (rows), kept, and node (null without words)."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(text).alias("own"), text.alias("t"))
    features, features_at = cut(rows.select("i", "own", "t").mapInArrow(tidied(_features), _FEATURES), "near-features")
    corpus = _Corpus(rows, features)
    signed = features.where("bands IS NOT NULL")
    band_rows, band_rows_at = cut(signed.select("node", "size", F.explode("bands").alias("key")).distinct(), "near-bands")
    shared, shared_at = cut(band_rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-shared")
    most = max(PART, (shared.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = F.broadcast(shared.where(F.col("n") > most).select("key", F.col("n").alias("of_hot")))  # HOT rows at most
    dealt = band_rows.join(hot, "key", "left").withColumn("part", _part("of_hot")).drop("of_hot")
    counts = shared.withColumn("part", _parts(F.when(F.col("n") > most, F.col("n"))))
    live, live_at = cut(dealt.join(counts, ["key", "part"]).drop("part"), "near-buckets")
    drop(spark, band_rows_at, shared_at)
    degree = live.groupBy("node").agg(F.sum("n").alias("degree"))
    pivots = live.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("top"), F.max("n").alias("n"))
    pivots = pivots.select("key", F.col("top.node").alias("pivot"), _parts("n").alias("part"))
    members, members_at = cut(live.withColumn("part", _part("n")).join(pivots, ["key", "part"]), "near-members")
    pairs, pairs_at = cut(members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "near-pairs")
    links, links_at = verified(pairs, corpus, threshold)
    found, found_at = components(links)
    drop(spark, pairs_at, live_at)

    # buckets that still hold several components: compare who is outside the pivot's with all
    roots = members.where("n > 2").join(found, "node", "left").select("key", "part", "n", "node", "size", "pivot", F.coalesce("root", "node").alias("root"))
    # similar members have sizes in one class or in neighbouring ones: classes are a factor of the threshold wide
    roots = roots.withColumn("class", F.floor(F.log(F.col("size").cast("double")) / -float(np.log(threshold)) + 1e-9))
    per_bucket = roots.groupBy("key").agg(F.max(F.when(F.col("node") == F.col("pivot"), F.col("root"))).alias("pivot_root"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("n").alias("n"))
    per_bucket = per_bucket.where("low <> high").select("key", "pivot_root", _parts("n").alias("part"))
    still = roots.where("node <> pivot").join(per_bucket, ["key", "part"])
    still, still_at = cut(still.select("key", "class", "node", "root", (F.col("root") != F.col("pivot_root")).alias("apart")), "near-still")
    out = F.count_if("apart").alias("out")
    sizes, sizes_at = cut(still.groupBy("key", "class").agg(F.count("*").alias("n"), out), "near-classes")
    texts, texts_at = cut(corpus.texts(still.select("node").distinct()), "near-texts")
    near = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    block = lambda n: F.pmod(F.xxhash64("node"), n)
    # a tile: block i of the outsiders of one class, block j of the members of the same or a neighbouring class
    other = sizes.select("key", F.col("class").alias("other"), F.col("n").alias("n_other"))
    kinds = sizes.where("out > 0").select("key", "class", "out", near("class").alias("other")).join(other, ["key", "other"])
    left = still.where("apart").join(kinds, ["key", "class"]).withColumn("i", block(blocks("out"))).withColumn("j", every(blocks("n_other"))).withColumn("side", F.lit(0))
    as_other = still.select("key", F.col("class").alias("other"), "node", "root")
    right = as_other.join(kinds, ["key", "other"]).withColumn("j", block(blocks("n_other"))).withColumn("i", every(blocks("out"))).withColumn("side", F.lit(1))
    tile = ["key", "class", "other", "i", "j"]
    cells = left.select(*tile, "side", "node", "root").unionByName(right.select(*tile, "side", "node", "root"))
    tiles = cells.join(texts, "node").select(*tile, "side", "node", "root", "t")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def found() -> pa.RecordBatch:
            pairs = _links_of_tile(held, threshold)
            return pa.RecordBatch.from_arrays([pa.array([p[c] for p in pairs], pa.binary()) for c in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*tile, "side", "node", "root")]
            for *place, side, node, root, text in zip(*columns, texts_of(batch, "t"), strict=True):
                if place != last:
                    yield found()
                    last = place
                    held.clear()
                held.append((side, node, root, text))
        yield found()

    more, more_at = cut(tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(tidied(compare), _PAIR), "near-links")
    drop(spark, corpus.path, texts_at, still_at, sizes_at)
    whole = more.union(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    final, final_at = components(whole)
    drop(spark, more_at, members_at, found_at, *links_at)

    # a class is a component, or a node that is linked to none, or a row without words
    per_node = features.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    per_node, per_node_at = cut(per_node.join(final, "node", "left").select("node", "least", "rows", F.coalesce("root", "node").alias("root")), "near-nodes")
    per_root = per_node.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least"), F.col("node"))).alias("first"), F.sum("rows").alias("class_size"))
    per_root, per_root_at = cut(per_root, "near-roots")
    classes = per_node.join(per_root, "root").select("node", F.col("first.least").alias("class_id"), F.col("first.node").alias("keep_node"), "class_size")
    classes, classes_at = cut(classes, "near-classes")
    drop(spark, final_at, per_node_at, per_root_at)
    out = features.select("id", "node").join(classes, "node", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("node").isNull() | ((F.col("node") == F.col("keep_node")) & F.col("id").eqNullSafe(F.col("class_id")))).alias("kept"),
        "node",
    )
    result, _ = cut(out, "near-result")
    drop(spark, features_at, classes_at)
    return result


def deduplicate(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """docs with one row of each class: the one of the smallest id; all rows without words stay."""
    found = near_duplicates(docs, text_col=text_col, id_col=id_col, **options)
    keep = found.where("kept AND node IS NOT NULL").select(F.col(id_col).alias("_keep"), F.col("node").alias("_node")).distinct()
    columns = docs.columns
    inner = [f"_doc{k}" for k in range(len(columns))]
    own = dict(zip(columns, inner, strict=True))
    renamed = docs.toDF(*inner)

    def nodes(slices):
        for (texts,) in slices:
            yield pa.array([node_of(t) for t in as_bytes(texts)], pa.binary())

    with_node = renamed.withColumn("_own_node", state_udf(nodes, T.BinaryType(), F.col(own[text_col]).cast("string")))
    matched = with_node.where("_own_node IS NOT NULL").join(keep, (F.col("_own_node") == F.col("_node")) & F.col(own[id_col]).eqNullSafe(F.col("_keep")))
    # rows that repeat an id and a word sequence are one document
    matched = matched.dropDuplicates(["_own_node"]).select(*inner)
    return with_node.where("_own_node IS NULL").select(*inner).union(matched).toDF(*columns)
