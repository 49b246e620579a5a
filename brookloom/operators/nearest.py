"""Exact nearest neighbours between two large sets of vectors, by pivots and the triangle inequality.

The corpus falls into the cells of a bounded number of pivots, each with its least and largest distance to the
pivot, and large cells into blocks.  A query first meets the cell it is nearest to, which gives it a bound, and
then only those whose members could be nearer: by the triangle inequality on the pivot's distance, and by the
plane between two pivots.  Blocks of a group stand on shelves and queries are dealt into parts, both of bounded
bytes; a part goes to a shelf once, with the blocks each of its queries meets, as matrix products in one task.

How much that saves depends on the data: in clusters most cells are never met; where all vectors are about
equally far from each other no bound holds anything back, and the work is that of all products, in blocks.

Defined cases: rows without a vector, or with a null in it, are near nothing and left out; so are vectors of
another length than `size`, and without `size` vectors of several lengths are an error; a vector of length 0
has the cosine 0 to all; ties go to the smaller id; empty sides give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import _better, usable
from ..sources.shipping import ship

#: Rows of a block, queries that meet a block at a time, and the most pivots.
BLOCK, QUERIES, PIVOTS = 4096, 1024, 1024
#: Bytes of vectors of a shelf and of a part of the queries: a task holds one of each.  Parts that are made of fewer queries, for the sake of many tasks.
SHELF_BYTES, PARTS = 16 << 20, 8
_EDGE = 1e-5  # bounds are computed in floating point: what is this near to one is met


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as unit rows; a vector of length 0 stays."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; rows of length 0 are where they are, too."""
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def pivots_of(corpus: DataFrame, n: int) -> np.ndarray:
    """n rows of the corpus by a hash of their ids, as unit vectors: a bounded number, whatever the corpus has."""
    rows = corpus.orderBy(F.xxhash64("id"), "id").limit(n).select("x").toArrow()
    return matrix(rows.column("x").combine_chunks()) if rows.num_rows else np.zeros((0, 1))


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 1, **options) -> DataFrame:
    """query_id, group, id, sim and rank: the k corpus rows of each group that are most similar to each query, exactly.

    queries: id, embedding and groups (an array of the groups to search); corpus: id, embedding and group.
    Ids are longs and tell queries apart, groups are of one type.
    """
    return _searched(queries, corpus, k, **options)[0]


def visits_of(queries: DataFrame, corpus: DataFrame, k: int = 1, **options) -> int:
    """How many pairs of a query and a corpus row `nearest` multiplies."""
    _, visitors, blocks = _searched(queries, corpus, k, **options)
    if blocks is None:
        return 0
    key = ["group", "shelf", "place"]
    sizes = blocks.groupBy(*key).agg(F.count("*").alias("n"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [np.nonzero(_bits(b))[0] for b in batch.column("blocks").to_pylist()]
            each = pa.array(np.repeat(np.arange(len(met)), [len(m) for m in met]))
            place = np.concatenate([*met, np.zeros(0, np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("group").take(each), batch.column("shelf").take(each), pa.array(place)], names=key)

    met = visitors.select("group", "shelf", "blocks").mapInArrow(places, blocks.select(*key).schema).groupBy(*key).agg(F.count("*").alias("met"))
    return met.join(sizes, key).agg(F.sum(F.col("n") * F.col("met"))).first()[0] or 0


def _bits(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8))


def _searched(queries: DataFrame, corpus: DataFrame, k: int, *, size: int | None = None, digits: int = 6, block: int = BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The neighbours, the visits of queries to blocks, and the blocks."""
    spark = corpus.sparkSession
    ship(spark)
    group_type = corpus.schema["group"].dataType
    corpus = usable(corpus.where("id IS NOT NULL AND group IS NOT NULL"), "embedding", size).select("id", "group", F.col("embedding").alias("x"))
    queries = usable(queries.where("id IS NOT NULL"), "embedding", size).select("id", "groups", F.col("embedding").alias("x"))
    points = pivots_of(corpus, max(1, min(pivots, -(-corpus.count() // block))))
    if not len(points):
        nothing = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("group", group_type), T.StructField("id", T.LongType()), T.StructField("sim", T.DoubleType()), T.StructField("rank", T.IntegerType())])
        return spark.createDataFrame([], nothing), None, None
    width = len(points[0])
    queries = queries.where(F.size("x") == width)
    most = max(1, SHELF_BYTES // (4 * width))  # vectors of a shelf or a part
    n_queries = queries.count()
    parts = max(1, -(-n_queries // most), min(PARTS, n_queries // QUERIES))
    queries = queries.withColumn("deal", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(parts)).cast("int"))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _distances(matrix(batch.column(2)), points)
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell])], names=[*batch.schema.names, "cell", "far"])

    placed = corpus.mapInArrow(celled, T.StructType([*corpus.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())]))
    # a row for each group and pivot: these are few, as groups are
    cells = placed.groupBy("group", "cell").agg(F.count("*").alias("n"), F.min("far").alias("least"), F.max("far").alias("most")).collect()
    table: dict = {}
    for r in cells:
        table.setdefault(r["group"], []).append((r["cell"], r["n"], r["least"], r["most"]))
    table = {g: tuple(np.array(c) for c in zip(*sorted(rows), strict=True)) for g, rows in table.items()}
    between = _distances(points, points)
    hit = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("group", group_type), T.StructField("id", T.LongType()), T.StructField("sim", T.DoubleType())])
    visit = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("group", group_type), T.StructField("shelf", T.IntegerType()), T.StructField("deal", T.IntegerType()), T.StructField("blocks", T.BinaryType()), T.StructField("q", queries.schema["x"].dataType)])
    # the blocks of a group in order of cell and part, on shelves of so many rows; a block's place is that on its shelf
    on_shelf: dict = {}
    place_of: dict = {}
    for g, (which, n, _, _) in table.items():
        split = -(-n // block)
        rows = np.repeat(-(-n // split), split)
        shelf = (np.cumsum(rows) - rows) // most
        place = np.arange(len(shelf)) - np.searchsorted(shelf, shelf)
        on_shelf[g] = (split, shelf)
        cells_of = np.repeat(which, split)
        nth = np.arange(len(shelf)) - np.repeat(np.cumsum(split) - split, split)
        place_of.update({(g, int(c), int(i)): (int(s), int(p)) for c, i, s, p in zip(cells_of, nth, shelf, place, strict=True)})

    def least_far(far: np.ndarray, which: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How near a member of each cell can be to each query at least."""
        own = far.argmin(1)
        bound = np.maximum(far[:, which] - high, low - far[:, which])
        plane = (far[:, which] ** 2 - far[np.arange(len(far)), own][:, None] ** 2) / (2 * np.maximum(between[own][:, which], 1e-9))
        return np.maximum(np.maximum(bound, np.where(between[own][:, which] > 1e-6, plane, 0)), 0)

    def visits(batch: pa.RecordBatch, first: bool) -> Iterator[pa.RecordBatch]:
        """A row of a query for each shelf it has to meet, with the blocks there: those of the first cell, or of the others within the bound."""
        far = _distances(matrix(batch.column("x")), points)
        wanted = batch.column("groups").to_pylist()
        bounds = None if first else batch.column("bounds").to_pylist()
        of_group: dict = {}
        for i, groups in enumerate(wanted):
            for j, g in enumerate(groups or []):
                if g in table:
                    of_group.setdefault(g, []).append((i, None if first else bounds[i][j]))
        for g, members in of_group.items():
            which, n, low, high = table[g]
            at = np.array([i for i, _ in members])
            bound = least_far(far[at], which, low, high)
            start = np.lexsort((np.broadcast_to(far[at][:, which], bound.shape), bound))[:, 0]
            meets = np.zeros(bound.shape, bool)
            meets[np.arange(len(at)), start] = True
            if not first:  # a bound of None: fewer than k rows were met, so all others are
                limit = np.array([np.inf if b is None else b for _, b in members])
                meets = ~meets & (bound <= limit[:, None] + _EDGE)
            split, shelf = on_shelf[g]
            meets = np.repeat(meets, split, axis=1)
            for sh in np.unique(shelf):
                own = meets[:, shelf == sh]
                comes = np.nonzero(own.any(1))[0]
                packed = np.packbits(own[comes], axis=1)
                for s in range(0, len(comes), 2000):
                    some = pa.array(at[comes[s : s + 2000]])
                    m = len(some)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(some), pa.array([g] * m, batch.schema.field("groups").type.value_type), pa.array([sh] * m, pa.int32()), batch.column("deal").take(some), pa.array([p.tobytes() for p in packed[s : s + 2000]], pa.binary()), batch.column("x").take(some)], names=visit.names)

    counts = {(g, int(c)): int(-(-n // block)) for g, (cs, ns, _, _) in table.items() for c, n in zip(cs, ns, strict=True)}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("group").to_pylist(), batch.column("cell").to_pylist(), batch.column("deal").to_pylist(), strict=True)
            found = [place_of[g, c, d % counts[g, c]] for g, c, d in keys]
            yield pa.RecordBatch.from_arrays([batch.column("group"), *(pa.array([f[i] for f in found], pa.int32()) for i in range(2)), batch.column("id"), batch.column("x")], names=["group", "shelf", "place", "id", "x"])

    deal = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)).cast("int").alias("deal")
    blocks = placed.select("group", "cell", "id", "x", deal).mapInArrow(dealt, T.StructType([placed.schema["group"], T.StructField("shelf", T.IntegerType()), T.StructField("place", T.IntegerType()), placed.schema["id"], placed.schema["x"]]))

    def products(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.schema.field("group").type
        empty = pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], kind), pa.array([], pa.int64()), pa.array([], pa.float64())], names=hit.names)
        if not (left.num_rows and right.num_rows):
            return empty
        ids, place = np.asarray(right.column("id").combine_chunks()), np.asarray(right.column("place").combine_chunks())
        order = np.lexsort((ids, place))
        ids, place, y = ids[order], place[order], matrix(right.column("x").combine_chunks())[order]
        ends = np.flatnonzero(np.diff(place, append=-1)) + 1
        q_ids, packed, out = np.asarray(left.column("query_id").combine_chunks()), left.column("blocks").combine_chunks(), []
        x, scale = left.column("q").combine_chunks(), 10.0**digits
        for s in range(0, len(q_ids), QUERIES):
            q = matrix(x.slice(s, QUERIES))
            bits = _bits(b"".join(packed.slice(s, QUERIES).to_pylist())).reshape(len(q), -1)
            best_s, best_i = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
            for start, end in zip((0, *ends[:-1]), ends, strict=True):
                met = np.nonzero(bits[:, place[start]])[0]
                if not len(met):
                    continue
                own = ids[start:end]
                # as np.round does it, in place; what is kept is divided at the end
                sims = q[met] @ y[start:end].T
                np.multiply(sims, scale, out=sims)
                np.rint(sims, out=sims)
                if k == 1:
                    at = sims.argmax(1)
                    top, of = sims[np.arange(len(met)), at], own[at]
                    top[np.isnan(top)] = np.inf
                    better = (top > best_s[met, 0]) | ((top == best_s[met, 0]) & (of < best_i[met, 0]))
                    best_s[met[better], 0], best_i[met[better], 0] = top[better], of[better]
                else:
                    sims[np.isnan(sims)] = np.inf
                    some_s, some_i = best_s[met], best_i[met]
                    _better(some_s, some_i, sims, own)
                    best_s[met], best_i[met] = some_s, some_i
            row, rank = np.nonzero(best_s > -np.inf)
            kept = best_s[row, rank]
            kept[np.isinf(kept)] = np.nan
            out.append((q_ids[s : s + QUERIES][row], best_i[row, rank], kept / scale))
        a, b, c = (np.concatenate(v) for v in zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(a), pa.array([key[0].as_py()] * len(a), kind), pa.array(b), pa.array(c, from_pandas=False)], names=hit.names)

    everywhere = blocks.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def met(visitors: DataFrame) -> DataFrame:
        meet = ["group", "shelf", "deal"]
        return visitors.groupBy(*meet).cogroup(everywhere.groupBy(*meet)).applyInArrow(products, hit)

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id", "group").orderBy(F.desc("sim"), "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from visits(batch, True)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from visits(batch, False)

    at_first = queries.mapInArrow(first, visit)
    near = best(met(at_first))
    # the distance of the k-th so far; unit vectors: d^2 = 2 - 2 cos, a vector of length 0 is at 1 of all and may be at any rank
    reach = F.sqrt(F.greatest(2 - 2 * F.min("sim"), F.lit(0.0)) + 2 * 10.0**-digits)
    bounds = near.groupBy("query_id", "group").agg(F.when((F.count("*") >= k) & (F.min("sim") > 0), reach).alias("bound")).groupBy(F.col("query_id").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("group", "bound"))).alias("known"))
    told = queries.join(bounds, F.col("id") == F.col("of"), "left").select("id", "groups", "x", "deal", F.transform("groups", lambda g: F.try_element_at("known", g)).alias("bounds"))
    then = told.mapInArrow(others, visit)
    return best(near.drop("rank").unionByName(met(then))), at_first.unionByName(then), blocks


def label_nearest(df: DataFrame, id_col: str, label: str, embedding: str, *, digits: int = 6, size: int | None = None, **sizes: int) -> DataFrame:
    """a, b, id and sim: of each vector of label a the largest cosine to the vectors of label b, for all a <= b."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).alias("group"), F.col(embedding).alias("embedding"))
    labels = sorted(r["group"] for r in rows.select("group").distinct().collect())  # what is compared: few
    onward = F.filter(F.array(*(F.lit(x) for x in labels)).cast(f"array<{rows.schema['group'].dataType.simpleString()}>"), lambda g: g >= F.col("group"))
    found = nearest(rows.select("id", "embedding", onward.alias("groups")), rows, 1, size=size, digits=digits, **sizes)
    own = rows.select(F.col("id").alias("query_id"), F.col("group").alias("a"))
    return found.join(own, "query_id").select("a", F.col("group").alias("b"), F.col("query_id").alias("id"), "sim")
