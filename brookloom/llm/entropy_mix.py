"""Operator 10, mixing sources to target weights by entropy balancing.

Among all document rates that meet the token constraints, the ones closest to "every document once" (in
relative entropy, a document counting by its tokens, no rate above `cap`) are exponentially tilted: the
rate of a document is min(cap, exp(sum of the multipliers of its constraints)).  Two kinds of constraints
overlap: each source meets its target exactly, and each length class (powers of four words) keeps its share
of all words as far as the sources and the cap allow, a departure costing SLACK in the dual.  The
multipliers solve the convex dual
    minimise  sum_d tokens_d * f(lambda_source + mu_length) - lambda . target - mu . share + SLACK/2 |mu|^2
(f is exp up to log cap, its tangent beyond) by damped Newton iterations over mu.  In each, a distributed
pass over the constraint patterns of the documents (a row for each source, with its words by length class)
finds every source's multiplier in closed form and adds up objective, gradient and Hessian; the driver
holds numbers by length class only, so the number of sources is not limited.  Sums are of whole numbers, so
they don't depend on the order of rows.

Rates are then rounded into whole copies: from the largest document to the smallest, each takes the whole
part of its rate and one more when the words owed so far make up half of it.  Documents too long for a
chunk's other rows to absorb (above 1/SHARE of what a chunk has, on average, of no longer documents) are
rounded for their whole source, over the table of (source, size) with a count each; the words they leave
owed go to the rate by which the source's other rows are rounded.  Those are dealt by (source, chunk), where
a source has as many chunks as its rows need, so a source with a third of all rows is spread like any
other.  What stays owed in a chunk is less than about its smallest documents, so each source's words
come near its target.  No rate is above `cap`, so no document exceeds `cap` copies.  Order and hashes
depend on the rows alone: reruns agree.

Targets: sources in code-point order, null last, weigh WEIGHTS, repeating; they share all words; a target
stops at `cap` times its source's words and the excess is shared again by weight until none is above.

Defined cases: a null text has no words; a null source is a source, the last one; a source without words
has target 0; documents without words take the whole part of their rate and no words; texts of any length
are counted whole; repeated rows are mixed one by one, and ties are broken by the other columns; an empty
table gives an empty mix; an input column that has the name of an output column is replaced by `mix` and kept
by `mixed_documents`.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, ship, state_udf

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Length classes: up to 4, 16, 64, ... words.
CLASSES = 8
#: What a departure of the length classes from their shares costs, for a multiplier of 1 and one of all words.
SLACK = 0.02
#: Rows of a chunk, on average.
CHUNK = 250
#: A document above this part of a chunk's words is rounded with its source, not in a chunk.
SHARE = 8
#: Sources whose rates are broadcast; beyond, the join shuffles.
MAX_BROADCAST = 100_000
#: Units of a sum that is all words.
UNITS = float(1 << 40)
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def class_of(size: Column, classes: int = CLASSES) -> Column:
    """The length class of a number of words, from 0."""
    return sum(((size >= F.lit(4**k)).cast("int") for k in range(1, classes)), F.lit(0))


def with_targets(stats: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> tuple[DataFrame, list[str]]:
    """stats (a row for each source: _source, tokens) with target; paths to drop when it has been used.

    Sources are numbered in order by their place in sorted partitions.  The targets are
    least(weight * unit, cap * tokens) for the one unit at which they add up to all tokens; it is found by
    closing the sources above their cap until no more are, a distributed sum for each round.
    """
    spark = stats.sparkSession
    order = F.col("_source").asc_nulls_last()
    ranged = stats.repartitionByRange(order).sortWithinPartitions(order)
    ranged, at = cut(ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "mix-ordered")
    counted = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())  # a row for each partition
    before = np.cumsum([0, *(n for _, n in counted)])
    offsets = spark.createDataFrame([(k, int(before[i])) for i, (k, _) in enumerate(counted)], "_part int, _before long")
    turn = ((F.col("_before") + F.col("_row")) % len(weights) + 1).cast("int")
    placed = ranged.join(F.broadcast(offsets), "_part").withColumn("_weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn)).drop("_part", "_row", "_before")
    most = F.lit(cap) * F.col("tokens")
    total = placed.agg(F.sum("tokens")).first()[0] or 0
    unit, closed = 0.0, -1
    while True:
        over = F.col("_weight") * unit > most if closed >= 0 else F.lit(False)
        r = placed.agg(F.sum(F.when(over, most).otherwise(0.0)).alias("held"), F.sum(F.when(over, 0.0).otherwise(F.col("_weight"))).alias("open"), F.count_if(over).alias("n")).first()
        if r["n"] == closed or not r["open"]:
            break
        unit, closed = max(0.0, total - r["held"]) / r["open"], r["n"]
    return placed.withColumn("target", F.least(F.col("_weight") * unit, most)).drop("_weight"), [at]


def source_rates(words: np.ndarray, target: np.ndarray, mu: np.ndarray, cap: float) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier of each source, and its rates by length class, so that each source meets its target.

    words: a row for each source.  From the class of the largest multiplier on, classes reach the cap; for each number
    of them the others share what is left, and the first number that leaves no rate above the cap is right.
    """
    order = np.argsort(-mu, kind="stable")
    own, tilt = words[:, order], np.exp(mu[order])
    lam = np.full(len(words), -np.inf)
    open_ = target > 0
    full = target >= cap * words.sum(axis=1)
    lam[full & open_] = np.inf
    open_ &= ~full
    for k in range(words.shape[1]):
        left = target - cap * own[:, :k].sum(axis=1)
        mass = own[:, k:] @ tilt[k:]
        here = open_ & (mass > 0) & (left > 0)
        guess = np.log(np.where(here, left, 1.0) / np.where(here, mass, 1.0))
        # the largest open class that the source has must not pass the cap
        largest = np.where(own[:, k:] > 0, tilt[k:], 0.0).max(axis=1)
        here &= np.exp(guess) * largest <= cap * (1 + 1e-12)
        lam[here], open_ = guess[here], open_ & ~here
    with np.errstate(over="ignore"):
        return lam, np.minimum(cap, np.exp(lam[:, None] + mu[None, :]))


def solve_dual(patterns: DataFrame, cap: float = CAP, *, slack: float = SLACK, tolerance: float = 1e-7, rounds: int = 60) -> np.ndarray:
    """The multipliers of the length classes.  patterns: `target` and `words` (array, by length class), one row for each source."""
    k = len(patterns.first()["words"]) if patterns.take(1) else 0
    sums = patterns.agg(F.sum("target").alias("t"), *(F.sum(F.col("words")[i]).alias(f"w{i}") for i in range(k))).first()
    mu = np.zeros(k)
    if k < 2 or not sums["t"]:
        return mu
    total = float(sum(sums[f"w{i}"] for i in range(k)))
    share = np.array([sums[f"w{i}"] / total for i in range(k)])
    schema = T.StructType([T.StructField("sums", T.ArrayType(T.LongType()))])

    def sums_at(mu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Objective, gradient and Hessian at mu, for one of all words."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                words = np.array(b.column("words").to_pylist(), float)
                target = b.column("target").to_numpy(zero_copy_only=False)
                lam, rate = source_rates(words, target, mu, cap)
                mass = words * rate / total
                free = mass * (rate < cap)
                weight = free.sum(axis=1, keepdims=True)
                hessian = np.einsum("sk,kl->skl", free, np.eye(k)) - free[:, :, None] * free[:, None, :] / np.maximum(weight, 1e-300)[:, :, None]
                finite = np.isfinite(lam)
                over = np.maximum(np.where(finite[:, None], lam[:, None], 0.0) + mu[None, :] - np.log(cap), 0.0)
                value = np.where(finite, (mass + cap * words / total * over).sum(axis=1) - np.where(finite, lam, 0.0) * target / total, (mass * mu[None, :]).sum(axis=1))
                # whole numbers: their sum is the same in any order
                found = np.column_stack((value, mass, hessian.reshape(len(words), k * k)))
                yield pa.RecordBatch.from_arrays([pa.array([np.rint(found * UNITS).astype(np.int64).sum(axis=0).tolist()], pa.list_(pa.int64()))], names=["sums"])

        parts = patterns.select("target", "words").mapInArrow(run, schema).select(F.posexplode("sums").alias("at", "v"))
        got = {r["at"]: r["v"] for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect()}  # (classes + 1)^2 numbers
        x = np.array([got[i] for i in range(1 + k + k * k)]) / UNITS
        return x[0] - mu @ share + slack / 2 * float(mu @ mu), x[1 : 1 + k] - share + slack * mu, x[1 + k :].reshape(k, k) + slack * np.eye(k)

    at, gradient, hessian = sums_at(mu)
    for _ in range(rounds):
        if np.abs(gradient).max() <= tolerance:
            return mu
        step = np.clip(-np.linalg.solve(hessian, gradient), -4.0, 4.0)
        size = 1.0
        while size > 1e-4:
            next_at, next_gradient, next_hessian = sums_at(mu + size * step)
            if next_at <= at + 1e-4 * size * float(gradient @ step) + 1e-11:
                break
            size /= 2
        else:
            break  # no step improves: the sums' precision is reached
        mu = mu + size * step
        at, gradient, hessian = next_at, next_gradient, next_hessian
    if np.abs(gradient).max() > 1e-4:
        warnings.warn(f"length classes miss their shares by {np.abs(gradient).max():.1e} of all words; sources meet their targets", stacklevel=2)
    return mu


def _by_source(df: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """df with the columns of a table of `n` sources."""
    named = table.withColumnRenamed("_source", "_name")
    return df.join(F.broadcast(named) if n <= MAX_BROADCAST else named, F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")


def mix(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", size_col: str | None = None, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, chunk: int = CHUNK, classes: int = CLASSES) -> DataFrame:
    """docs with size, source_size, target, rate, copies and taken for each row.

    size_col: a column that holds the sizes already, so that texts need not travel.
    classes: length classes that keep their shares; with 1 all documents of a source get one rate.
    """
    spark = docs.sparkSession
    ship(spark)
    new = ("size", "source_size", "target", "rate", "copies", "taken")
    kept = [c for c in docs.columns if c.lower() not in new]
    inner = [f"_in{k}" for k in range(len(kept))]
    size = words_in(F.col(f"`{text_col}`").cast("string")) if size_col is None else F.col(f"`{size_col}`").cast("long")
    named = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner, strict=True)), F.col(f"`{source_col}`").cast("string").alias("_source"), F.xxhash64(F.col(f"`{id_col}`")).alias("_hash"), size.alias("size"))
    sizes, sizes_at = cut(named.groupBy("_source", "size").agg(F.count("*").alias("rows")), "mix-sizes")
    words = F.col("size") * F.col("rows")
    by_class = F.array(*(F.sum(F.when(class_of(F.col("size"), classes) == k, words).otherwise(0)).alias(f"w{k}") for k in range(classes)))
    stats, stats_at = cut(sizes.groupBy("_source").agg(F.sum(words).alias("tokens"), F.sum("rows").alias("rows"), by_class.alias("words")), "mix-sources")
    n = stats.count()
    patterns, paths = with_targets(stats, weights, cap)
    patterns, patterns_at = cut(patterns, "mix-targets")
    mu = solve_dual(patterns, cap)
    schema = T.StructType([patterns.schema["_source"], T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("rates", T.ArrayType(T.DoubleType())), T.StructField("chunks", T.LongType())])

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, rate = source_rates(np.array(b.column("words").to_pylist(), float), b.column("target").to_numpy(zero_copy_only=False), mu if len(mu) else np.zeros(classes), cap)
                chunks = [-(-r // chunk) for r in b.column("rows").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("_source").cast(pa.string()), b.column("tokens"), b.column("target"), pa.array(rate.tolist(), pa.list_(pa.float64())), pa.array(chunks, pa.int64())], names=schema.names)

    rates, rates_at = cut(patterns.select("_source", "tokens", "target", "words", "rows").mapInArrow(rated, schema), "mix-rates")
    own_rate = F.get("rates", class_of(F.col("size"), classes))
    long_, long_at = cut(_long_sizes(_by_source(sizes, rates, n).withColumn("rate", own_rate), cap), "mix-long")
    drop(spark, stats_at, sizes_at, patterns_at, *paths)
    # of each source: from which size on documents are long, and what the others' rates are raised by for the words that those leave owed
    settled = long_.groupBy("_source").agg(F.sum(F.col("size") * F.col("n")).alias("held"), F.sum(F.col("part") * F.col("size") * F.col("n") - F.col("size") * F.col("more")).alias("owed"), F.min("size").alias("least"))
    table = rates.join(settled.withColumnRenamed("_source", "_long"), F.col("_source").eqNullSafe(F.col("_long")), "left").drop("_long")
    left = F.col("source_size") - F.col("held")
    table, table_at = cut(table.select("_source", "source_size", "target", "rates", "chunks", "least", F.coalesce(F.when(left > 0, F.col("owed") / left), F.lit(0.0)).alias("raise")), "mix-table")
    drop(spark, rates_at)

    is_long = F.coalesce(F.col("size") >= F.col("least"), F.lit(False))
    # chunks below 0 hold the long documents, all of one size together; more is how many of that size take one more
    own = lambda key: -1 - F.pmod(F.xxhash64(key), F.col("chunks"))
    dealt = _by_source(named, table, n).withColumn("rate", own_rate).withColumn("part", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rate") - F.floor("rate") + F.col("raise"))))
    dealt = dealt.withColumn("_chunk", F.when(is_long, own("size")).otherwise(F.pmod("_hash", "chunks"))).withColumn("_more", F.lit(None).cast("long"))
    quotas = long_.select("_source", "size", F.col("chunk").alias("_chunk"), F.col("more").alias("_more"))
    dealt = dealt.drop("chunks", "least", "rates", "raise").unionByName(quotas, allowMissingColumns=True)
    # a chunk's hash of its own, so that chunks of a source spread evenly; a size's quota comes before its documents
    dealt = dealt.repartition("_source", "_chunk").sortWithinPartitions(F.col("_source").asc_nulls_last(), "_chunk", F.desc("size"), F.desc_nulls_last("_more"), "_hash", *(c for c in inner if _sortable(dealt.schema[c].dataType)))

    def deal(slices):
        key, owed, more = object(), 0.0, 0
        for arrays in slices:
            copies = []
            for source, chunk_, n, rate, part, quota in zip(*(a.to_pylist() for a in arrays), strict=True):
                if quota is not None:
                    more = quota
                    copies.append(None)
                    continue
                if (source, chunk_) != key:
                    key, owed = (source, chunk_), 0.0
                k = int(rate)
                if chunk_ < 0:
                    if more > 0:
                        k, more = k + 1, more - 1
                else:
                    owed += part * n
                    if n and owed >= n / 2 and k < cap:
                        k, owed = k + 1, owed - n
                copies.append(k)
            yield copies

    copies = state_udf(deal, T.LongType(), *(F.col(c) for c in ("_source", "_chunk", "size", "rate", "part", "_more")))
    out = dealt.withColumn("copies", copies).where("_more IS NULL")
    return out.select(*(F.col(i).alias(c) for i, c in zip(inner, kept, strict=True)), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _long_sizes(sizes: DataFrame, cap: float) -> DataFrame:
    """The sizes that are rounded with their source: n rows of each, the part of the rate that is rounded, how many rows take one more, and their chunk.

    sizes: _source, size, rows, source_size, rate, chunks.  A task holds one row at a time.
    """
    columns = ["_source", "size", "rows", "source_size", "rate", "chunks"]
    schema = T.StructType([sizes.schema["_source"], *(T.StructField(c, T.DoubleType() if c == "part" else T.LongType()) for c in ("size", "n", "part", "more", "chunks"))])
    share = SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, owed, open_ = object(), 0, 0.0, True
        for b in batches:
            found = []
            for source, n, rows, tokens, rate, chunks in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if source != key:
                    key, left, owed, open_ = source, tokens, 0.0, True
                open_ = open_ and bool(n) and n * chunks * share > left
                if not open_:
                    continue
                part = rate - int(rate)
                owed += part * rows * n
                more = 0 if int(rate) >= cap else min(rows, max(0, int(owed / n + 0.5)))
                owed -= more * n
                left -= rows * n
                found.append((source, n, rows, part, more, chunks))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64() if f.name == "part" else pa.string() if k == 0 else pa.int64()) for k, (f, v) in enumerate(zip(schema, zip(*found, strict=True), strict=True))], names=schema.names)

    ordered = sizes.select(columns).repartition("_source").sortWithinPartitions(F.col("_source").asc_nulls_last(), F.desc("size"))
    return ordered.mapInArrow(run, schema).withColumn("chunk", -1 - F.pmod(F.xxhash64("size"), "chunks")).drop("chunks")


def _sortable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    columns = docs.columns
    inner = [f"_doc{k}" for k in range(len(columns))]
    text, source, id_ = (options.pop(k, v) for k, v in (("text_col", "text"), ("source_col", "source"), ("id_col", "doc_id")))
    own = dict(zip(columns, inner, strict=True))
    mixed = mix(docs.toDF(*inner), text_col=own[text], source_col=own[source], id_col=own[id_], **options)
    times = mixed.where("copies > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return times.select(*(F.col(i).alias(c) for i, c in zip(inner, columns, strict=True)))
