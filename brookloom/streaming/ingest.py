"""Incremental ingest: new texts by content hash, in batches and as a stream of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.chunks import chunk_id
from ..operators.embedding import embedded
from ..sources.shipping import ship


def new_documents(incoming: DataFrame, store: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text's SHA-256 the store doesn't hold; repeats inside one batch stay."""
    hashed = incoming.withColumn("doc_hash", F.sha2(F.col(text), 256))
    return hashed.join(store.select("doc_hash").distinct(), "doc_hash", "left_anti")


def new_files(files: DataFrame, store: DataFrame) -> DataFrame:
    """Files whose hash or whose source the store doesn't know."""
    known_hash = store.select("doc_hash").distinct().withColumn("_h", F.lit(True))
    known_source = store.select("source").distinct().withColumn("_s", F.lit(True))
    return files.join(known_hash, "doc_hash", "left").join(known_source, "source", "left").where("_h IS NULL OR _s IS NULL").drop("_h", "_s")


def unseen(rows: DataFrame, once: bool = False) -> DataFrame:
    """Rows of a stream whose doc_hash no earlier batch had.

    What is known is keyed state, so the store isn't read.  Rows of one hash that come in one batch all stay,
    unless `once`.
    """
    schema = rows.schema

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.exists
        for f in frames:
            if not known and len(f):
                yield f.head(1) if once else f
                known = once
        state.update((True,))

    return rows.groupBy("doc_hash").applyInPandasWithState(judge, schema, "known boolean", "append", GroupStateTimeout.NoTimeout)


def index_stream(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, *, key: str = "doc_id", text: str = "text", split: Callable[[Column], Column] | None = None, load: Callable | None = None, name: str = "", once: bool = False, files: int | None = None, start: int = 0) -> StreamingQuery:
    """Adds the chunks of arriving Parquet files' texts to a store, each content once; processes what is there and ends.

    split: a column of chunks from a column of texts (whole texts, if None); load and name: an embedder, if
    there are to be vectors; files: of a batch at most.  The store has a folder for each batch, numbered on
    from `start` in the order of the stream, across restarts; what texts are known is kept in the stream's state, and a batch done again replaces itself.
    """
    ship(spark)
    stream = spark.readStream.schema(schema)
    stream = (stream if files is None else stream.option("maxFilesPerTrigger", files)).parquet(source)
    fresh = unseen(stream.where(F.col(text).isNotNull()).withColumn("doc_hash", F.sha2(text, 256)), once)
    kept = [c for c in fresh.columns if c != text]
    pieces = F.array(F.col(text)) if split is None else split(F.col(text))

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select(*kept, F.posexplode(pieces).alias("chunk_idx", "chunk"))
        rows = rows.withColumn("id", chunk_id(F.col(key), F.col("chunk_idx")))
        if load is not None:
            rows = embedded(rows, "chunk", load, name)
        rows.withColumn("batch", F.lit(start + number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)

    return fresh.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Appends texts of arriving Parquet files to the store, those of a content that earlier batches had left out; repeats inside a batch stay, unless `once`."""
    stream = spark.readStream.schema(schema).parquet(source)
    fresh = unseen(stream.withColumn("doc_hash", F.sha2("text", 256)), once)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("epoch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(store)

    return fresh.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def numbered_batches(df: DataFrame, order: str, size: int, work: str, start: int = 0) -> DataFrame:
    """batch number of each row, in an order, `size` rows to a batch, on from `start`.

    Rows are numbered by partition offsets, so no task sees all of them.  The ranged rows are written once,
    to the folder `work` of a shared file system, so that numbers and offsets are of one execution.
    """
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    ranged.write.mode("overwrite").parquet(work)
    ranged = df.sparkSession.read.parquet(work)
    sizes = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}  # a row for each partition
    offsets, at = [], 0
    for p in sorted(sizes):
        offsets.append((p, at))
        at += sizes[p]
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_p int, _o long")
    place = F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(table), "_p").withColumn("batch", (F.floor(place / size) + start).cast("int")).drop("_p", "_m", "_o")
