"""External scoring as a table operator: cached rows are reused, the rest goes to clients, several calls at a time."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .client import Client, asked


def fake_client(prompt: str) -> dict:
    """Deterministic levels 1 to 3 from the prompt; for tests and runs without a model."""
    h = zlib.crc32(prompt.encode())
    return {"clarity": h % 3 + 1, "accuracy": h // 3 % 3 + 1, "comment": f"c{h % 7}"}


def coerced(value: object, kind: T.DataType) -> object:
    """A field of an answer as a column's type: integers are cut off, what can't be read is null."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.IntegralType):
            return int(value)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(value)
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else None
        return value if isinstance(value, str) else json.dumps(value)
    except (TypeError, ValueError, OverflowError):
        return None


#: What is known of a call besides the answer: the last error, tries, seconds of the last try.
CALL = [T.StructField("error", T.StringType()), T.StructField("tries", T.IntegerType()), T.StructField("seconds", T.DoubleType())]


def answers(rows: DataFrame, key: str, prompt: str, client: Client | list[Client], schema: T.StructType, *, in_flight: int = 8, tries: int = 3, wait: float = 0.75, timeout: float | None = None) -> DataFrame:
    """key, the fields of the answer (null where a client failed), error, tries and seconds of each row.

    Several clients take turns.  A null prompt is an empty one.
    """
    clients = client if isinstance(client, list) else [client]
    out_schema = T.StructType([rows.schema[key], *schema.fields, *CALL])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in out_schema])

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def prompts() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), (p or "" for p in batch.column(1).to_pylist()), strict=True)

        done = asked(prompts(), clients, in_flight=in_flight, tries=tries, wait=wait, timeout=timeout)
        while some := list(islice(done, 64)):
            values = [[k for k, _ in some]]
            values += [[coerced(a.answer.get(f.name), f.dataType) if a.answer is not None else None for _, a in some] for f in schema]
            values += [[a.error for _, a in some], [a.tries for _, a in some], [a.seconds for _, a in some]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    return rows.select(key, prompt).mapInArrow(call, out_schema)


def scored(rows: DataFrame, key: str, prompt: str, client: Client | list[Client], schema: T.StructType, cache: DataFrame | None = None, **options) -> DataFrame:
    """key and the client's fields; rows that the client fails on after all tries are dropped.

    cache: rows of an earlier run by key; only the others are sent.
    """
    todo = rows if cache is None else rows.join(cache.select(key), key, "left_anti")
    fresh = answers(todo, key, prompt, client, schema, **options).where("error IS NULL").select(key, *schema.names)
    return fresh if cache is None else cache.select(key, *schema.names).unionByName(fresh)


def _there(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, empty where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def stored_scores(rows: DataFrame, key: str, prompt: str, client: Client | list[Client], schema: T.StructType, store: str, *, per_batch: int = 1000, **options) -> DataFrame:
    """As `scored`, with a folder as cache: answers are committed every `per_batch` rows, while the job runs.

    The rows that the store doesn't have an answer for are queued as files of `per_batch` rows; a stream takes
    a file at a time, asks, and commits its answers under the batch's number before the next.  A failure
    pays for one batch again at most, the next call goes on where the last one stopped, and a
    batch done twice replaces itself.  Calls that failed are kept with their error, as a log, and
    asked again by the next call.  One call works on a store at a time.
    """
    spark = rows.sparkSession
    kept = T.StructType([rows.schema[key], *schema.fields, *CALL, T.StructField("batch", T.LongType())])
    answered, queue = f"{store}/answers", f"{store}/queue"
    waiting = T.StructType([rows.schema[key], rows.schema[prompt]])
    good = lambda: _there(spark, answered, kept).where("error IS NULL")

    def ask(batch: DataFrame, number: int) -> None:
        told = good().where(F.col("batch") != number).select(key)
        done = answers(batch.join(told, key, "left_anti"), key, prompt, client, schema, **options)
        done.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(answered)

    def work() -> None:
        stream = spark.readStream.schema(waiting).option("maxFilesPerTrigger", 1).parquet(queue)
        stream.writeStream.foreachBatch(ask).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    if not _there(spark, queue, waiting).isEmpty():  # what an earlier call has left
        work()
    todo = rows.select(key, prompt).dropDuplicates([key]).join(good().select(key), key, "left_anti")
    todo.write.mode("append").option("maxRecordsPerFile", per_batch).parquet(queue)
    if not _there(spark, queue, waiting).isEmpty():
        work()
    return good().select(key, *schema.names).join(rows.select(key).distinct(), key, "left_semi")


def call_log(spark: SparkSession, store: str) -> DataFrame:
    """Every call that a store of scores has paid for: its columns, error, tries, seconds and batch."""
    return spark.read.parquet(f"{store}/answers")


def compared(questions: DataFrame, question: str, clients: dict[str, Callable[[str], str]], *, in_flight: int = 8, timeout: float | None = None) -> DataFrame:
    """question, model, answer (or a tagged error), ok and latency of each client for each question, several calls at a time; one try each."""
    names = list(clients)
    schema = T.StructType([questions.schema[question], T.StructField("model", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("latency", T.DoubleType())])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])
    turns = [lambda q, run=run: {"said": run(q)} for run in clients.values()]

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        puts = (((q, name), q) for batch in batches for q in batch.column(0).to_pylist() for name in names)
        done = asked(puts, turns, in_flight=in_flight, tries=1, timeout=timeout)  # the k-th goes to client k modulo their number
        while some := list(islice(done, 64)):
            values = [[q for (q, _), _ in some], [n for (_, n), _ in some], [f"[error] {a.error}" if a.answer is None else a.answer["said"] for _, a in some], [a.answer is not None for _, a in some], [a.seconds for _, a in some]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    return questions.select(question).mapInArrow(call, schema)


def comparison_export(calls: DataFrame, question: str, stamp: Column | None = None) -> DataFrame:
    """path and content of a JSON file for each question: the time, the question, each model's answer, and successes and mean seconds of each model over all questions."""
    stats = usage(calls, "model", "ok", "latency").select(F.col("model"), F.struct("successes", "errors", "avg_latency").alias("s"))
    all_stats = stats.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "s")))).alias("usage_stats"))  # a row: models are few
    said = calls.groupBy(question).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "answer")))).alias("answers"))
    whole = said.join(F.broadcast(all_stats)).select(question, F.struct((F.current_timestamp() if stamp is None else stamp).cast("string").alias("timestamp"), F.col(question).alias("question"), "answers", "usage_stats").alias("x"))
    return whole.select(F.concat(F.lit("comparison_"), F.substring(F.sha2(F.col(question).cast("string"), 256), 1, 16), F.lit(".json")).alias("path"), F.to_json("x").alias("content"))


def answered(retrieved: DataFrame, query: str, text: str, rank: str, client: Callable[[str], str], how: str = "stuff", question: str = "question") -> DataFrame:
    """query and answer from the retrieved texts of each query: 'stuff' puts all in one prompt, 'refine' goes on from text to text, 'none' asks without.

    The texts of a query are its top k, so a group is small.
    """
    joined = retrieved.groupBy(query, question).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank, text))), lambda s: s[text]).alias("texts"))
    schema = T.StructType([retrieved.schema[query], T.StructField("answer", T.StringType())])

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for q, asked, texts in zip(f[query], f[question], f["texts"], strict=True):
                if how == "refine":
                    answer = ""
                    for t in texts:
                        answer = client(f"Question: {asked}\nSo far: {answer}\nContext: {t}")
                else:
                    answer = client(f"Question: {asked}" + ("" if how == "none" else "\nContext: " + "\n\n".join(texts)))
                out.append([q, answer])
            yield pd.DataFrame(out, columns=schema.names)

    return joined.mapInPandas(call, schema)


def usage(calls: DataFrame, model: str, ok: str, latency: str) -> DataFrame:
    """Successes, errors and mean latency by model."""
    return calls.groupBy(model).agg(F.count_if(F.col(ok)).alias("successes"), F.count_if(~F.col(ok)).alias("errors"), (F.sum(F.when(F.col(ok), F.col(latency)).otherwise(0.0)) / F.greatest(F.count_if(F.col(ok)), F.lit(1))).alias("avg_latency"))
