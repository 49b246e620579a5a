"""Sinks: thread documents, grouped ZIPs, CSV and JSON lines, appended stores."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import file_system


def thread_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """path and content of one JSON file for each thread, null fields kept."""
    return df.select(F.concat(F.lit("thread_"), F.col(columns[0]).cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("content"))


def write_files(files: DataFrame, folder: str) -> None:
    """Each (path, content: text or bytes) as a file in a folder of a shared file system; temporary name first.

    Names are one step below the folder: any that leads elsewhere is an error.  A file of the name and content is left as it is.
    """

    def put(rows: Iterator) -> None:
        fs, top = shared_folder(folder)
        for r in rows:
            name, data = r["path"], r["content"]
            data = data.encode() if isinstance(data, str) else bytes(data)
            if not name or name in (".", "..") or "/" in name or "\\" in name:
                raise ValueError(f"not a file name: {name}")
            there = fs.get_file_info(f"{top}/{name}")
            if there.is_file and there.size == len(data):
                with fs.open_input_stream(f"{top}/{name}") as f:
                    if f.read() == data:
                        continue
            part = f"{top}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as f:
                f.write(data)
            fs.move(part, f"{top}/{name}")

    files.select("path", "content").foreachPartition(put)


def shared_folder(folder: str):
    """The file system and path of a folder (a path, or a URI that pyarrow knows), made if it isn't there."""
    found, path = file_system(folder)
    found.create_dir(path, recursive=True)
    return found, path


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header and a fixed order of columns."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_store(df: DataFrame, path: str, batch: str = "batch") -> None:
    """Rows added to a Parquet store, a folder for each batch."""
    df.write.mode("append").partitionBy(batch).parquet(path)


def upsert_metadata(store: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """The store with a column taken from the updates where they have the key; of several updates the largest value."""
    updates = updates.groupBy(key).agg(F.max(column).alias(column))
    return store.join(updates.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column) if column in store.columns else F.col("_new")).drop("_new")


def replace_batches(df: DataFrame, path: str, batch: str = "batch") -> None:
    """Rows of some batches of a store written anew; other batches stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)


def append_feedback(df: DataFrame, path: str, columns: list[str]) -> None:
    """Rows (thread_id and free columns) added to a feedback log, as thread_id and a JSON entry with the time."""
    entry = F.to_json(F.struct("thread_id", *(c for c in columns if c != "thread_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp")))
    df.select("thread_id", entry.alias("entry")).write.mode("append").parquet(path)
