"""Drift between sets of embeddings as files: pairs and a matrix as CSV, written when they aren't there in full."""

from __future__ import annotations

import csv
import io
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import file_system
from .nearest import label_nearest

#: The columns of the table of pairs.
PAIRS = ["A", "B", "mean_cosine", "relative_drift_pct"]


def pair_drift(rows: DataFrame, id_col: str, label: str, embedding: str, **options) -> DataFrame:
    """PAIRS: the mean cosine of each vector of a label to its nearest of another, and how far that falls below its own label's, in percent."""
    means = label_nearest(rows, id_col, label, embedding, **options).groupBy("a", "b").agg(F.avg("sim").alias("v"))
    # by a window over the pairs: a join with them would search twice
    own = means.withColumn("s", F.max(F.when(F.col("a") == F.col("b"), F.col("v"))).over(Window.partitionBy("a"))).where("s IS NOT NULL")
    drift = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.try_divide(F.col("s") - F.col("v"), F.col("s")) * 100)
    return own.select(F.col("a").alias("A"), F.col("b").alias("B"), F.col("v").alias("mean_cosine"), drift.alias("relative_drift_pct"))


def missing_pairs(spark: SparkSession, path: str, labels: list) -> list[tuple[str, str]]:
    """The pairs of labels, in either order, that a table of pairs doesn't have: all, where it isn't there or has other columns."""
    want = {tuple(sorted((str(a), str(b)))) for a in labels for b in labels}
    system, at = file_system(path)
    if not system.get_file_info(at).is_file:
        return sorted(want)
    found = spark.read.option("header", True).csv(path)
    if found.columns != PAIRS:
        return sorted(want)
    have = {tuple(sorted((r["A"], r["B"]))) for r in found.select("A", "B").where("A IS NOT NULL AND B IS NOT NULL").collect()}  # a row for each pair
    return sorted(want - have)


def write_drift(rows: DataFrame, id_col: str, label: str, embedding: str, folder: str, **options) -> bool:
    """Write embedding_shift_pairs.csv and embedding_shift_matrix.csv; False if all pairs are there already.

    A table is written under another name and moved, so a broken run leaves the old one.  Its size is that of
    the pairs of labels.
    """
    spark = rows.sparkSession
    system, top = file_system(folder)
    system.create_dir(top, recursive=True)
    labels = sorted(r[0] for r in rows.where(F.col(label).isNotNull()).select(label).distinct().collect())
    pairs = f"{folder}/embedding_shift_pairs.csv"
    if not missing_pairs(spark, pairs, labels):
        return False
    found = sorted(tuple(r) for r in pair_drift(rows, id_col, label, embedding, **options).collect())
    cell = {k: v for a, b, v, _ in found for k in ((a, b), (b, a))}
    tables = {"embedding_shift_pairs.csv": [PAIRS, *found], "embedding_shift_matrix.csv": [["", *labels], *([a, *(cell.get((a, b)) for b in labels)] for a in labels)]}
    for name, lines in tables.items():
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(lines)
        part = f"{top}/.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(out.getvalue().encode())
        system.move(part, f"{top}/{name}")
    return True
