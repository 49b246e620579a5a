"""The package on the executors."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows and bytes of an Arrow batch: texts are long, and a worker and its task hold several batches.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark context, and bound Arrow batches for long texts unless the session says otherwise."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":  # Spark's default
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_brookloom_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(top.parent))), p.read_bytes())
    name = f"brookloom_{hashlib.sha256(out.getvalue()).hexdigest()[:12]}.zip"
    path = os.path.join(tempfile.mkdtemp(prefix="ship"), name)  # read by the driver's file server only
    Path(path).write_bytes(out.getvalue())
    context.addPyFile(path)
    context._brookloom_shipped = True
