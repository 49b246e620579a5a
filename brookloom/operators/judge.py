"""A judge over text files: a prompt for each, a verdict for each as a JSON file of its name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import verdict_json
from ..sources.archives import read_texts
from ..sources.sinks import write_files
from .scoring import answers

#: What is scored.
SCORES = ["Clarity", "Specificity", "Constructiveness", "Tone", "Cognitive Demand"]
VERDICT = "scores struct<" + ", ".join(f"`{s}`: int" for s in SCORES) + ">, justification string"


def prompt_for(text: Column, system: str) -> Column:
    """The system's text, the document, and the form of the answer."""
    form = '{"scores": {' + ", ".join(f'"{s}": int' for s in SCORES) + '}, "justification": str}'
    return F.concat(F.lit(f"{system}\n\nDocument:\n"), text, F.lit(f"\n\nPlease provide a JSON response of the form:\n{form}\n"))


def verdicts(files: DataFrame, key: str, text: str, say: Callable[[str], str], system: str, **options) -> DataFrame:
    """key and verdict: the JSON in the answer, else an object with the error, and the answer where there is one without JSON."""
    schema = T.StructType([T.StructField("said", T.StringType())])
    asked = files.select(key, prompt_for(F.coalesce(F.col(text), F.lit("")), system).alias("_prompt"))
    told = answers(asked, key, "_prompt", lambda p: {"said": say(p)}, schema, **options)
    found = verdict_json(F.coalesce("said", F.lit("")), VERDICT)
    failed = F.struct(F.when(F.col("error").isNotNull(), F.col("error")).otherwise(found["error"]).alias("error"), found["raw"].alias("raw"))
    return told.select(key, F.when(F.col("error").isNull() & found["answer"].isNotNull(), F.to_json(found["answer"])).otherwise(F.to_json(failed)).alias("verdict"))


def judge_folder(spark: SparkSession, folder: str, out: str, say: Callable[[str], str], system: str, **options) -> None:
    """A verdict file for each .txt file below a folder; of files of one name in several folders, that of the first path."""
    files = read_texts(spark, folder)
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    first = files.groupBy(name.alias("name")).agg(F.min_by("text", "path").alias("text"))
    told = verdicts(first, "name", "text", say, system, **options)
    write_files(told.select(F.concat("name", F.lit(".json")).alias("path"), F.col("verdict").alias("content")), out)
