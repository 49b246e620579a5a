"""The filter run over archives of threads: what passes goes to a main archive, to one for each rubric rule, and to tables.

An archive holds, for each thread, a JSON document and a text of the same name.  Members are read in parts,
documents parsed, rules evaluated once, and the members that stay written as archives in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sanitize
from ..sources.archives import read_archives
from ..sources.sinks import write_csv
from ..sources.zips import write_archives
from . import conversation as conv
from . import filters

HEAD = ["thread_id", "puzzle_text", "student_name", "school_name", "mentor_name", "age"]
TEXTS = ["short_answer", "long_answer", "response"]


def with_texts(members: DataFrame) -> DataFrame:
    """JSON members (archive, member, content) with the bytes of the text of their name; null where there is none.

    The name is the JSON member's with every '.json' made '.txt'.
    """
    texts = members.where(F.col("member").endswith(".txt")).select("archive", F.col("member").alias("text_member"), F.col("content").alias("text"))
    json = members.where(F.col("member").endswith(".json")).withColumn("text_member", F.replace("member", F.lit(".json"), F.lit(".txt")))
    return json.join(texts, ["archive", "text_member"], "left")


def parsed(members: DataFrame, schema: str) -> DataFrame:
    """Members with their document's fields; broken documents are left out."""
    text = F.decode("content", "UTF-8")
    return members.where(F.try_parse_json(text).isNotNull()).withColumn("thread", F.from_json(text, schema)).select("*", "thread.*").drop("thread")


def decided(threads: DataFrame, config: dict[str, dict], shape: dict) -> DataFrame:
    """threads with main (whether all rules hold) and rubrics (the rubric rules that hold with all that aren't of a rubric)."""
    each = filters.per_rubric(config, **shape)
    held = F.array_compact(F.array(*(F.when(p, F.lit(r)) for r, p in each.items()))) if each else F.array().cast("array<string>")
    return threads.withColumns({"main": filters.compiled(config, **shape), "rubrics": held})


def messages(threads: DataFrame, scores: list[str], carry: list[str]) -> DataFrame:
    """A row for each message: cleaned texts, scores, and how they differ from the message before."""
    head = [sanitize(F.col(c)).alias(c) if c == "puzzle_text" else F.col(c) for c in HEAD]
    rows = threads.select(*carry, *head, F.posexplode("conversation").alias("idx", "m"))
    clean = [F.coalesce(sanitize(F.col(f"m.{t}")), F.lit("")).alias(t) for t in TEXTS]
    rows = rows.select(*carry, *HEAD, "idx", *(F.col(f"m.{c}").alias(c) for c in ("submission_id", "submission_date", "response_date")), *clean, *(F.col(f"m.rubrics.{s}").alias(s) for s in scores))
    return conv.diffs(rows, "thread_id", "idx", TEXTS, scores)


def _table(scores: list[str]) -> list[str]:
    return [*HEAD, "idx", "submission_id", "submission_date", *TEXTS, "response_date", *(f"{t}_diff" for t in TEXTS), *scores, *(f"{s}_diff" for s in scores)]


def filter_archives(spark: SparkSession, path: str, config: dict[str, dict], schema: str, folder: str, *, scores: list[str], main: str = "filtered.zip", overwrite: bool = False) -> dict[str, int]:
    """Filter the archives at a path into a folder; the number of members of each archive written.

    main holds the JSON documents that pass, byte for byte, and their texts, cleaned; <rubric>_<main> the
    texts that pass the rubric's rule and all rules without a rubric.  Tables of messages, in long form, go beside
    them: of all threads, of those in main, and of each rubric.  Documents that are broken are left out.
    """
    shape = {"top": HEAD, "inner": TEXTS, "rubric": scores}
    threads = decided(parsed(with_texts(read_archives(spark, path)), schema), config, shape)
    rubrics = [f for f, r in config.items() if r.get("is_rubric")]
    threads = threads.withColumn("cleaned", F.encode(F.coalesce(sanitize(F.decode("text", "UTF-8")), F.lit("")), "UTF-8"))
    entry = lambda archive, name, content: F.struct(archive.alias("archive"), F.col(name).alias("path"), content.alias("content"))
    has = F.col("text").isNotNull()
    kept: list[Column] = [F.when(F.col("main"), entry(F.lit(main), "member", F.col("content"))), F.when(F.col("main") & has, entry(F.lit(main), "text_member", F.col("cleaned")))]
    own = F.when(has, F.transform("rubrics", lambda r: F.struct(F.concat(r, F.lit(f"_{main}")).alias("archive"), F.col("text_member").alias("path"), F.col("cleaned").alias("content"))))
    files = threads.select(F.explode(F.concat(F.array_compact(F.array(*kept)), F.coalesce(own, F.array().cast("array<struct<archive:string,path:string,content:binary>>")))).alias("f")).select("f.*")
    made = {r["archive"]: r["members"] for r in write_archives(files, folder, overwrite=overwrite).collect()}
    rows = messages(threads.withColumn("rubrics", F.when(has, F.col("rubrics"))), scores, ["main", "rubrics"])
    columns = _table(scores)
    write_csv(rows, f"{folder}/conversations", columns)
    write_csv(rows.where("main"), f"{folder}/main", columns)
    for r in rubrics:
        write_csv(rows.where(F.array_contains("rubrics", r)), f"{folder}/{r}_conversations", columns)
    return made
