"""A training corpus from the documents table: five stages, each one operator of brookloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs.  All but the last return the columns of documents.

Defined cases, for every stage: null and empty texts are kept (no stage finds anything in them); texts of any
length are read whole; rows that repeat an id and a text are one document to near-dedup and one by one to the
others; ties go by id; empty tables give empty tables; extra columns of documents, of whatever name, pass
through all but the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brookloom.llm import decontaminate, entropy_mix, near_dedup, token_files, toxicity
from brookloom.llm.common import cut, drop
from brookloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't find toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stand in benchmark windows."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return entropy_mix.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back as a digest of each document.

    They stay in the folder that the setting `spark.brookloom.tokens` names; without it they go when they have been read back.
    """
    # workers that have served four stages remember less
    return token_files.token_digest(docs, tokenizer_path("word_bpe_49k.json"), folder=spark.conf.get("spark.brookloom.tokens", None), cache=100_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: Classifiers and signatures have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's table is dropped when the next one stands."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, path = cut(docs, f"pipeline-{name}")
        if before:
            drop(spark, before)
        before = path
    return docs
