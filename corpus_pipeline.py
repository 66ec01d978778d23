"""A document table through five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import stages
from skyledger.session import materialize

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line dedup", stages.drop_repeated_lines),
    ("simhash near-dedup", stages.keep_one_of_near_copies),
    ("benchmark decontamination", stages.drop_contaminated),
    ("best-fit packing", stages.pack),
]
#: Fits, hashes and tokenizers have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
