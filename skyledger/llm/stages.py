"""Stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame.

Each works on all rows it gets; all but the last return the columns of `docs`. A row is named by its id and content, so rows
that repeat an id with other text are judged apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import decontaminate, linededup, nearcopies, packing, toxicity
from skyledger.llm.common import table, text_key
from skyledger.session import materialize


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of `docs` whose (doc_id, text_key) is not in `dropped`; a null id equals a null id."""
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_key().cast("long").alias("key"))
    gone = dropped.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).hint("merge")  # of any size, so never broadcast
    return packed.join(gone, packed.id.eqNullSafe(gone.gone_id) & (packed.key == gone.gone_key), "left_anti").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5. The fit reads the labels of the input folder and the texts of `docs`."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    names = docs.columns
    if "toxic_score" in names:  # a document column of this name comes back as it was
        packed = docs.select("text", F.struct("*").alias("row"))
        return toxicity.score(packed, model).filter("toxic_score < 0.5").select("row.*")
    return toxicity.score(docs, model).filter("toxic_score < 0.5").select(*names)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; later ones without the line blocks that an earlier one holds."""
    return linededup.without_repeats(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (SimHash fingerprints within 3 bits, or five-word shingles with a Jaccard similarity of 0.8
    or more) the row with the smallest doc_id (then content key), once. Rows without an id are dropped where another row of their class has one."""
    near = materialize(nearcopies.near_copies(docs))
    first = near.filter("doc_id = component_id").groupBy("root").agg(F.min("text_key").alias("first_key"))
    rows = near.groupBy("doc_id", "text_key", "root", "component_id").agg(F.count("*").alias("times"))
    judged = materialize(rows.join(first, "root", "left").withColumn("stays", F.col("component_id").isNull() | F.coalesce((F.col("doc_id") == F.col("component_id")) & (F.col("text_key") == F.col("first_key")), F.lit(False))))
    kept = without(docs, judged.filter("not stays"))
    twice = judged.filter("stays and times > 1").select("doc_id", "text_key")
    if twice.isEmpty():
        return kept
    # rows alike in id and text: only those are brought together
    packed = kept.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_key().cast("long").alias("key"))
    again = packed.join(twice, packed.id.eqNullSafe(twice.doc_id) & (packed.key == twice.text_key), "left_semi").dropDuplicates(["id", "key"]).select("row.*")
    return without(kept, twice).unionByName(again)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item."""
    hits = decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, materialize(hits.filter(F.size("spans") > 0).select("doc_id", "text_key")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that are left, with a checksum of each piece's ids."""
    return packing.packing_digest(docs, most_words=packing.STAGE_WORDS)
