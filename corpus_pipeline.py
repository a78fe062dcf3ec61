"""Five stages from raw documents to packed training windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoforge.llm import exact_dedup, jaccard_join, mixing, packing, quality
from genoforge.llm.common import small_batches, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; without labels, all."""
    small_batches(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id, or those without any where none has one.

    Rows that repeat both doc_id and text are one document. Other rows of a doc_id are judged by their own texts.
    """
    gone = exact_dedup.exact_duplicates(docs).where("not kept").select("doc_id", "text_sha256").distinct().alias("g")
    rows = docs.select(F.struct("*").alias("row"), exact_dedup.digest("text").alias("digest")).alias("d")
    same = (F.col("d.digest") == F.col("g.text_sha256")) & F.col("d.row.doc_id").eqNullSafe(F.col("g.doc_id"))
    return rows.join(gone, same, "left_anti").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one with the smallest doc_id.

    Rows that share a doc_id are one document, with the links of each; rows without a doc_id stay.
    """
    gone = jaccard_join.similar_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times."""
    copies = mixing.mixed(docs).groupBy("doc_id").agg(F.max("copies").alias("copies")).alias("c")
    rows = docs.select(F.struct("*").alias("row")).alias("d").join(copies, F.col("d.row.doc_id").eqNullSafe(F.col("c.doc_id")))
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("c.copies")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    small_batches(spark)
    return packing.packed(docs, packing.vocabulary())


STAGES = [("quality classifier", keep_quality), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("mixing sources to target weights", mix), ("packing", pack)]

#: A classifier and a tokenizer are no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
