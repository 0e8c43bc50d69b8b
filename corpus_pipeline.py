"""The training-data pipeline: toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and reread as the next stage's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import minhash, packing, pii, toxicity
from sextant.llm.common import prepare, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the labels learnt from are those of the allowed rows."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_table(docs, "text", model, "toxic_score")
    return scored.filter(F.col("toxic_score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that with the smallest id; documents without words all stay. Rows of one
    id that differ are documents of their own, and of equal rows one stays."""
    marked = docs.withColumn("_mark", F.xxhash64(*docs.columns))
    several = marked.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("_mark").alias("lo"), F.max("_mark").alias("hi")).filter("lo != hi")
    key, named = ("doc_id", docs) if several.isEmpty() else ("_number", minhash.number_rows(docs, "doc_id", F.xxhash64(*docs.columns)))
    kept = minhash.near_duplicates(named, key).filter("kept").select(F.col(key).alias("kept_id")).distinct()
    chosen = named.join(kept, F.col(key).eqNullSafe(F.col("kept_id"))).select(*named.columns)
    one = chosen.filter(F.col(key).isNotNull()).dropDuplicates([key]).select(*docs.columns)  # equal rows
    return one.unionByName(chosen.filter(F.col(key).isNull()).select(*docs.columns).distinct())


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind, and n_chars counted anew."""
    masked = pii.mask_table(docs, "text", pii.train(docs))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Trained models, hash functions and a sequential fit: not for SQL. tests/llm/test_pipeline.py checks against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written to the shared checkpoint folder and reread."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
