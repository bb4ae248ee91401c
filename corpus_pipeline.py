"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's documents.  All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import decontamination, jaccard, packing, pii, toxicity
from tidegraph.llm.lineage import shared_folder
from tidegraph.llm.queries import vocabulary

#: SQL cannot express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None
#: Near duplicates: shingles of five words, similarity 0.8.
NEAR = {"words": 5, "over": 80, "under": 100}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer rejects go."""
    part = docs.select("doc_id", "text")
    scorer, held = toxicity.fitted(part, part, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, scorer, held)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each group that links connect."""
    return jaccard.representatives(docs, jaccard.Rule(**NEAR))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    out = pii.mask(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("pii", mask_private), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
