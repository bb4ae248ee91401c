"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import chat, decontamination, jaccard, langid, ngrams, packing, pii, quality, runs, substrings, topk, toxicity, whitening
from tidegraph.llm.oracle import ORACLE

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Place of the public vocabulary file; a parameter of the packing operator."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def fold(parts: int) -> Column:
    """crc32 of the document's id as text, modulo the number of parts."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"), jaccard.Rule(words=4, over=85, under=100))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold(4) != 2).select("text", "lang"))
    rows = docs.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "text")
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer, held = toxicity.fitted(docs, docs.where(fold(5) != 0), _table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "text")
    return toxicity.score(rows, scorer, held).drop("text")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(_table(spark, sf_dir, "documents"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.search(vectors, vectors.where("id % 100 = 0"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


#: Tools whose calls op8 validates.
TOOLS = {
    "search": {"required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}},
    "calculator": {"required": ["expression"], "properties": {"expression": {"type": "string"}}, "additional": False},
}


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_messages(_table(spark, sf_dir, "conversations"), TOOLS)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs)).drop("text")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.with_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return runs.digest(runs.find(docs))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ngrams.score(_table(spark, sf_dir, "documents"), fold(7) != 2)
    return scores.select("doc_id", F.coalesce(fold(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_ngram_jaccard_join": op1_ngram_jaccard_join, "op2_decontamination": op2_decontamination, "op3_language_id": op3_language_id, "op4_toxicity": op4_toxicity, "op5_substring_dedup": op5_substring_dedup, "op6_topk_search": op6_topk_search, "op7_packing": op7_packing, "op8_chat_format": op8_chat_format, "op9_quality": op9_quality, "op10_pii": op10_pii, "op11_periodic_runs": op11_periodic_runs, "op12_embedding_whitening": op12_embedding_whitening, "op13_lm_scoring": op13_lm_scoring}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
