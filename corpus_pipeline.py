"""From raw documents to token ids: quality, near-dedup, substring dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept; its result is written as Parquet and read again as the next one's
documents.  All stages but the last return the columns of documents, whatever
further ones there are.

Defined cases: null and empty texts get a score like others, are nobody's
copies and have no ids; rows with null doc_id are never named as copies, lose
no words, and stay as far as their scores let them; of repeated rows and of rows with one doc_id one is
left; without any labelled row all scores are 0.5 and nothing passes the
classifier; an empty benchmark removes nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bpe, decontaminate, minhash, quality_gbt, substring_dedup
from sieveline.llm.store import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.7 or more)."""
    return quality_gbt.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has."""
    return substring_dedup.remove_repeats(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and the digests of ids and decoded bytes."""
    import public_tokenizers

    return bpe.encode_table(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"), ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substrings), ("decontamination", decontamination), ("byte_bpe", encoding)]
#: Trees, MinHash, index and tokenizer are beyond SQL; tests hold the operator of each stage against a plain version, and the stages against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
