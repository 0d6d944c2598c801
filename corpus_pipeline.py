"""From raw documents to token ids: toxic documents go, one of each near-duplicate group stays, benchmark passages go, personal data is replaced, texts are encoded.

Each stage gets what its predecessor kept, as Parquet in the shared folder. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketweave.llm import bpe, common, copies, decontaminate, pii, simhash, toxicity
from marketweave.llm.queries import SURROGATE_KEY


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labelled ones among docs, scores 0.5 or more."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group that a Jaccard similarity of 0.8 or more (runs of five words) connects.

    Candidates are the links of SimHash fingerprints (operator 10), and near copies that their radius misses; each is checked exactly.
    """
    return simhash.dedup(docs, copies.groups)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item (or a whole shorter item)."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces entities by surrogates; n_chars stays the length of the document as it came."""
    return pii.replace(docs, SURROGATE_KEY).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("personal_data", personal_data), ("bpe", encode)]
#: A classifier and fingerprints by XXH64 are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.store(docs, name)
    return docs
