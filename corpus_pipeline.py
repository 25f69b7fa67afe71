"""A training corpus from raw documents, in five stages.

1. quality: documents that the co-trained classifier rejects go.
2. near duplicates: one document of each class stays (five-word shingles, 0.8).
3. decontamination: documents of which benchmark windows cover a twentieth go.
4. secrets: found secrets are replaced by a mark; the document stays.
5. encoding: whole texts become token ids and are decoded again.

Each stage reads what its predecessor wrote.  A document's decisions depend on the
documents that are left, so stages 1 and 2 fit and link on their own input.
Null and empty texts, repeated rows and empty tables are treated as each
operator's module says; more columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelquill.llm import bpe, decontaminate, near_duplicates, quality_classifier, secrets
from pixelquill.llm._spark import COMPRESSION, drop_path, new_path, small_batches, table

VOCABULARY = "word_bpe_49k.json"


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.drop_rejected(docs, table(spark, sf_dir, "labels"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates.drop_near_duplicates(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secrets.redact(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality classifier", _quality), ("near duplicates", _near_duplicates), ("benchmark decontamination", _decontaminate), ("secret scans", _secrets), ("encoding", _encode)]

#: The classifier, the network and the merges have no SQL form; tests/llm/test_pipeline_edges.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.option("compression", COMPRESSION).parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)  # its successor is written
        before = path
    return docs
