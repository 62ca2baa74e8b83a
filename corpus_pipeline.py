"""Training-data pipeline over `documents`: quality, exact dedup, near dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; its result is written
as Parquet in the shared folder and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomline.llm import bpe, exact_dedup, mixing, quality, simhash
from loomline.llm.common import drop_table, release, stage_table, table
from loomline.llm.queries import TICKETS


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    release(spark)  # the stage before is written
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the least doc_id stays."""
    release(spark)
    return simhash.drop_near_copies(docs, written=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    release(spark)
    return mixing.in_mixed_order(docs, TICKETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, mix_place (from 0, in the order of the mix) and the digests of token ids and decoded text."""
    release(spark)
    placed = mixing.with_written_order(docs.select("doc_id", "text"), "mix_place")
    return bpe.digests(placed, public_tokenizers.path("word_bpe_49k.json"), ["mix_place"])


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A trained classifier and fingerprints are not SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        after = stage_table(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if k:
            drop_table(docs)
        docs = after
    return docs
