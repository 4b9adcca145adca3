"""A training corpus from the documents table: five stages, each written and read again.

Stages take (spark, docs, sf_dir) and work on all that their predecessor kept. All but the last
return the columns of documents; the last returns packed pieces.

Defined results: null and empty texts pass the filters and are packed as their end id alone; a null doc_id is a document
without labels and counts as the smallest among near copies; rows with equal doc_id and text stay once, whichever of them if other columns
differ; other columns pass up to packing, whatever their names. No documents give no rows. Texts of any
length pass whole. Each stage's files go once the next stage is written; those of the last stay, since the result reads them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from talespan.llm import decontaminate, near_duplicates, packing, perplexity, substring_dedup
from talespan.runtime import drop_files, ensure_checkpoint_dir, release, table

#: Pieces that packing's encoder keeps and bytes of texts that it takes at once: less than it may, since it runs in workers that hold other stages' data.
CACHE_PIECES, ENCODED_BYTES = 100_000, 2 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model's per-language thresholds reject go."""
    return perplexity.keep(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies stays."""
    return near_duplicates.one_of_each(docs)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out."""
    return substring_dedup.cut(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter benchmark passages are cut out of the others."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into windows of token ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_pieces=CACHE_PIECES, encoded_bytes=ENCODED_BYTES)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("substring dedup", shared_passages), ("benchmark decontamination", benchmark_passages), ("lexical packing", windows)]

#: The language model, the tokenizer and the packing are beyond SQL; tests compare to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each one's result is written to the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if i:
            drop_files(spark, f"{folder}/{i - 1}")
        release(spark)  # shuffle files of this stage
    return docs
