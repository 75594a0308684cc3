"""A corpus pipeline: each stage takes the documents that the one before it kept.

Every stage but the last returns the columns of documents. Language ID drops what its model rejects,
line dedup drops lines found in ten documents or more, the n-gram Jaccard join keeps one document of
each group (five words, similarity 0.8), PII masks what it finds, and packing gives the token ids and
places of all pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlspike.llm import jaccard_join, language_id, line_dedup, packing, pii
from marlspike.scratch import Scratch

STAGES = [
    ("language_id", language_id.language_stage),
    ("line_dedup", line_dedup.line_dedup_stage),
    ("ngram_jaccard_join", jaccard_join.jaccard_stage),
    ("pii", pii.pii_stage),
    ("best_fit_packing", packing.packing_stage),
]

#: Language ID and packing can't be told in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs, name)
    return docs
