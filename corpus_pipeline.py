"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing to target weights, BPE encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
as Parquet in the shared folder and reads again as the next stage's docs. All but the last return the columns of
`documents`. SQL can't express the stages (hashing, edit distance, byte-level BPE): tests/llm holds a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicspark.llm.bpe import bpe_stage
from topicspark.llm.common import scratch, table
from topicspark.llm.line_dedup import line_dedup_stage
from topicspark.llm.mixing import mixing_stage
from topicspark.llm.quality_rules import quality_stage
from topicspark.llm.simhash import simhash_stage

STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", simhash_stage),
    ("mixing to target weights", mixing_stage),
    ("bpe encoding", bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the result is the last stage's."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch(spark, docs, "pipeline")
    return docs
