"""From raw documents to a mixed training set, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heddlework.llm.common import cut, table
from heddlework.llm.decontamination import clean_stage
from heddlework.llm.jaccard import dedup_stage
from heddlework.llm.mixing import mix_stage
from heddlework.llm.pii import mask_stage
from heddlework.llm.quality import quality_stage

#: Each function takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", dedup_stage),
    ("benchmark decontamination", clean_stage),
    ("personal data", mask_stage),
    ("mixing", mix_stage),
]

#: MinHash, the trained span classifier and the seeded order have no SQL form; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
    return docs
