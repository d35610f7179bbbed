"""The corpus pipeline: stages over documents, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgweave.llm.common import stash, table
from kgweave.llm.mixing import stage_mix
from kgweave.llm.neardup import stage_near_dedup
from kgweave.llm.packing import stage_pack
from kgweave.llm.private import stage_pii
from kgweave.llm.toxicity import stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("near_dedup", stage_near_dedup),
    ("pii", stage_pii),
    ("mix", stage_mix),
    ("pack", stage_pack),
]

#: The trained stages and the packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
