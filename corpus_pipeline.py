"""A pipeline over documents: quality rules, toxicity, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns the columns of documents; the
last one returns packed pieces. Models are fitted on a bounded sample of the labelled documents of sf_dir.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import common, near_dedup, packing, quality_rules, substring_dedup, toxicity

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules.stage),
    ("toxicity", toxicity.stage),
    ("near_dedup", near_dedup.stage),
    ("substring_dedup", substring_dedup.stage),
    ("best_fit_packing", packing.stage),
]

#: The stages fit models and draw signatures, which SQL cannot express; tests/llm hold each against planted cases and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name, read)
        read = [docs]  # goes when the next stage is written
    return STAGES[-1][1](spark, docs, sf_dir)
