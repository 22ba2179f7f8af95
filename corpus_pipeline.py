"""A training corpus from documents: toxic texts out, boilerplate lines out, near duplicates out, sources mixed, windows packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmill.llm import stages
from docmill.llm.common import Work, table

#: (name, function) in order; a function takes (spark, docs, sf_dir) and returns the next one's docs.
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_boilerplate),
    ("jaccard_join", stages.drop_near_duplicates),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack_windows),
]

#: The classifier, the exact join and the tokenizer are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the stored documents; what a stage returns is written and read again."""
    docs, work = table(spark, sf_dir, "documents"), Work(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        mark = Work.mark()
        kept = work.keep(stage(spark, docs, sf_dir), name)
        Work.close_since(mark)  # what the stage wrote for itself
        work.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
