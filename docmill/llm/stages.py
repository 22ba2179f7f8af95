"""The operators as stages over the documents table: every stage but the last returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import jaccard, linededup, mixing, packing, queries, toxicity
from docmill.llm.common import Work


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score >= 0.7) go. It learns from the labelled rows of the stored tables."""
    scored = toxicity.score(docs, queries.toxic_model(spark, sf_dir), keep=True)
    return scored.where(F.col("predicted") == 0).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go, documents stay; n_chars follows the text."""
    out = linededup.drop_boilerplate(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document of the smallest id stays.

    Rows without an id stay. Rows of one id count as one document if their texts are equal too.
    """
    found = jaccard.jaccard_components(docs, k=5, pct=80)
    go = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_go")).distinct()
    kept = docs.join(go, docs["doc_id"] == go["_go"], "left_anti")
    n = docs.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if n["n"] > n["d"]:
        kept = kept.where("doc_id is null").union(kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))
    return kept.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the budgets of their sources say, each at least once."""
    return mixing.mix(docs, max_repeats=queries.MAX_REPEATS, extras=False)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row in windows of 2048 ids."""
    path, pattern = queries.tokenizer_path()
    work = Work(spark, "packing")
    pieces = work.keep(packing.tokenize_pieces(docs, path, pattern))
    return packing.pack(pieces).drop("row")
