"""The corpus pipeline: quality, repeated lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes each
result as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lurelake.llm import decontamination, jaccard, lines, packing, queries
from lurelake.llm.common import documents, saved

#: SQL can express neither the classifier nor the SimHashes, the latent space or the packing.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.7 or more), trained on labelled rows of the whole
    ``documents``; those without a score's evidence are judged by it all the same."""
    scored = queries.quality_scored(spark, sf_dir, docs)
    return scored.where("predicted = 1").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; n_chars follows the text.  Documents of which nothing is left go."""
    kept = lines.drop_repeated_lines(docs)
    n_chars = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    if n_chars:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(n_chars)).otherwise(F.col("n_chars")))
    left = (F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return kept.where(left).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the least id.  Rows equal in id and text are
    one.  Rows without an id count as documents of no group and stay."""
    groups = jaccard.jaccard_components(docs).select("doc_id", "component_id").distinct()
    gone = groups.where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found.  Rows without an id stay."""
    found = decontamination.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_copies),
    ("decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
