"""The corpus pipeline: each stage works on all that the one before it kept.

Defined cases, for each stage: an empty table gives no rows (with the columns of
documents, or in the last stage of the mix); a null or blank text has no words, so
quality_rules drops it, and the later stages, given one, keep it (near_dedup one of all
of them) and the mix takes nothing of it; a null id is an id like any other to the first four
stages and comes last in its source in the mix; null languages and sources are
languages and sources of their own; repeated rows are judged alike and near_dedup keeps
one; of equal near-copies the smallest id stays; further columns pass through the first
four stages, whatever their names, and are not in the mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import mixing, perplexity, pii, simhash, tiling
from millrace.llm.common import delete, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a plain rule or their language's perplexity band rejects."""
    return perplexity.accept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-copies (five-word shingles, similarity 0.8)."""
    return simhash.keep_first(docs, shingle=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and what discloses it; n_chars follows the new text."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row for each slot of each shard, with the ids of its documents."""
    return mixing.mixed_blocks(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", remove_pii),
    ("mix", mix_sources),
]

#: Hashing, model fitting and tiling have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before is not None:
            delete(spark, before)  # nothing reads it any more
        before = f"{base}/{name}"
    return docs
