"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, segmentation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next stage's docs; all but the last return the columns
of ``documents``. No stage is capped, and each works on all that the one before
kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mergeloom.llm import decontam, kneser_ney, line_runs, near_copies, pieces
from mergeloom.llm.common import load, materialize
from mergeloom.llm.piece_cache import public_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kneser_ney.keep_good(docs, load(spark, sf_dir, "labels")).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_runs.dedup_lines(docs).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one_per_group(docs).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, load(spark, sf_dir, "benchmark")).select(docs.columns)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.segment(docs, public_tokenizer("piece_bpe_32k.model"), digest=True, chunk=400_000)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("segment", segment)]

#: The language model, the latent space and the sampler are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
