"""The corpus pipeline: STAGES in order, each stage's rows written as Parquet and read again as the next one's documents.

Documents that the quality classifier rejects go; of each group of near-duplicates the smallest id stays; passages that
a smaller id holds are cut; benchmark passages are cut, and documents that are mostly benchmark go; what is left is
tokenised and packed. All but the last stage return the columns of documents, n_chars as it was read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, near_dedup, packing, quality, suffix_dedup
from corvane.llm.work import Workspace, read


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, shingle=5, percent=80, perms=48, rows=4)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_passages(docs, span=PASSAGE_BYTES)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), n=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_pieces(docs, packing.TOKENIZER, limit=2048, kept=MEMO)


#: A repeat of so many bytes is a passage. Longer than a license line or a heading, shorter than fifty words.
PASSAGE_BYTES = 150

#: Entries of a worker's memos of tokens: few, since workers also serve the other stages.
MEMO = 150_000

STAGES = [
    ("quality_classifier", keep_good),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", cut_benchmark_passages),
    ("best_fit_packing", pack),
]

#: Stages hold a trained classifier and a packing, which SQL can't express; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work, before = read(spark, sf_dir, "documents"), Workspace(spark, "pipeline"), None
    for name, stage in STAGES:
        with Workspace.temporary():
            docs = work.save(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return docs
