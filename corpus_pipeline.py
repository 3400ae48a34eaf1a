"""The corpus pipeline: documents without toxic ones, near copies and benchmark leaks, mixed to weights, as token files.

Defined results, by stage. Null and empty texts count as texts without words: they are not toxic, leak nothing, and are near
copies of each other, so one of them stays. Rows alike in all columns are near copies of each other. Rows with a null id
are kept by the same rules as others and come after those with ids where the smallest id decides. Null sources are one
source, mixed last. Without labels nothing is toxic; without benchmark items nothing leaks. A source without words has
nothing to give, so its documents don't come into the mix. The mix gives a row as often as it is taken, at most twice, in
the order of its shards, and the token files keep that order. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiasma.llm import decontaminate, mixing, simhash, token_output, toxicity
from chiasma.llm.common import documents, in_file_order, written
from chiasma.session import ship


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject; it is fitted on a bounded sample of the labelled ones."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies (five-word shingles, 0.8)."""
    ship(spark)
    return simhash.keep_one(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks."""
    ship(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, dealt out to shards and shuffled there: a file for each shard, in order."""
    ship(spark)
    return mixing.mix(docs)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold: doc_id, start, n_tokens, ids_crc32 of every row, in the order of the mix's files."""
    ship(spark)
    placed, place = in_file_order(docs)
    return token_output.token_output(placed, order=F.col(place), digest=True)


STAGES = [("toxicity", _toxicity), ("near_dedup", _near_dedup), ("decontaminate", _decontaminate), ("mix", _mix), ("tokens", _tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
