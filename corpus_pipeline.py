"""From raw documents to token ids, in five stages; each works on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir). Its result is written as Parquet to the shared folder and read again, so a lost
executor costs one stage's tasks at most. All stages but the last return the columns of ``documents``, whatever further ones there are.

Defined results: a null id is an id like any other, and repeated rows are documents of their own until ``near_duplicates`` leaves one of them; a null or empty
text is graded by the thresholds alone, is a near copy of other empty ones, leaks nothing, takes no words of the mix and is the end id alone in the files; a null
source is a source of its own; without labels nothing is rejected, without a benchmark nothing leaks; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palaver.llm import decontaminate, mixing, nearcopies, quality, tokens
from palaver.llm.shared import save


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is a half or more; toxic and junk documents go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.select(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return nearcopies.representatives(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy, exact or edited, of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mixed(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Range-coded id files; the documents as read back from them."""
    return tokens.read(tokens.write(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_ids", write_ids),
]
#: SQL can express neither the fit nor the coder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
