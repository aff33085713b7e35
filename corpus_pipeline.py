"""From raw documents to token ids: five stages, each over all that the one before it kept.

Edge cases of all stages: columns of any name besides those of documents stay as they are; null texts are empty; an
empty table gives no rows. quality: without labels of both kinds every row stays. near_dedup: rows without a word stay;
a row without doc_id goes if a row that has one is its near copy; of rows with one doc_id and text one stays.
repeat_removal: a null doc_id counts as the largest; n_chars follows the text. mixing: rows may repeat or go, as
the mix takes them. encoding: one row of digests for each row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.bpe import VOCABULARY, encode_documents
from tallyweave.llm.common import discard, documents, materialize
from tallyweave.llm.minhash import deduplicated
from tallyweave.llm.mixing import mixed
from tallyweave.llm.quality import good_enough
from tallyweave.llm.suffix_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_enough(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words a shingle, similarity 0.8."""
    return deduplicated(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeat_removal", repeat_removal), ("mixing", mixing), ("encoding", encoding)]

#: Its stages fit a model, compare sets and encode bytes: no SQL for them; tests/llm holds their operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
