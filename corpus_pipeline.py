"""From raw documents to token ids in five stages, each over all that the one before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents: quality rules
reject rows, near-dedup keeps one of each group, suffix-array dedup takes repeated strings out of
the texts (400 bytes or more, and 50 words or more, however short they are; n_chars follows),
decontamination rejects rows. The last one gives ids.

Tables without rows pass through all stages. Null texts have no words and end at the first stage.
Rows that are the same document (id and text) leave near-dedup once. Other columns are carried
through, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import mnemolith
from mnemolith.llm import bpe_codec, decontaminate, near_dedup, quality_rules, suffix_dedup
from mnemolith.llm.common import Stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_package(stage: Stage) -> Stage:
    """The stage, after the package was sent to the Python workers."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        mnemolith.ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


def _row(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")


@_with_package
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"), whole_rows=True).where("kept").select("row.*")


@_with_package
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


@_with_package
def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs, size_col="n_chars", units=(suffix_dedup.BYTES, suffix_dedup.WORDS))


@_with_package
def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_row(docs), table(spark, sf_dir, "benchmark"), id_col="row").where(~decontaminate.contaminated()).select("row.*")


@_with_package
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = bpe_codec.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", keep_one_of_each_group),
    ("suffix_array_dedup", remove_repeated_strings),
    ("decontamination", keep_uncontaminated),
    ("byte_bpe", encode),
]

#: SQL can express neither the hashed ratio nor the repeated strings; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Stored(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before = docs
        docs = store.write(stage(spark, docs, sf_dir))
        if i:
            store.drop(before)
    return docs
