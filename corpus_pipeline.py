"""The corpus pipeline: five operators of ``lapframe.llm`` over ``documents``, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. It is written as
Parquet in the shared folder and read again as the next stage's ``docs``, so a
lost executor repeats one stage at most. All stages but the last return the
columns of ``documents``; the last returns doc_id, n_tokens, ids_sha256 and
decoded_sha256 for every row that the mix takes (a document that it takes twice
is two rows).

Defined cases: those of the operators. A row with a null doc_id is a document like
any other; where one of several is kept by doc_id it ranks last. Different texts under
one doc_id are different documents. Extra columns are carried along, whatever their
names; empty ``documents`` give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lapframe.llm.byte_bpe import digests, encode_decode
from lapframe.llm.common import table
from lapframe.llm.exact_dedup import drop_exact_copies
from lapframe.llm.jaccard_join import one_per_class
from lapframe.llm.mixing import apply_mix
from lapframe.llm.quality_rules import keep_good
from lapframe.session import materialize, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked texts stays."""
    return one_per_class(docs, words=5, threshold=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return apply_mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of the bytes that they decode to."""
    return digests(encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", near_dedup),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]

#: The n-gram Jaccard join and the tokeniser have no SQL form; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):  # what the stage itself has written goes once its result is there
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return docs
