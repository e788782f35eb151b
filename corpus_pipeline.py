"""A training-data pipeline of five stages: quality, exact copies, near copies, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.

Defined results: quality drops documents without text, and judges rows that share a doc_id, or have none, each by its own text; of equal texts the row with the
smallest doc_id stays, a null one last; of near copies the smallest doc_id stays, rows without doc_id all stay, and rows that share one stay or go together; the mixture returns
a row as often as it is taken, and a null source is a source of its own; rows that repeat are separate until exact copies go; very long texts are read whole; an
empty table gives empty results; other columns, whatever their names, come along to the last stage but one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clipquarry.llm import bpe, exact_dedup, kneser_ney, mixing, near_dedup
from clipquarry.llm.common import passing, table, work_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It is trained on the trusted ones among docs."""
    return kneser_ney.accepted(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.survivors(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.survivors(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.copies(mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and the text's ids, with the digests of ids and decoded bytes."""
    both = bpe.encode_decode(docs.select("doc_id", "source", "lang", "text")).drop("text")
    return bpe.digests(both, "source", "lang", "token_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: The stages' classifier, tokens and near copies are beyond SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    folder = passing(spark, f"{work_dir(spark)}/pipeline/{uuid.uuid4().hex}")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
