"""Exact dedup with a heavy-hitter split.

A Misra-Gries pass over the digests (mergeable summaries, one per partition) finds every digest that
may hold more than 1/counters of the rows. A second pass counts these candidates exactly; the verified
winners, at most ``counters`` rows, are broadcast and their rows are decided where they are read. Only
the other digests are shuffled, and none of their groups is larger than 1/counters of the rows.

Defined results: a null text equals the empty text; a null doc_id ranks after all others; rows that
repeat both doc_id and text are one document (annotate() gives each the same verdict, survivors() returns
it once); an empty table gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, whole, without, written

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: str) -> Column:
    """The text with each run of white space as one space. Single spaces, nearly all there is, are left alone."""
    return F.regexp_replace(whole(text), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def digest(text: str) -> Column:
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def misra_gries(counters: int):
    """A mapInArrow function: digests in, at most ``counters`` (digest, lower bound of its count) out.

    A batch is added to the summary at once; when more counters than allowed are above zero, all drop
    by the size of the first one too many, which keeps the Misra-Gries error of rows / (counters + 1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for x in batch.column(0).value_counts():
                k = x["values"].as_py()
                held[k] = held.get(k, 0) + x["counts"].as_py()
            if len(held) > counters:
                cut = int(np.partition(np.fromiter(held.values(), np.int64, len(held)), -counters - 1)[-counters - 1])
                held = {k: v - cut for k, v in held.items() if v > cut}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["d", "n"])

    return run


def heavy(keys: DataFrame, counters: int) -> DataFrame:
    """(d, doc_id) -> (d, keep_id, group_size) of the digests that hold more than 1/counters of the rows: under counters rows."""
    found = (
        keys.select("d").mapInArrow(misra_gries(counters), "d binary, n long")
        .groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").limit(counters).select(F.col("d").alias("c"))
    )
    counted = keys.join(F.broadcast(found), F.col("d") == F.col("c"), "left").groupBy("c").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    counted = written(counted)
    rows = counted.agg(F.sum("group_size")).first()[0] or 0
    return counted.where(F.col("c").isNotNull() & (F.col("group_size") * counters > rows)).withColumnRenamed("c", "h")


def _split(docs: DataFrame, text: str, doc_id: str, counters: int, row: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hot, cold): d, id and, in a struct of its own, the columns of each row that are to stay; hot rows have keep_id and group_size too."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in row]).alias("row"), digest(text).alias("d"), F.col(f"`{doc_id}`").alias("id"))
    keys = written(named.select("d", F.col("id").alias("doc_id")))
    winners = heavy(keys, counters)
    # Where only the id is to stay, the written keys are enough and the texts are not read again.
    rows = named if row != [doc_id] else keys.select(F.struct(F.col("doc_id").alias(doc_id)).alias("row"), "d", F.col("doc_id").alias("id"))
    met = rows.join(F.broadcast(winners), F.col("d") == F.col("h"), "left")
    return met.where("h is not null").drop("h"), met.where("h is null").drop("h", "keep_id", "group_size")


def annotate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = 1024, keep_text: bool = True) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256; keep_text=False returns doc_id and these only, and shuffles no text."""
    row = without(docs, *RESULT).columns if keep_text else [doc_id]
    hot, cold = _split(docs, text, doc_id, counters, row)
    w = Window.partitionBy("d")
    cold = cold.withColumns({"keep_id": F.min("id").over(w), "group_size": F.count("*").over(w)})
    out = hot.unionByName(cold)
    return out.select("row.*", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("d")).alias("text_sha256"))


def survivors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = 1024) -> DataFrame:
    """One row of each group of equal texts, with the columns of docs."""
    hot, cold = _split(docs, text, doc_id, counters, docs.columns)
    w = Window.partitionBy("d").orderBy(F.col("id").asc_nulls_last())
    cold = cold.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    hot = hot.where(F.col("id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["d"]).drop("keep_id", "group_size")
    return hot.unionByName(cold).select("row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return annotate(docs, keep_text=False).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""
