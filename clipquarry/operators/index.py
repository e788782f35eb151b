"""A coarse index: vectors in inverted lists, and its recall against exact search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..work import saved
from .compress import assigned, uniform_sample
from .search import BLOCK_BYTES, DIGITS, coarse_search, knn_join, met, plain, positive
from .tokens import unit

LEAST_RECALL = 0.95
#: Rows of a list that one task writes, about.
LIST_ROWS = 1_000_000


class RecallError(AssertionError):
    """An index finds too few of the true neighbours."""


@dataclass(frozen=True)
class Index:
    """Unit vectors (clip_id, vec, list) on disk, partitioned by list, and the lists' centres."""

    path: str
    centres: list[list[float]]
    probes: int

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int = 64, probes: int = 16, sample: int = 100_000, seed: int = 0, vec: str = "coarse") -> Index:
        """Centres come from a bounded sample of rows; every row is indexed. A search reads ``probes`` lists only."""
        positive(lists=lists, probes=probes)
        rows = unit(vectors.select("clip_id", F.col(vec).alias("vec")), "vec")
        fitted = KMeans(k=lists, seed=seed, featuresCol="x").fit(uniform_sample(rows, sample, seed).select(array_to_vector("vec").alias("x")))
        centres = [c.tolist() for c in fitted.clusterCenters()]
        listed = saved(assigned(rows, centres, "vec", "list", kernel=True))
        # A list with many rows is dealt to several tasks, and then has several files.
        parts = listed.groupBy(F.col("list").alias("__l")).agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("__parts"))
        dealt = listed.join(F.broadcast(parts), F.col("list") == F.col("__l")).withColumn("__part", F.pmod(F.xxhash64("clip_id"), F.col("__parts"))).drop("__l", "__parts")  # one row per list
        dealt.repartition("list", "__part").drop("__part").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
        rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return cls(path, centres, probes)

    @classmethod
    def open(cls, spark: SparkSession, path: str, probes: int = 16) -> Index:
        return cls(path, [r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()], probes)  # one row per list

    def nearest_lists(self, query: Sequence[float]) -> list[int]:
        d = ((np.array(self.centres) - np.asarray(query, float) / (np.linalg.norm(query) or 1.0)) ** 2).sum(1)
        return np.argsort(d, kind="stable")[: self.probes].tolist()

    def search(self, spark: SparkSession, query: Sequence[float], k: int) -> DataFrame:
        """(clip_id, score, rank), from the lists nearest to the query: a partition filter, so other lists are not read."""
        rows = spark.read.parquet(f"{self.path}/vectors").where(F.col("list").isin(self.nearest_lists(query)))
        return coarse_search(rows, query, k, vec="vec")

    def knn(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, clip_id, score, rank) of a set of queries (query_id, vec): each meets the rows of its lists only, by matrix products as in knn_join()."""
        from ..functions import vectors as V

        positive(k=k)
        spark, width = queries.sparkSession, len(self.centres[0])
        q = unit(queries.select("query_id", "vec"), "vec")
        book = F.array(*[V.literal(c) for c in self.centres])
        q = q.withColumn("__d", F.transform(book, lambda c: V.squared_distance(F.col("vec"), c)))
        near = F.slice(F.array_sort(F.transform("__d", lambda d, i: F.struct(d.alias("d"), i.alias("i")))), 1, self.probes)
        q = q.select("query_id", F.col("vec").alias("q"), F.transform(near, lambda x: x["i"]).alias("lists"))
        total, odd = q.agg(F.count("*"), F.count_if(~plain("q", width))).first()
        blocks = max(1, -(-(total * width * 8) // BLOCK_BYTES))
        rows = spark.read.parquet(f"{self.path}/vectors").select("clip_id", "vec", "list")
        found = met(q.where(plain("q", width)), rows, k, width, blocks)
        if odd:  # queries that lack numbers
            each = q.where(~plain("q", width)).select("query_id", "q", F.explode("lists").alias("list"))
            found = found.unionByName(rows.join(each, "list").select("query_id", "clip_id", F.round(V.dot(F.col("vec"), F.col("q")), DIGITS).alias("score")))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "clip_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame, k: int) -> float:
    """The mean share of each query's k true neighbours that were found."""
    hits = truth.join(found.select("query_id", "clip_id", F.lit(1).alias("hit")), ["query_id", "clip_id"], "left")
    per = hits.groupBy("query_id").agg((F.count("hit") / k).alias("r"))
    return float(per.agg(F.avg("r")).first()[0] or 0.0)


def measured(index: Index, vectors: DataFrame, queries: int = 1000, k: int = 10, vec: str = "coarse") -> float:
    """The index's recall over a sample of its own vectors."""
    rows = vectors.select("clip_id", F.col(vec).alias("vec"))
    k = min(k, rows.count())
    asked = uniform_sample(rows, queries).withColumnRenamed("clip_id", "query_id")
    return recall(index.knn(asked, k), knn_join(asked, rows, k), k)


def validate(index: Index, vectors: DataFrame, queries: int = 1000, k: int = 10, vec: str = "coarse") -> float:
    """measured(); RecallError if it is not above LEAST_RECALL."""
    share = measured(index, vectors, queries, k, vec)
    if share <= LEAST_RECALL:
        raise RecallError(f"recall {share:.4f} is not above {LEAST_RECALL}")
    return share


def record(spark: SparkSession, path: str, probes: int, share: float, vectors: int) -> None:
    """Keeps beside an index what recall it had with so many probes, and over how many vectors."""
    spark.createDataFrame([(probes, share, vectors)], "probes int, recall double, vectors long").coalesce(1).write.mode("overwrite").parquet(f"{path}/recall")


def recorded(spark: SparkSession, path: str) -> tuple[int, float, int] | None:
    """(probes, recall, vectors) as record() left them, or None."""
    try:
        row = spark.read.parquet(f"{path}/recall").first()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise
    return None if row is None else (row["probes"], row["recall"], row["vectors"])
