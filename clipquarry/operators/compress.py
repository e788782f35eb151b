"""Token compression: PCA, a codebook, and residuals quantised to two bits per dimension."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from ..functions import kernels
from ..functions import vectors as V
from .tokens import pooled

#: Codebooks up to this size are searched with columns, and projections of up to so many numbers are written out as columns; larger ones go to kernels.
SMALL_CODEBOOK = 32
SMALL_PROJECTION = 1024
#: Keys of a sample that are broadcast, at most; a larger sample's rows meet them by shuffle.
BROADCAST_SAMPLE = 1_000_000


@dataclass(frozen=True)
class Model:
    """A fitted compressor: p dimensions, k centroids. thresholds has three rows and levels four, of p values each."""

    mean: list[float]
    components: list[list[float]]
    centroids: list[list[float]]
    thresholds: list[list[float]] = field(default_factory=list)
    levels: list[list[float]] = field(default_factory=list)
    explained: list[float] = field(default_factory=list)

    @property
    def width(self) -> int:
        return len(self.components)

    def require(self, *parts: str) -> None:
        missing = [p for p in parts if not len(getattr(self, p))]
        if missing:
            raise RuntimeError(f"the compressor is not trained: no {', '.join(missing)}")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(name, i, [float(x) for x in np.atleast_1d(row)]) for name in self.__dataclass_fields__ for i, row in enumerate(getattr(self, name))]
        spark.createDataFrame(rows, "part string, i int, v array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        parts: dict[str, list] = {}
        for r in spark.read.parquet(path).orderBy("part", "i").collect():  # k + a few rows
            parts.setdefault(r["part"], []).append(list(r["v"]))
        for flat in ("mean", "explained"):
            parts[flat] = [x[0] for x in parts.get(flat, [])]
        model = cls(**parts)
        model.require("mean", "components", "centroids")
        return model


def projected(tokens: DataFrame, model: Model, vec: str = "vec", name: str = "y", kernel: bool | None = None) -> DataFrame:
    """tokens with their projection, by columns or (kernel; by default for large models) by matrix products."""
    model.require("mean", "components")
    if not kernel and (kernel is False or model.width * len(model.mean) <= SMALL_PROJECTION):
        return tokens.withColumn(name, V.project(V.doubles(F.col(vec)), model.mean, model.components))
    shared = tokens.sparkSession.sparkContext.broadcast((np.array(model.mean), np.array(model.components)))

    @F.pandas_udf(ArrayType(DoubleType()))
    def project(v: pd.Series) -> pd.Series:
        mean, components = shared.value
        return pd.Series(list((np.stack(v.to_numpy()) - mean) @ components.T) if len(v) else [], dtype=object)

    return tokens.withColumn(name, project(vec))


def assigned(tokens: DataFrame, centroids: list[list[float]], vec: str = "y", name: str = "centroid_id", kernel: bool | None = None) -> DataFrame:
    """tokens with the nearest centroid; of equally near ones the first. By columns or, as in projected(), by matrix products."""
    if not kernel and (kernel is False or len(centroids) <= SMALL_CODEBOOK):
        book = F.array(*[V.literal(c) for c in centroids])
        far = tokens.withColumn("__d", F.transform(book, lambda c: V.squared_distance(F.col(vec), c)))
        return far.withColumn(name, (F.array_position(F.col("__d"), F.array_min("__d")) - 1).cast("int")).drop("__d")
    shared = tokens.sparkSession.sparkContext.broadcast(np.array(centroids))

    @F.pandas_udf(IntegerType())
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(kernels.nearest(np.stack(v.to_numpy()), shared.value)) if len(v) else pd.Series([], dtype="int32")

    return tokens.withColumn(name, nearest(vec))


def residuals(tokens: DataFrame, model: Model) -> DataFrame:
    """tokens (with vec) and y, centroid_id, residual."""
    model.require("centroids")
    met = assigned(projected(tokens, model), model.centroids)
    book = F.array(*[V.literal(c) for c in model.centroids]) if len(model.centroids) <= SMALL_CODEBOOK else None
    if book is not None:
        return met.withColumn("residual", V.minus(F.col("y"), F.element_at(book, F.col("centroid_id") + 1)))
    table = met.sparkSession.createDataFrame([(i, c) for i, c in enumerate(model.centroids)], "centroid_id int, __c array<double>")
    return met.join(F.broadcast(table), "centroid_id").withColumn("residual", V.minus(F.col("y"), F.col("__c"))).drop("__c")  # at most 65535 rows


def dimension_thresholds(rows: DataFrame, vec: str = "residual") -> DataFrame:
    """(dim, t0, t1, t2): the exact quartiles of each dimension, linearly interpolated."""
    each = rows.select(F.posexplode(vec).alias("dim", "x"))
    q = each.groupBy("dim").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("dim", *[F.get("q", F.lit(i)).alias(f"t{i}") for i in range(3)])


def level_values(rows: DataFrame, thresholds: DataFrame, vec: str = "residual") -> DataFrame:
    """(dim, level, value): the median of what falls on each level; of an empty level its threshold, or the middle of its two."""
    t0, t1, t2 = (F.col(f"t{i}") for i in range(3))
    each = rows.select(F.posexplode(vec).alias("dim", "x")).join(F.broadcast(thresholds), "dim")  # one row per dimension
    level = (F.col("x") > t0).cast("int") + (F.col("x") > t1).cast("int") + (F.col("x") > t2).cast("int")
    found = each.groupBy("dim", level.alias("level")).agg(F.median("x").alias("m"))
    grid = thresholds.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    empty = F.when(F.col("level") == 0, t0).when(F.col("level") == 1, (t0 + t1) / 2).when(F.col("level") == 2, (t1 + t2) / 2).otherwise(t2)
    return grid.join(found, ["dim", "level"], "left").select("dim", "level", F.coalesce("m", empty).alias("value"))


def _pca(vectors: DataFrame, width: int) -> tuple[list[float], list[list[float]], list[float]]:
    """(mean, components, shares of the variance); the covariance is centred by the fit itself."""
    rows = vectors.select(array_to_vector("v").alias("x"))
    mean = rows.select(Summarizer.mean(F.col("x")).alias("m")).first()["m"].toArray().tolist()
    fitted = PCA(k=width, inputCol="x", outputCol="y").fit(rows)
    return mean, fitted.pc.toArray().T.tolist(), fitted.explainedVariance.toArray().tolist()


def fit(tokens: DataFrame, width: int = 128, n_centroids: int = 32_768, seed: int = 0, vec: str = "vec", variance: float = 0.95, wide: int = 256) -> Model:
    """Fits a model to a training sample (see sampled()).

    If 128 dimensions were asked for and reached, but hold less than ``variance`` of the variance, 256 are
    used where rows and columns allow it. The width must divide by 4, as four levels share a byte.
    """
    if width <= 0 or not 0 < n_centroids <= 65_535:
        raise ValueError("width is positive, and centroids number 1 to 65535")
    vectors = tokens.select(V.doubles(F.col(vec)).alias("v")).persist()
    try:
        rows, d = vectors.count(), vectors.select(F.size("v")).first()[0]
        p = min(width, rows, d)
        if p % 4:
            raise ValueError(f"{p} dimensions cannot be packed: the width must be a multiple of 4")
        mean, components, explained = _pca(vectors, p)
        if width == 128 and p == 128 and sum(explained) < variance and min(rows, d) >= wide:
            mean, components, explained = _pca(vectors, wide)
        ys = projected(vectors, Model(mean, components, []), "v").select("y").persist()
        k = min(n_centroids, rows)
        clusters = KMeans(k=k, seed=seed, featuresCol="x").fit(ys.select(array_to_vector("y").alias("x")))
        model = Model(mean, components, [c.tolist() for c in clusters.clusterCenters()], explained=explained)
        left = residuals(vectors.withColumnRenamed("v", "vec"), model).select("residual").persist()
        bounds = dimension_thresholds(left)
        t = sorted(map(tuple, bounds.collect()))  # one row per dimension
        v = {(r["dim"], r["level"]): r["value"] for r in level_values(left, bounds).collect()}  # four per dimension
        left.unpersist()
        ys.unpersist()
    finally:
        vectors.unpersist()
    dims = range(len(components))
    return Model(mean, components, model.centroids, [[t[j][1 + i] for j in dims] for i in range(3)], [[v[j, i] for j in dims] for i in range(4)], explained)


def is_small(model: Model) -> bool:
    return len(model.centroids) <= SMALL_CODEBOOK and model.width * len(model.mean) <= SMALL_PROJECTION


def _compress_kernel(shared):
    """Projection, nearest centroid, residual, levels and packing of a batch of tokens by matrix products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, components, book, bounds = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            y = (np.stack(batch.column(2).to_numpy(zero_copy_only=False)).astype(np.float64) - mean) @ components.T
            ids = kernels.nearest(y, book)
            packed = kernels.pack2((y - book[ids] > bounds[:, None, :]).sum(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int32()), pa.array([p.tobytes().hex().upper() for p in packed]), pa.array(list(y), pa.list_(pa.float64()))], ["clip_id", "token_pos", "centroid_id", "packed", "y"])

    return run


def compressed(tokens: DataFrame, model: Model, kernel: bool | None = None) -> DataFrame:
    """One row per token: clip_id, token_pos, centroid_id, packed (hex), y."""
    model.require("mean", "components", "centroids", "thresholds")
    if kernel or (kernel is None and not is_small(model)):
        shared = tokens.sparkSession.sparkContext.broadcast(tuple(np.array(x) for x in (model.mean, model.components, model.centroids, model.thresholds)))
        rows = tokens.select("clip_id", "token_pos", "vec")
        kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("clip_id", "token_pos")]
        return rows.mapInArrow(_compress_kernel(shared), ", ".join([*kinds, "centroid_id int, packed string, y array<double>"]))
    bounds = F.array(*[V.literal(t) for t in model.thresholds])
    met = residuals(tokens, model).withColumn("level", V.quantise(F.col("residual"), bounds))
    return met.select("clip_id", "token_pos", "centroid_id", V.pack2(F.col("level"), model.width).alias("packed"), "y")


def clip_records(tokens: DataFrame, model: Model) -> DataFrame:
    """One row per clip: clip_id, centroid_ids, residuals (binary) and coarse_vector, in the order of the tokens."""
    rows = compressed(tokens, model)
    packed = rows.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("token_pos", "centroid_id", "packed"))).alias("x"))
    packed = packed.select("clip_id", F.transform("x", lambda x: x["centroid_id"]).alias("centroid_ids"), F.unhex(F.array_join(F.transform("x", lambda x: x["packed"]), "")).alias("residuals"))
    return packed.join(pooled(rows, model.width, vec="y", name="coarse_vector"), "clip_id")


def decompressed(rows: DataFrame, model: Model, name: str = "vec", kernel: bool | None = None) -> DataFrame:
    """Rows with centroid_id and packed, and the vector that they stand for."""
    model.require("centroids", "levels")
    if kernel or (kernel is None and not is_small(model)):
        shared = rows.sparkSession.sparkContext.broadcast((np.array(model.centroids), np.array(model.levels)))
        width = model.width

        @F.pandas_udf(ArrayType(DoubleType()))
        def back(ids: pd.Series, packed: pd.Series) -> pd.Series:
            book, values = shared.value
            if not len(ids):
                return pd.Series([], dtype=object)
            q = kernels.unpack2(np.frombuffer(bytes.fromhex("".join(packed)), np.uint8).reshape(len(ids), -1), width)
            return pd.Series(list(book[ids.to_numpy()] + values[q, np.arange(width)]))

        return rows.withColumn(name, back("centroid_id", "packed"))
    values = F.array(*[V.literal(x) for x in model.levels])
    rows = rows.withColumn("__q", V.unpack2(F.col("packed"), model.width)).withColumn("__r", V.dequantise(F.col("__q"), values))
    table = rows.sparkSession.createDataFrame(list(enumerate(model.centroids)), "centroid_id int, __c array<double>")
    return rows.join(F.broadcast(table), "centroid_id").withColumn(name, V.plus(F.col("__c"), F.col("__r"))).drop("__q", "__r", "__c")  # at most 65535 rows


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 if one is zero."""
    n = V.norm(a) * V.norm(b)
    return V.dot(a, b) / F.when(n == 0, 1.0).otherwise(n)


def fidelity(tokens: DataFrame, model: Model) -> DataFrame:
    """(clip_id, cosine): the mean cosine of each clip's projected tokens and what decompression gives back."""
    back = decompressed(compressed(tokens, model), model, "back")
    return back.groupBy("clip_id").agg(F.avg(cosine(F.col("y"), F.col("back"))).alias("cosine"))


def allocation(batches: DataFrame, size: int) -> DataFrame:
    """(batch, n) -> (batch, n, take): proportional shares of a sample of ``size``, the largest remainders rounded up; all if there are no more."""
    w = Window.partitionBy(F.lit(0))  # one row per batch file
    out = batches.withColumn("__all", F.sum("n").over(w)).withColumn("__want", F.least(F.lit(size).cast("long"), F.col("__all")))
    exact = F.col("n") * F.col("__want") / F.col("__all")
    out = out.withColumns({"__floor": F.floor(exact), "__rest": exact - F.floor(exact)})
    out = out.withColumn("__left", F.col("__want") - F.sum("__floor").over(w))
    out = out.withColumn("__rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("__rest", 9)), "batch")))
    return out.select("batch", "n", (F.col("__floor") + (F.col("__rank") <= F.col("__left")).cast("long")).alias("take"))


def sampled(rows: DataFrame, size: int, seed: int = 0, batch: str = "batch", key: str = "pos") -> DataFrame:
    """A sample without replacement of exactly ``size`` rows, spread over the batches in proportion, by a hash of seed, batch and key (unique in a batch).

    Only keys are ranked and shuffled; the rows meet the chosen ones, ``size`` at most, where they are read.
    """
    keys = rows.select(F.col(batch).alias("__b"), F.col(key).alias("__k"))
    shares = allocation(keys.groupBy(F.col("__b").alias("batch")).agg(F.count("*").alias("n")), size)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__b").cast("string"), F.col("__k").cast("string")))
    ranked = keys.withColumn("__n", F.row_number().over(Window.partitionBy("__b").orderBy(order, "__k")))
    chosen = ranked.join(shares.select(F.col("batch").alias("__s"), "take"), F.col("__b") == F.col("__s")).where(F.col("__n") <= F.col("take")).select("__b", "__k")
    if size <= BROADCAST_SAMPLE:
        chosen = F.broadcast(chosen)
    return rows.join(chosen, (F.col(batch) == F.col("__b")) & (F.col(key) == F.col("__k")), "left_semi")


def uniform_sample(rows: DataFrame, size: int, seed: int = 0, key: str = "clip_id") -> DataFrame:
    """``size`` rows at most, the first by a hash of seed and key."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(size)
