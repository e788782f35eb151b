"""SQL functions for a session: maxsim, dtw_distance and dtw_lower_bound (Arrow-batched), and the table function dtw_path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels

#: A step of the one series and of the other. Types are objects here, as this module is imported before there is a session.
Pair = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("c", T.IntegerType())])


def _matrix(x) -> np.ndarray:
    return np.array([np.asarray(r, np.float64) for r in x])


@F.pandas_udf(T.DoubleType())
def maxsim(query: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([kernels.maxsim(_matrix(a), _matrix(b)) for a, b in zip(query, candidate, strict=True)])


@F.pandas_udf(T.DoubleType())
def maxsim_flat(query: pd.Series, candidate: pd.Series, width: pd.Series) -> pd.Series:
    """The same for matrices stored row after row in one array."""
    return pd.Series([kernels.maxsim(np.reshape(a, (-1, w)), np.reshape(b, (-1, w))) for a, b, w in zip(query, candidate, width, strict=True)])


@F.pandas_udf(T.DoubleType())
def dtw_distance(a: pd.Series, b: pd.Series, fraction: pd.Series) -> pd.Series:
    return pd.Series([kernels.dtw_distance(_matrix(x), _matrix(y), kernels.window_for(len(x), len(y), f)) for x, y, f in zip(a, b, fraction, strict=True)])


@F.pandas_udf(T.DoubleType())
def dtw_lower_bound(a: pd.Series, b: pd.Series, fraction: pd.Series) -> pd.Series:
    return pd.Series([kernels.envelope_bound(_matrix(x), _matrix(y), kernels.window_for(len(x), len(y), f)) for x, y, f in zip(a, b, fraction, strict=True)])


@F.pandas_udf(T.ArrayType(Pair))
def dtw_path(a: pd.Series, b: pd.Series, fraction: pd.Series) -> pd.Series:
    return pd.Series([[{"q": q, "c": c} for q, c in kernels.dtw_path(_matrix(x), _matrix(y), kernels.window_for(len(x), len(y), f))] for x, y, f in zip(a, b, fraction, strict=True)])


@F.udtf(returnType=Pair)
class DtwPath:
    def eval(self, a, b, fraction: float) -> Iterator[tuple[int, int]]:
        yield from kernels.dtw_path(_matrix(a), _matrix(b), kernels.window_for(len(a), len(b), fraction))


def register(spark: SparkSession) -> None:
    for name, fn in (("maxsim", maxsim), ("maxsim_flat", maxsim_flat), ("dtw_distance", dtw_distance), ("dtw_lower_bound", dtw_lower_bound), ("dtw_path_of", dtw_path)):
        spark.udf.register(name, fn)
    spark.udtf.register("dtw_path", DtwPath)
