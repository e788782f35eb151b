"""Row numbers and runs over a total order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..work import saved


def global_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name: 0, 1, 2, ... in the given order.

    Rows are dealt out by ranges of the order; each range numbers its own, and the ranges' sizes, one row each, give their starts.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id()
    dealt = saved(dealt.withColumns({"__range": F.spark_partition_id(), "__at": local - F.shiftleft(F.spark_partition_id().cast("long"), 33)}))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))  # one row per range
    out = dealt.join(F.broadcast(starts), "__range")
    return out.withColumn(name, (F.col("__at") + F.col("__start")).cast("long")).drop("__range", "__at", "__start")


def run_ids(df: DataFrame, value: str, order: str, span: int = 65_536) -> DataFrame:
    """df with run: a number that grows by one wherever value differs from that of the row before, in a long order.

    The order is cut into stretches of ``span``; only each stretch's last value and number of changes meet in one task.
    """
    cut = F.floor(F.col(order) / span)
    df = df.withColumn("__s", cut)
    within = Window.partitionBy("__s").orderBy(order)
    df = df.withColumn("__prev", F.lag(F.struct(F.col(value))).over(within))
    ends = df.groupBy("__s").agg(F.max_by(F.struct(F.col(value)), order).alias("__last"))
    over = Window.orderBy("__s")  # one row per stretch
    ends = ends.select(F.col("__s").alias("__t"), F.lag("__last").over(over).alias("__before"))
    df = df.join(ends, F.col("__s") == F.col("__t"))
    prev = F.coalesce("__prev", "__before")
    changed: Column = prev.isNull() | ~prev[value].eqNullSafe(F.col(value))
    df = df.withColumn("__c", changed.cast("long"))
    df = df.withColumn("__k", F.sum("__c").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    sums = df.groupBy("__s").agg(F.sum("__c").alias("__n"))
    sums = sums.select(F.col("__s").alias("__u"), F.coalesce(F.sum("__n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    out = df.join(sums, F.col("__s") == F.col("__u"))
    return out.withColumn("run", F.col("__k") + F.col("__base")).drop("__s", "__prev", "__t", "__before", "__c", "__k", "__u", "__base")
