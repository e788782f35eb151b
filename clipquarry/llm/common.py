"""Shared pieces of the training-data operators: word syntax, work tables, name clashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import delete, forget, passing, work_dir
from ..work import saved as written

__all__ = ["delete", "few", "forget", "lower_ascii", "passing", "release", "slices", "table", "whole", "without", "work_dir", "written"]

#: White space and words as the queries define them (ASCII white space only).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a table that is broadcast, at most, as few() counts them; beyond, rows meet by shuffle.
MAX_BROADCAST = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A written table, broadcast if its bytes (values, and 16 a row) are within the limit."""
    wide = {"string": F.octet_length, "binary": F.octet_length}
    of = lambda f: wide[f.dataType.typeName()](F.col(f"`{f.name}`")) if f.dataType.typeName() in wide else F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))) if f.dataType.typeName() in ("array", "map", "struct") else F.lit(8)
    row = sum((F.coalesce(of(f), F.lit(0)) for f in df.schema), F.lit(16)).cast("long")
    size = df.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(df) if size <= (MAX_BROADCAST if limit is None else limit) else df


def release() -> None:
    """Gives free memory of a Python worker back: workers live on, and what one stage needed would be missing in the next."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches, rows: int = 512):
    """Record batches in pieces of at most ``rows`` rows, so that what a worker holds of long texts stays small."""
    batch = None
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    del batch
    release()


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that clash with those names, whatever their case."""
    taken = {x.lower() for x in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def whole(c: str) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(c), F.lit(""))
