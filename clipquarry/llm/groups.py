"""Groups of rows in Python tasks, and components of graphs of ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, release, written


def each_group(fn: Callable[[pa.Table], dict[str, np.ndarray] | None], schema: pa.Schema, least: int = 2):
    """A mapInArrow function for rows that come sorted by their first column: fn gets the rows of one value at a time, if there are ``least`` of them.

    A group is held in memory as a whole; callers bound its rows and bytes before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list[dict] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[f.name] for x in out]), f.type) for f in schema], schema=schema)

        def take(group: pa.Table) -> None:
            nonlocal rows
            if group.num_rows >= least and (x := fn(group)) is not None and len(x[schema.names[0]]):
                out.append(x)
                rows += len(x[schema.names[0]])

        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts = [0, *cuts.tolist(), len(key)]
            for a, b in zip(starts, starts[1:]):
                part = batch.slice(a, b - a)
                if held and a == 0 and held[0].column(0)[0].as_py() != key[0]:
                    take(pa.Table.from_batches(held))
                    held = []
                if b == len(key):
                    held.append(part)
                elif held:
                    take(pa.Table.from_batches([*held, part]))
                    held = []
                elif b - a >= least:
                    take(pa.Table.from_batches([part]))
                if rows >= 50_000:
                    yield flush()
                    out, rows = [], 0
        if held:
            take(pa.Table.from_batches(held))
        if out:
            yield flush()
        held, out = [], []
        release()

    return run


def map_groups(df: DataFrame, key: str, fn, schema: str) -> DataFrame:
    """df's rows with one value of key at a time through fn; groups of one row are skipped."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    first = df.select(key, *[c for c in df.columns if c != key])
    return first.repartition(key).sortWithinPartitions(key).mapInArrow(each_group(fn, arrow), schema)


class Forest:
    """Union-find over 0 to n - 1, the smaller number on top."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        return np.fromiter((self.find(x) for x in range(len(self.up))), np.int64, len(self.up))


def stars(ids: np.ndarray, forest: Forest) -> dict[str, np.ndarray]:
    """Edges (a, b) from the smallest id of each tree to its other ids."""
    root = forest.roots()
    order = np.lexsort((ids, root))
    r, i = root[order], ids[order]
    first = np.r_[True, r[1:] != r[:-1]]
    least = i[first][np.cumsum(first) - 1]
    return {"a": least[~first], "b": i[~first]}


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (id, component): the smallest id that each id in an edge reaches.

    Every id hooks to its smallest neighbour, chains are shortened by pointer jumping until they
    are stars, and the edges between stars are treated the same way until none is left. Nothing is collected;
    each round is a few joins of id pairs, written to the shared folder.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct())
    total = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
        while True:
            top = up.select(F.col("id").alias("i"), F.col("component").alias("c"))
            next_ = written(up.join(top, F.col("component") == F.col("i")).select("id", F.col("c").alias("component"), (F.col("c") != F.col("component")).alias("moved")))
            moved = not next_.where("moved").isEmpty()
            up = next_.drop("moved")
            if not moved:
                break
        if total is None:
            total = up
        else:
            top = up.select(F.col("id").alias("i"), F.col("component").alias("c"))
            total = written(total.join(top, F.col("component") == F.col("i"), "left").select("id", F.coalesce("c", "component").alias("component")))
        a = up.select(F.col("id").alias("a"), F.col("component").alias("x"))
        b = up.select(F.col("id").alias("b"), F.col("component").alias("y"))
        left = edges.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        last, edges = edges, written(left)
        forget(last)
    if total is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return total
