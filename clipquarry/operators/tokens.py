"""Token tables: one row per token of a clip (clip_id, token_pos, vec), the grid of positions, pooling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


@dataclass(frozen=True)
class Grid:
    """T temporal slices of side x side patches; a token's position is t * side * side + r * side + c."""

    times: int = 32
    side: int = 16

    def __post_init__(self) -> None:
        if min(self.times, self.side) <= 0:
            raise ValueError("a grid has positive sizes")

    @property
    def tokens(self) -> int:
        return self.times * self.side**2

    @property
    def middle(self) -> int:
        return self.times // 2

    def t(self, pos: Column) -> Column:
        return F.floor(pos / self.side**2).cast("int")

    def r(self, pos: Column) -> Column:
        return F.floor(pos % self.side**2 / self.side).cast("int")

    def c(self, pos: Column) -> Column:
        return (pos % self.side).cast("int")


@dataclass(frozen=True)
class Box:
    """An inclusive rectangle of patches."""

    row_start: int
    row_end: int
    col_start: int
    col_end: int

    def check(self, grid: Grid) -> Box:
        for a, b in ((self.row_start, self.row_end), (self.col_start, self.col_end)):
            if not 0 <= a <= b < grid.side:
                raise ValueError(f"{self} does not lie in a grid of side {grid.side}")
        return self

    def patches(self, grid: Grid) -> list[int]:
        """The patches inside, row after row."""
        self.check(grid)
        return [r * grid.side + c for r in range(self.row_start, self.row_end + 1) for c in range(self.col_start, self.col_end + 1)]

    def holds(self, pos: Column, grid: Grid) -> Column:
        self.check(grid)
        return grid.r(pos).between(self.row_start, self.row_end) & grid.c(pos).between(self.col_start, self.col_end)


def box_from_json(text: Column) -> Column:
    """A box from a JSON form field; malformed JSON fails the query, a missing or reversed bound makes it null."""
    box = F.from_json(text, "row_start int, row_end int, col_start int, col_end int", {"mode": "FAILFAST"})
    ok = (box["row_end"] >= box["row_start"]) & (box["col_end"] >= box["col_start"]) & (F.least(box["row_start"], box["col_start"]) >= 0)
    return F.when(ok, box)


def with_grid(tokens: DataFrame, grid: Grid) -> DataFrame:
    pos = F.col("token_pos")
    return tokens.withColumns({"t": grid.t(pos), "r": grid.r(pos), "c": grid.c(pos)})


def spatial(tokens: DataFrame, grid: Grid, box: Box | None = None) -> DataFrame:
    """The tokens of the middle slice, of the patches in the box if one is given."""
    out = tokens.where(grid.t(F.col("token_pos")) == grid.middle)
    return out if box is None else out.where(box.holds(F.col("token_pos"), grid))


def pooled(tokens: DataFrame, width: int, key: str = "clip_id", vec: str = "vec", name: str = "coarse") -> DataFrame:
    """(key, name): the mean of each clip's vectors. Sums are kept per dimension, so partial sums, not vectors, are shuffled."""
    means = [F.avg(F.element_at(vec, i + 1).cast("double")).alias(f"__{i}") for i in range(width)]
    return tokens.groupBy(key).agg(*means).select(key, F.array(*[f"__{i}" for i in range(width)]).alias(name))


def gathered(tokens: DataFrame, key: str = "clip_id", vec: str = "vec", name: str = "tokens", order: str = "token_pos") -> DataFrame:
    """(key, name): each clip's vectors in order, as an array of arrays. Bounded by the tokens of one clip."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(vec).alias("v"))))
    return tokens.groupBy(key).agg(F.transform(rows, lambda x: x["v"]).alias(name))


def unit(df: DataFrame, vec: str) -> DataFrame:
    """df with vec scaled to length 1. The norm is bound by a lambda: a column of its own would be merged into the inner one, and computed for each element."""
    v = V.doubles(F.col(vec))
    return df.withColumn(vec, F.get(F.transform(F.array(V.safe_norm(v)), lambda n: V.normalised(v, n)), F.lit(0)))
