"""Frames to clips: episodes, nearest-frame resampling, sliding windows, clip catalog rows.

Frames have episode_index, frame_index (may be null), arrival_seq, language (may be null) and whatever else they
carry. All operators are windows and aggregates within an episode; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import run_ids


@dataclass(frozen=True)
class ClipSpec:
    """How an episode of a dataset becomes clips."""

    repo_id: str
    robot_type: str = "unknown"
    source_fps: float = 15.0
    target_fps: float = 4.0
    length: int = 64
    stride: int = 32

    def __post_init__(self) -> None:
        if min(self.source_fps, self.target_fps, self.length, self.stride) <= 0:
            raise ValueError("rates, length and stride are positive")

    @property
    def dataset_name(self) -> str:
        return self.repo_id.rpartition("/")[2]


def nested(df: DataFrame, path: str) -> Column:
    """The column that is named like the whole dotted path, or else the nested field; KeyError if there is neither."""
    if path in df.columns:
        return F.col(f"`{path}`")
    kind = df.schema
    for part in path.split("."):
        if part not in getattr(kind, "names", []):
            raise KeyError(path)
        kind = kind[part].dataType
    return F.col(path)


def dataset_name(repo_id: Column) -> Column:
    return F.substring_index(repo_id, "/", -1)


def streamed_episodes(frames: DataFrame) -> DataFrame:
    """frames with run, ordinal and frame: a new run starts wherever episode_index changes in the order of arrival.

    An episode that comes again makes a second run. Frames without frame_index get their ordinal in the run.
    """
    runs = run_ids(frames, "episode_index", "arrival_seq")
    ordinal = F.row_number().over(Window.partitionBy("run").orderBy("arrival_seq")) - 1
    return runs.withColumn("ordinal", ordinal.cast("long")).withColumn("frame", F.coalesce("frame_index", "ordinal").cast("long"))


def indexed_episodes(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows (with row) of each episode's range [from, to), with run and frame; the ordinal in the range stands in for a missing frame_index.

    Ranges do not overlap, so each row finds its range by the last start at or before it: a union and one running
    maximum over stretches of rows, not a theta join.
    """
    stretch = 65_536
    # A range is put into every stretch that it touches; a row meets the ranges of its own stretch only.
    spread = ranges.where("to > from").withColumn("__s", F.explode(F.sequence(F.floor(F.col("from") / stretch), F.floor((F.col("to") - 1) / stretch))))
    met = rows.withColumn("__s", F.floor(F.col("row") / stretch)).join(spread, "__s")
    met = met.where((F.col("row") >= F.col("from")) & (F.col("row") < F.col("to"))).drop("__s")
    return met.withColumn("frame", F.coalesce("frame_index", F.col("row") - F.col("from")).cast("long")).drop("from", "to")


def ordered(frames: DataFrame, key: str) -> DataFrame:
    """frames with position: 0, 1, ... by frame, those of one number by arrival, within each episode."""
    w = Window.partitionBy(key).orderBy("frame", "arrival_seq")
    return frames.withColumn("position", (F.row_number().over(w) - 1).cast("long"))


def language(frames: DataFrame, key: str) -> DataFrame:
    """(key, language): the first one that is not null, by arrival; null if there is none."""
    return frames.groupBy(key).agg(F.min_by("language", F.when(F.col("language").isNotNull(), F.col("arrival_seq"))).alias("language"))


def resampled(frames: DataFrame, key: str, spec: ClipSpec) -> DataFrame:
    """One row per point of each episode's target grid: key, target (its number), frame, arrival_seq and first_frame.

    The point takes the last frame at or before it, or the next one if that is strictly nearer; of frames with
    one number the last counts before the point and the first after it. Grid points and frames are merged and
    sorted together once per episode, which is one shuffle and no join of the two.
    """
    w = Window.partitionBy(key)
    timed = frames.select(key, "frame", "arrival_seq", F.min("frame").over(w).alias("first_frame"), F.max("frame").over(w).alias("last_frame"))
    seconds = (F.col("frame") - F.col("first_frame")) / F.lit(spec.source_fps)
    timed = timed.withColumn("ts", seconds)
    ends = timed.groupBy(key).agg(F.max("ts").alias("end"), F.max("first_frame").alias("first_frame"))
    grid = ends.withColumn("target", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("end") * F.lit(spec.target_fps)))))
    chosen = F.struct("ts", "frame", "arrival_seq")
    none = F.lit(None).cast("long")
    both = timed.select(key, "first_frame", "ts", F.lit(0).alias("side"), "frame", "arrival_seq", none.alias("target")).unionByName(
        grid.select(key, "first_frame", (F.col("target") / F.lit(spec.target_fps)).alias("ts"), F.lit(1).alias("side"), none.alias("frame"), none.alias("arrival_seq"), "target")
    )
    columns = ("ts", "side", "frame", "arrival_seq", "target")
    seen = F.when(F.col("side") == 0, chosen)
    # What follows is what precedes in the opposite order: a frame that only grows takes one pass, one that shrinks a pass per row.
    running = lambda *order: F.last(seen, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"before": running(*columns), "after": running(*[F.desc(c) for c in columns])})
    nearer = F.col("after").isNotNull() & (F.abs(F.col("after.ts") - F.col("ts")) < F.abs(F.col("before.ts") - F.col("ts")))
    pick = F.when(nearer, F.col("after")).otherwise(F.col("before"))
    return both.where("side = 1").select(key, "target", "first_frame", pick.alias("x")).select(key, "target", "first_frame", "x.frame", "x.arrival_seq")


def windows(kept: DataFrame, key: str, spec: ClipSpec, frames: bool = False) -> DataFrame:
    """Sliding windows over the resampled frames: key, window, start, originals, clip_start_frame, clip_end_frame.

    Window j exists if j * stride < n and it is the first or the one before did not reach the end. The last
    one may be short; originals counts its real frames. With frames=True there is a row per frame of each
    window, slot 0 to length - 1, short windows repeating their last frame.
    """
    size, step = spec.length, spec.stride
    n = kept.groupBy(key).agg(F.count("*").alias("n"), F.min("first_frame").alias("first_frame"))
    last = F.greatest(F.lit(0).cast("long"), F.least(F.floor((F.col("n") - 1) / step), F.ceil((F.col("n") - size) / step)))
    every = n.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    every = every.withColumn("start", F.col("window") * step).withColumn("originals", F.least(F.lit(size).cast("long"), F.col("n") - F.col("start")))
    # Each kept frame is the first or the last real one of few windows: two equi joins on its place.
    at = lambda c, name: kept.select(F.col(key).alias(f"{key}_{name}"), F.col("target").alias(f"at_{name}"), F.col("frame").alias(c))
    out = every.join(at("clip_start_frame", "s"), (F.col(key) == F.col(f"{key}_s")) & (F.col("start") == F.col("at_s")))
    out = out.join(at("clip_end_frame", "e"), (F.col(key) == F.col(f"{key}_e")) & (F.col("start") + F.col("originals") - 1 == F.col("at_e")))
    out = out.select(key, "window", "start", "originals", "first_frame", "clip_start_frame", "clip_end_frame")
    if not frames:
        return out
    slots = out.select(key, "window", "start", "originals", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias("slot"))
    slots = slots.withColumn("target", F.col("start") + F.least("slot", F.col("originals") - 1))
    return slots.join(kept.select(key, "target", "frame", "arrival_seq"), [key, "target"]).select(key, "window", "slot", "frame", "arrival_seq")


def clips(frames: DataFrame, spec: ClipSpec, key: str = "episode_index") -> DataFrame:
    """The catalog rows of all clips; key names the episode (or the run of a streamed one) and becomes part of the id."""
    found = windows(resampled(frames, key, spec), key, spec)
    found = found.join(language(frames, key).withColumnRenamed(key, "__k"), F.col(key).eqNullSafe(F.col("__k"))).drop("__k")
    seconds = lambda c: (F.col(c) - F.col("first_frame")) / F.lit(spec.source_fps)
    return found.select(
        F.concat_ws("_", F.lit(spec.repo_id), F.col(key)).alias("episode_id"), F.col(key), "window",
        F.lit(spec.dataset_name).alias("dataset_name"), F.lit(spec.robot_type).alias("robot_type"),
        "clip_start_frame", "clip_end_frame", seconds("clip_start_frame").alias("timestamp_start"), seconds("clip_end_frame").alias("timestamp_end"),
        F.col("language").alias("language_instruction"), F.col("originals").alias("num_original_frames"),
    )
