"""Trajectory search: episodes as vector series, candidates by their frames, ranks by dynamic time warping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.registered import dtw_distance, dtw_lower_bound, dtw_path
from .search import DIGITS, knn_join, positive
from .tokens import gathered


def sequences(steps: DataFrame) -> DataFrame:
    """(episode_id, step, vec) -> (episode_id, seq): each episode's vectors in order."""
    return gathered(steps.withColumn("vec", V.doubles(F.col("vec"))), "episode_id", "vec", "seq", "step")


def trajectories(tokens: DataFrame, clips: DataFrame, width: int) -> DataFrame:
    """(episode_id, step, vec): the mean vector of each clip, in the order of the clips' starts."""
    from .tokens import pooled

    steps = pooled(tokens, width, name="vec").join(clips.select("clip_id", "episode_id", "timestamp_start"), "clip_id")
    step = F.row_number().over(Window.partitionBy("episode_id").orderBy("timestamp_start", "clip_id")) - 1
    return steps.select("episode_id", step.cast("long").alias("step"), "vec")


def candidates(steps: DataFrame, episode_id: str, frame_k: int) -> DataFrame:
    """(episode_id): the episodes that own one of the frame_k nearest frames of a frame of the given one, without itself.

    Its own frames count among the frame_k.
    """
    frames = steps.withColumn("frame", F.struct("episode_id", "step"))
    query = frames.where(F.col("episode_id") == episode_id).select(F.col("step").alias("query_id"), "vec")
    near = knn_join(query, frames, frame_k, key="frame")
    return near.select(F.col("frame.episode_id").alias("episode_id")).where(F.col("episode_id") != episode_id).distinct()


def warped(steps: DataFrame, episode_id: str, chosen: DataFrame | None = None, fraction: float = 0.2) -> DataFrame:
    """(episode_id, seq, query): the other episodes' series (of the chosen ones) beside that of the given one."""
    query = sequences(steps.where(F.col("episode_id") == episode_id)).select(F.col("seq").alias("query"))
    others = steps.where(F.col("episode_id") != episode_id)
    if chosen is not None:
        others = others.join(chosen, "episode_id", "left_semi")
    return sequences(others).crossJoin(F.broadcast(query))  # one row


def rank(steps: DataFrame, episode_id: str, top_k: int, chosen: DataFrame | None = None, fraction: float = 0.2, prune: bool = False) -> DataFrame:
    """(episode_id, distance, rank): the top_k other episodes by DTW distance, ties by episode_id.

    With prune=True lower bounds come first: the top_k by bound are measured, and of the others only those whose bound
    does not exceed the worst of these. The bound is admissible, so the result is the same.
    """
    positive(top_k=top_k)
    if not 0 <= fraction <= 1:
        raise ValueError("the window's fraction lies between 0 and 1")
    rows = warped(steps, episode_id, chosen, fraction)
    share = F.lit(float(fraction))
    if prune:
        from ..work import saved

        rows = saved(rows.withColumn("bound", dtw_lower_bound("query", "seq", share)))
        probe = rows.orderBy("bound", "episode_id").limit(top_k).withColumn("d", dtw_distance("query", "seq", share))
        worst, n = probe.agg(F.max("d"), F.count("*")).first()
        if n == top_k:
            rows = rows.where(F.col("bound") <= F.lit(worst) + 1e-9)
    out = rows.select("episode_id", F.round(dtw_distance("query", "seq", share), DIGITS).alias("distance"))
    top = out.orderBy("distance", "episode_id").limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("distance", "episode_id")))  # top_k rows


def alignments(steps: DataFrame, episode_id: str, ranked: DataFrame, fraction: float = 0.2) -> DataFrame:
    """(episode_id, k, q, c): the aligned steps of the given episode and of each ranked one, in order."""
    rows = warped(steps, episode_id, ranked.select("episode_id"), fraction)
    path = rows.select("episode_id", F.posexplode(dtw_path("query", "seq", F.lit(float(fraction)))).alias("k", "x"))
    return path.select("episode_id", "k", "x.q", "x.c")


def bounds(steps: DataFrame, episode_id: str, fraction: float = 0.2) -> DataFrame:
    """(episode_id, bound): a lower bound of each other episode's DTW distance."""
    return warped(steps, episode_id).select("episode_id", F.round(dtw_lower_bound("query", "seq", F.lit(float(fraction))), DIGITS).alias("bound"))


def search(steps: DataFrame, catalog: DataFrame, episode_id: str, top_k: int = 10, frame_k: int = 50, fraction: float = 0.2) -> DataFrame:
    """Trajectory results: episode_id, dataset_name, robot_type (empty if the catalog lacks the episode), distance, rank."""
    from .search import episode_lookup

    if steps.where(F.col("episode_id") == episode_id).isEmpty():
        raise KeyError(episode_id)
    ranked = rank(steps, episode_id, top_k, candidates(steps, episode_id, frame_k), fraction)
    known = episode_lookup(catalog).withColumnsRenamed({"dataset_name": "__d", "robot_type": "__r"})
    met = ranked.join(known, "episode_id", "left")
    return met.select("episode_id", F.coalesce("__d", F.lit("")).alias("dataset_name"), F.coalesce("__r", F.lit("")).alias("robot_type"), "distance", "rank")
