"""Runs the stages in order, remembers where each stands, and goes on where a run broke off."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

from ..sources.datasets import Pipeline, read_frames
from ..work import delete
from . import jobs
from .control import Task, TaskStore

STAGES = ("extract", "compress", "build_index")


def stage_name(name: str) -> str:
    out = name.strip().lower().replace("-", "_")
    if out not in STAGES:
        raise ValueError(f"{name!r} is no stage; there are {', '.join(STAGES)}")
    return out


def seconds_left(tasks: list[Task], elapsed: float) -> float | None:
    """By the share of the work that is done, a running stage counting half; None before any is, 0 at the end."""
    units = sum({"completed": 1.0, "running": 0.5}.get(t.status, 0.0) for t in tasks)
    if units <= 0:
        return None
    return 0.0 if units >= len(tasks) else elapsed / units * (len(tasks) - units)


def human_bytes(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TiB"


class Orchestrator:
    """The stages of one configuration. frames_of reads a dataset's frames; it is a parameter so that other sources fit in."""

    def __init__(self, spark: SparkSession, config: Pipeline, frames_of=read_frames) -> None:
        self.spark, self.config, self.frames_of = spark, config, frames_of
        self.store = TaskStore(config.pipeline_db)

    def _prepare(self) -> None:
        for s in STAGES:
            self.store.create(s)
        if self.store.metadata("run_started") is None:
            self.store.set_metadata("run_started", time.time())

    def run(self) -> dict:
        """Runs what is not done; an index that lacks records counts as not done."""
        self._prepare()
        for s in STAGES:
            if self.store.get(s).status != "completed" or (s == "build_index" and jobs.index_is_behind(self.spark, self.config.compression, self.config.index)):
                self._run(s)
        return self.status()

    def run_stage(self, name: str) -> dict:
        """Runs one stage; if it was completed, it and those after it start afresh."""
        s = stage_name(name)
        self._prepare()
        if self.store.get(s).status == "completed":
            for later in STAGES[STAGES.index(s) :]:
                self.store.update(later, "pending")
                self.store.set_checkpoint(later, None)
                self._clear(later)
        self._run(s)
        return self.status()

    def _clear(self, stage: str) -> None:
        c = self.config
        made: dict[str, list[str]] = {
            "extract": [c.extraction.output_dir / "tokens", c.extraction.output_dir / "metadata"],
            "compress": [c.compression.output_dir / "records", c.compression.shard_dir, c.compression.model_dir, c.compression.catalog_path],
            "build_index": [c.index.output_path],
        }
        for p in made[stage]:
            delete(self.spark, str(p))

    def _execute(self, stage: str) -> str:
        c = self.config
        if stage == "extract":
            return str(jobs.run_extraction(self.spark, c.datasets, c.extraction, self.frames_of))
        if stage == "compress":
            return str(jobs.run_compression(self.spark, c.compression))
        jobs.run_index(self.spark, c.compression, c.index)
        return self.store.checkpoint("compress") or "-1"

    def _run(self, stage: str) -> None:
        self.store.update(stage, "running")
        began = time.perf_counter()
        try:
            self.store.set_checkpoint(stage, self._execute(stage))
            self.store.update(stage, "completed")
            self.store.set_metadata("last_stage", stage)
        except Exception as error:
            self.store.retry(stage)
            self.store.update(stage, "failed", str(error))
            raise
        finally:
            self.store.set_metadata(f"{stage}:seconds", round(time.perf_counter() - began, 3))

    def status(self) -> dict:
        self._prepare()
        tasks = [self.store.get(s) for s in STAGES]
        elapsed = time.time() - float(self.store.metadata("run_started"))
        clips = jobs.processed_clips(self.spark, self.config, self.store.checkpoint("extract"))
        return {"tasks": [vars(t) for t in tasks], "clips": clips, "seconds_left": seconds_left(tasks, elapsed)}

    def validate(self) -> dict:
        return jobs.validate(self.spark, self.config)
