"""``python -m clipquarry.plans.cli COMMAND --config FILE``"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from ..operators.tokens import Grid
from ..sources.datasets import Pipeline
from ..sources.images import load, model_of
from . import jobs
from .orchestrator import Orchestrator, human_bytes

COMMANDS = {"run": "all stages that are not done", "extract": "frames to tokens", "compress": "tokens to shards and catalog", "build-index": "catalog to index", "serve": "answer searches", "status": "where the stages stand", "validate": "recall, reconstruction, samples, sizes"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description="Build and search a clip index.")
    sub = out.add_subparsers(dest="command", required=True)
    for name, text in COMMANDS.items():
        sub.add_parser(name, help=text).add_argument("--config", type=Path, default=Path("config/pipeline.yaml"))
    return out


def show_status(status: dict) -> None:
    for t in status["tasks"]:
        print(f"{t['task_name']}: {t['status']}, {t['retry_count']} retries" + (f", {t['error_message']}" if t["error_message"] else ""))
    left = status["seconds_left"]
    print(f"{status['clips']} clips" + (f", about {left:.0f} s left" if left is not None else ""))


def show_report(report: dict) -> None:
    print(f"recall {report['recall']:.4f}, mean cosine {report['mean_cosine']:.4f} over {report['sampled_clips']} clips")
    for q, hits in report["sample_queries"].items():
        print(f"clip {q}: " + ", ".join(f"{h['clip_id']} ({h['score']:.3f})" for h in hits))
    for path, n in report["sizes"].items():
        print(f"{path}: {human_bytes(n)}")


def start() -> SparkSession:
    return SparkSession.builder.appName("clipquarry").getOrCreate()


def main(argv: list[str] | None = None, make: Callable[[Path], Orchestrator] | None = None) -> int:
    args = parser().parse_args(argv)
    work = make(args.config) if make else Orchestrator(start(), Pipeline.from_yaml(args.config))
    if args.command == "run":
        show_status(work.run())
    elif args.command in ("extract", "compress", "build-index"):
        show_status(work.run_stage(args.command))
    elif args.command == "status":
        show_status(work.status())
    elif args.command == "validate":
        show_report(work.validate())
    else:
        from .serve import Engine, Service, serve

        c = work.config
        model = model_of(c.serving.encoder, c.serving.device)
        processor = load(c.extraction.processor)() if c.extraction.processor else None
        length = c.datasets[0].clip_length
        encode = lambda image: jobs.features_of(model([jobs.prepared(processor, [image] * length)]))[0]
        engine = Engine(work.spark, c.compression, str(c.index.output_path), encode, Grid(), c.index.probes)
        serve(Service(engine, c.serving.places, c.serving.model_id, c.serving.device), c.serving)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
