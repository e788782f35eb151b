"""Dataset and pipeline configuration in YAML, and the frame tables that datasets are."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clips import ClipSpec, nested
from ..work import passing, work_dir
from .images import load

#: A frame as the operators take it. Declared, never inferred: a batch without any instruction must not lose the column.
FRAME_SCHEMA = T.StructType([
    T.StructField("episode_index", T.LongType(), False),
    T.StructField("frame_index", T.LongType()),
    T.StructField("image", T.BinaryType()),
    T.StructField("language", T.StringType()),
    T.StructField("arrival_seq", T.LongType(), False),
])


def read_mapping(path: Path) -> dict:
    raw = yaml.safe_load(Path(path).read_text()) or {}
    if not isinstance(raw, dict):
        raise TypeError(f"{path} holds {type(raw).__name__}, not a mapping")
    return raw


def _checked(cls, raw: dict):
    unknown = set(raw) - {f.name for f in fields(cls)}
    if unknown:
        raise ValueError(f"unknown settings for {cls.__name__}: {sorted(unknown)}")
    return cls(**raw)


@dataclass(frozen=True)
class Dataset:
    """One source of frames. image_key and language_key are dotted paths.

    path is where its frames lie, in a format that Spark reads. A remote or iterable source is a plug-in: source is ``module:attribute`` of a function that takes
    the session and the dataset and returns its frames, as a DataFrame or as an iterable of mappings, in order.
    """

    repo_id: str
    image_key: str
    source_fps: float
    target_fps: float = 4.0
    robot_type: str = "unknown"
    language_key: str | None = None
    clip_length: int = 64
    clip_stride: int = 32
    path: str | None = None
    format: str = "parquet"
    source: str | None = None

    def __post_init__(self) -> None:
        if not self.repo_id or not self.image_key:
            raise ValueError("a dataset has a repo_id and an image_key")
        _ = self.spec

    @property
    def spec(self) -> ClipSpec:
        return ClipSpec(self.repo_id, self.robot_type, float(self.source_fps), float(self.target_fps), self.clip_length, self.clip_stride)

    @classmethod
    def from_yaml(cls, path: Path) -> Dataset:
        return _checked(cls, read_mapping(path))

    def frames(self, source: DataFrame) -> DataFrame:
        """source with its keys resolved: the columns of FRAME_SCHEMA."""
        language = nested(source, self.language_key).cast("string") if self.language_key else F.lit(None).cast("string")
        frame = F.col("frame_index").cast("long") if "frame_index" in source.columns else F.lit(None).cast("long")
        return source.select(F.col("episode_index").cast("long").alias("episode_index"), frame.alias("frame_index"), nested(source, self.image_key).alias("image"), language.alias("language"), F.col("arrival_seq").cast("long").alias("arrival_seq"))


def load_all(directory: Path) -> list[Dataset]:
    """The datasets of all .yaml and .yml files of a directory, in the order of their paths."""
    return [Dataset.from_yaml(p) for p in sorted(Path(directory).iterdir()) if p.suffix in (".yaml", ".yml") and p.is_file()]


class Place(str):
    """A folder as a string, local or a URI of any file system that Spark knows; ``/`` goes into it."""

    def __truediv__(self, name: str) -> Place:
        return Place(f"{self.rstrip('/')}/{name}")


@dataclass(frozen=True)
class Extraction:
    encoder: str = ""
    processor: str = ""
    device: str = "cpu"
    batch_size: int = 1
    flush_size: int = 100
    output_dir: Place = Place(".")


@dataclass(frozen=True)
class Compression:
    raw_dir: Place = Place(".")
    output_dir: Place = Place(".")
    sample_size: int = 500_000
    width: int = 128
    n_centroids: int = 32_768
    seed: int = 0

    @property
    def model_dir(self) -> Place:
        return self.output_dir / "model"

    @property
    def shard_dir(self) -> Place:
        return self.output_dir / "shards"

    @property
    def catalog_path(self) -> Place:
        return self.output_dir / "clips"


@dataclass(frozen=True)
class IndexSettings:
    output_path: Place = Place(".")
    lists: int = 64
    probes: int = 16


@dataclass(frozen=True)
class Serving:
    data_dir: Place = Place(".")
    host: str = "127.0.0.1"
    port: int = 8000
    encoder: str = ""
    model_id: str = ""
    device: str = "cpu"
    max_concurrent_queries: int | None = None

    @property
    def places(self) -> int:
        """Queries that may encode at once: as set, or one on a GPU and one per core elsewhere."""
        return self.max_concurrent_queries or (1 if self.device == "cuda" else max(1, os.cpu_count() or 1))

    def __post_init__(self) -> None:
        if self.device not in ("cpu", "cuda"):
            raise ValueError("the device is cpu or cuda")
        if not 1 <= self.port <= 65_535 or (self.max_concurrent_queries is not None and self.max_concurrent_queries <= 0):
            raise ValueError("the port lies in 1 to 65535, and concurrent queries are positive")


@dataclass(frozen=True)
class Pipeline:
    """All settings. Relative paths are taken from the file's folder; directories that are not named lie under output_dir."""

    datasets: list[Dataset]
    output_dir: Place
    pipeline_db: Path
    extraction: Extraction = field(default_factory=Extraction)
    compression: Compression = field(default_factory=Compression)
    index: IndexSettings = field(default_factory=IndexSettings)
    serving: Serving = field(default_factory=Serving)

    @classmethod
    def from_yaml(cls, path: Path) -> Pipeline:
        path = Path(path)
        raw, base = read_mapping(path), path.parent
        if "datasets" not in raw:
            raise KeyError("datasets")
        file = lambda p: Path(p) if Path(p).is_absolute() else (base / p).resolve()
        at = lambda p: Place(p) if "://" in str(p) else Place(file(p))
        out = at(raw.get("output_dir", base.parent / "artifacts" / "pipeline"))
        part = lambda name: dict(raw.get(name) or {})
        e, c, i, s = part("extraction"), part("compression"), part("index"), part("serving")
        e["output_dir"] = at(e.get("output_dir", out / "extraction"))
        c["raw_dir"] = at(c.get("raw_dir", e["output_dir"]))
        c["output_dir"] = at(c.get("output_dir", out / "compression"))
        i["output_path"] = at(i.get("output_path", c["output_dir"] / "index"))
        s["data_dir"] = at(s.get("data_dir", c["output_dir"]))
        s.setdefault("encoder", e.get("encoder", ""))
        sets = [Dataset.from_yaml(file(p)) for p in raw["datasets"]]
        if not sets:
            raise ValueError("a pipeline has at least one dataset")
        # The task store is a local file of the driver, also where the output is not.
        db = file(raw.get("pipeline_db", (base if "://" in out else Path(out)) / "checkpoints" / "pipeline.sqlite3"))
        return cls(sets, out, db, _checked(Extraction, e), _checked(Compression, c), _checked(IndexSettings, i), _checked(Serving, s))


#: Frames of an iterable that the driver holds at a time.
CHUNK = 1024


def landed(spark: SparkSession, samples: Iterable[Mapping], dataset: Dataset) -> DataFrame:
    """The frames of an iterable, written to the shared folder in chunks as they come; arrival_seq is their place in it."""
    path = passing(spark, f"{work_dir(spark)}/frames/{uuid.uuid4().hex}")
    rows, at = [], 0

    def flush() -> None:
        spark.createDataFrame(rows, FRAME_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        rows.clear()

    for at, sample in enumerate(samples):
        image = picked(sample, dataset.image_key)
        frame, words = sample.get("frame_index"), picked(sample, dataset.language_key) if dataset.language_key else None
        rows.append((int(sample["episode_index"]), None if frame is None else int(frame), None if image is None else bytearray(image), None if words is None else str(words), at))
        if len(rows) == CHUNK:
            flush()
    if rows or not at:
        flush()
    return spark.read.schema(FRAME_SCHEMA).parquet(path)


def picked(sample: Mapping, key: str):
    """The value at a dotted path of nested mappings; a flat key of that very name comes first."""
    if key in sample:
        return sample[key]
    found = sample
    for part in key.split("."):
        if not isinstance(found, Mapping) or part not in found:
            raise KeyError(key)
        found = found[part]
    return found


def read_frames(spark: SparkSession, dataset: Dataset) -> DataFrame:
    if dataset.source:
        made = load(dataset.source)(spark, dataset)
        return dataset.frames(made) if isinstance(made, DataFrame) else landed(spark, made, dataset)
    if not dataset.path:
        raise ValueError(f"{dataset.repo_id} has neither path nor source")
    return dataset.frames(spark.read.format(dataset.format).load(dataset.path))
