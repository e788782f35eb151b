"""Binary shards: a fixed header and clip records of fixed size, read through Spark's file readers and written by a Python data source.

Fixed values of the format: the header is 32 bytes, little-endian, 8 bytes of magic and six unsigned 32-bit
numbers (clips, tokens per clip, dimensions, residual bytes per token, coarse dimensions, record size); a record is the
tokens' centroid ids (unsigned 16-bit), their packed residuals, and the coarse vector (32-bit floats).
The magic is a parameter: give the 8 bytes that your files start with.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

HEADER = struct.Struct("<8s6I")
MAGIC = b"CQSHARD1"
SUFFIX = ".shard"
RECORDS = "shard_id long, shard_offset long, centroid_ids array<int>, residuals binary, coarse_vector array<float>"


def record_size(tokens: int, residual_bytes: int, coarse_dim: int) -> int:
    return tokens * 2 + tokens * residual_bytes + coarse_dim * 4


@dataclass(frozen=True)
class Header:
    clips: int
    tokens: int
    width: int
    residual_bytes: int
    coarse_dim: int
    size: int

    def __post_init__(self) -> None:
        if self.clips < 0 or min(self.tokens, self.width, self.residual_bytes, self.coarse_dim) <= 0:
            raise ValueError("a shard's header has positive sizes")
        if self.size != record_size(self.tokens, self.residual_bytes, self.coarse_dim):
            raise ValueError(f"a record of {self.size} bytes does not fit the header's other sizes")

    @property
    def layout(self) -> np.dtype:
        return np.dtype([("ids", "<u2", (self.tokens,)), ("residuals", "u1", (self.tokens, self.residual_bytes)), ("coarse", "<f4", (self.coarse_dim,))])


def read_header(data: bytes, magic: bytes = MAGIC) -> Header:
    if len(data) < HEADER.size:
        raise ValueError("a shard is shorter than its header")
    found, *sizes = HEADER.unpack_from(data)
    if found != magic:
        raise ValueError(f"a shard starts with {found!r}, not {magic!r}")
    return Header(*sizes)


def decode(data: bytes, magic: bytes = MAGIC) -> np.ndarray:
    """The records of a shard, as a structured array."""
    head = read_header(data, magic)
    if len(data) != HEADER.size + head.clips * head.size:
        raise ValueError("a shard's length does not fit its header")
    return np.frombuffer(data, head.layout, head.clips, HEADER.size)


def encode(ids: np.ndarray, residuals: np.ndarray, coarse: np.ndarray, magic: bytes = MAGIC) -> bytes:
    """A shard of (clips, tokens) ids, (clips, tokens, bytes) residuals and (clips, dimensions) coarse vectors."""
    if not len(ids):
        raise ValueError("a shard holds at least one clip")
    if not len(ids) == len(residuals) == len(coarse) or residuals.shape[:2] != ids.shape:
        raise ValueError("all clips of a shard have the same shape")
    n, tokens = ids.shape
    head = Header(n, tokens, residuals.shape[2] * 4, residuals.shape[2], coarse.shape[1], record_size(tokens, residuals.shape[2], coarse.shape[1]))
    rows = np.empty(n, head.layout)
    rows["ids"], rows["residuals"], rows["coarse"] = ids, residuals, coarse
    return HEADER.pack(magic, head.clips, head.tokens, head.width, head.residual_bytes, head.coarse_dim, head.size) + rows.tobytes()


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    number = F.regexp_extract("path", r"shard_(\d+)" + re.escape(suffix) + "$", 1)
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).where(number != "").withColumn("shard_id", number.cast("long"))


def headers(spark: SparkSession, path: str, suffix: str = SUFFIX, magic: bytes = MAGIC) -> DataFrame:
    """(shard_id, clips, tokens, width, residual_bytes, coarse_dim, size): what the headers say, with columns only."""
    rows = _files(spark, path, suffix).select("shard_id", F.substring("content", 1, HEADER.size).alias("h"))
    if rows.isEmpty():
        raise FileNotFoundError(f"no shards in {path}")
    good = F.when(F.substring("h", 1, 8) == F.lit(magic), F.lit(True)).otherwise(F.raise_error(F.lit("a shard has another magic")).cast("boolean"))
    number = lambda i: F.conv(F.concat(*[F.hex(F.substring("h", 9 + 4 * i + b, 1)) for b in (3, 2, 1, 0)]), 16, 10).cast("long")
    names = ("clips", "tokens", "width", "residual_bytes", "coarse_dim", "size")
    return rows.where(good).select("shard_id", *[number(i).alias(n) for i, n in enumerate(names)])


def read(spark: SparkSession, path: str, suffix: str = SUFFIX, magic: bytes = MAGIC) -> DataFrame:
    """All records below path, one row each. A shard is read whole by one task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(RECORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = decode(data, magic)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(rows)), pa.array(range(len(rows))), pa.array(rows["ids"].astype(np.int32).tolist(), schema.field(2).type), pa.array([x.tobytes() for x in rows["residuals"]], pa.binary()), pa.array(rows["coarse"].tolist(), schema.field(4).type)],
                    schema=schema,
                )

    files = _files(spark, path, suffix).select("shard_id", "content")
    if files.isEmpty():
        raise FileNotFoundError(f"no shards in {path}")
    return files.mapInArrow(run, RECORDS)


def fetch(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records at (shard_id, shard_offset) of wanted; an error if one is not there. wanted is a few rows."""
    met = wanted.select("shard_id", "shard_offset").join(records, ["shard_id", "shard_offset"], "left")
    there = F.when(F.col("residuals").isNull(), F.raise_error(F.lit("a record is outside its shard")).cast("binary")).otherwise(F.col("residuals"))
    return met.withColumn("residuals", there)


def file_system(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        fs, at = FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    else:
        fs, at = LocalFileSystem(), path
    return fs, at.rstrip("/")


class ShardSource(DataSource):
    """``df.write.format("clip_shards").mode("append").save(folder)``: rows of one shard must lie in one partition, in order.

    The folder is one that all executors reach: a path that they share, or a URI (``hdfs://``, ``s3://``, ``gs://``, ``file://``) of a file system that Arrow opens. Each shard is written beside its place and
    renamed when all are there.
    """

    @classmethod
    def name(cls) -> str:
        return "clip_shards"

    def schema(self) -> str:
        return RECORDS

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.magic = options.get("magic", MAGIC.decode()).encode()
        self.suffix = options.get("suffix", SUFFIX)

    def write(self, rows) -> _Written:
        """Rows come shard by shard; one shard is held at a time."""
        fs, folder = file_system(self.path)
        fs.create_dir(folder, recursive=True)
        out = []
        for shard, group in groupby(rows, lambda r: r["shard_id"]):
            found = sorted(group, key=lambda r: r["shard_offset"])
            widths = {len(r["centroid_ids"]) for r in found}
            if len(widths) != 1:
                raise ValueError("all clips of a shard have the same number of tokens")
            ids = np.array([r["centroid_ids"] for r in found])
            residuals = np.array([np.frombuffer(r["residuals"], np.uint8).reshape(ids.shape[1], -1) for r in found])
            data = encode(ids, residuals, np.array([r["coarse_vector"] for r in found], np.float32), self.magic)
            final = f"{folder}/shard_{shard:06d}{self.suffix}"
            temporary = f"{final}.{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(temporary) as f:
                f.write(data)
            out.append((temporary, final))
        return _Written(out)

    def commit(self, messages) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            for temporary, final in m.files if m else ():
                if fs.get_file_info(final).type != FileType.NotFound:
                    fs.delete_file(final)
                fs.move(temporary, final)

    def abort(self, messages) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            for temporary, _ in m.files if m else ():
                if fs.get_file_info(temporary).type != FileType.NotFound:
                    fs.delete_file(temporary)


def write(records: DataFrame, path: str, magic: bytes = MAGIC, suffix: str = SUFFIX) -> None:
    """Records (the columns of RECORDS) as one file per shard."""
    spark = records.sparkSession
    spark.dataSource.register(ShardSource)
    rows = records.select(*[c.split()[0] for c in RECORDS.split(", ")]).repartition("shard_id").sortWithinPartitions("shard_id", "shard_offset")
    rows.write.format("clip_shards").option("magic", magic.decode()).option("suffix", suffix).mode("append").save(path)


def sizes(spark: SparkSession, *paths: str) -> list[tuple[str, int]]:
    """Bytes under each path, 0 where there is nothing; through the file system that the path belongs to."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        out.append((p, fs.getContentSummary(at).getLength() if fs.exists(at) else 0))
    return out
