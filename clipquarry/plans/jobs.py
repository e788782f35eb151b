"""The offline jobs: frames to tokens, tokens to compressed shards and catalog, catalog to index, and a validation report.

Every job is incremental. Output is keyed by batch, so a batch that is run again replaces itself, and what is there
already is found by listing, not by trusting a counter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import clips, compress, index, numbering, search
from ..operators import tokens as tok
from ..sources import shards
from ..sources.datasets import Compression, Dataset, Extraction, IndexSettings, Pipeline, Place, read_frames
from ..sources.images import load, model_of
from ..work import saved

CLIPS_PER_SHARD = 100


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(str(path))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def numbered_clips(spark: SparkSession, datasets: list[Dataset], frames_of=read_frames) -> tuple[DataFrame, DataFrame]:
    """(catalog, slots): all datasets' clips, numbered in the order of the datasets, and the frames of each clip (clip_index, slot, image)."""
    every = slots = None
    for at, d in enumerate(datasets):
        frames = clips.streamed_episodes(frames_of(spark, d))
        own = clips.clips(frames, d.spec, "run").join(frames.groupBy("run").agg(F.first("episode_index").alias("e")), "run")
        own = own.withColumn("episode_id", F.concat_ws("_", F.lit(d.repo_id), "e")).withColumn("dataset_at", F.lit(at)).drop("e")
        every = own if every is None else every.unionByName(own)
        kept = clips.resampled(frames, "run", d.spec)
        windows = clips.windows(kept, "run", d.spec, frames=True)
        pictures = windows.join(frames.select("run", "arrival_seq", "image"), ["run", "arrival_seq"]).select(F.lit(at).alias("dataset_at"), "run", "window", "slot", "image")
        slots = pictures if slots is None else slots.unionByName(pictures)
    catalog = numbering.global_index(every, ["dataset_at", "run", "window"], "clip_index")
    slots = slots.join(catalog.select("clip_index", "dataset_at", "run", "window"), ["dataset_at", "run", "window"]).select("clip_index", "slot", "image")
    return catalog.drop("dataset_at", "run", "window"), slots


def features_of(output) -> np.ndarray:
    """The array in what an encoder returns: the first of a tuple, last_hidden_state or vision_features of a mapping or an object, or the output itself; as 32-bit floats."""
    if isinstance(output, tuple):
        output = output[0]
    for name in ("last_hidden_state", "vision_features"):
        if isinstance(output, Mapping):
            if name in output:
                output = output[name]
                break
        elif hasattr(output, name):
            output = getattr(output, name)
            break
    if isinstance(output, Mapping):
        raise ValueError(f"an encoder's mapping has last_hidden_state or vision_features, not {sorted(output)}")
    for step in ("detach", "cpu", "float"):  # a tensor on a device, of any precision
        if hasattr(output, step):
            output = getattr(output, step)()
    return np.asarray(output, np.float32)


def prepared(processor, images: list):
    """What a video processor makes of a clip's images: its pixel_values (or pixel_values_videos), without a batch dimension of one. Without a processor, the images."""
    if processor is None:
        return images
    made = processor(images)
    if isinstance(made, Mapping):
        for name in ("pixel_values", "pixel_values_videos"):
            if made.get(name) is not None:
                made = made[name]
                break
        else:
            raise ValueError("a processor's mapping has pixel_values or pixel_values_videos")
    made = np.asarray(made)
    return made[0] if made.ndim == 5 and len(made) == 1 else made


def encoded(slots: DataFrame, encoder: str, batch_size: int = 1, processor: str = "", device: str = "cpu") -> DataFrame:
    """(clip_index, token_pos, vec): what the encoder makes of each clip's images.

    encoder is ``module:attribute`` of a function that returns, once per worker, a model: lists of clips to an array (clips, tokens, dimensions), or to what
    features_of() unwraps. If the function takes a device, it gets it, and as dtype float32 on a CPU and float16 elsewhere. processor, if it is given, is
    ``module:attribute`` of a function that returns what prepared() calls on each clip's images.
    """
    whole = slots.groupBy("clip_index").agg(F.array_sort(F.collect_list(F.struct("slot", "image"))).alias("x"))
    whole = whole.select("clip_index", F.transform("x", lambda x: x["image"]).alias("images"))
    schema = pa.schema([("clip_index", pa.int64()), ("token_pos", pa.int32()), ("vec", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(encoder, device)
        process = load(processor)() if processor else None
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                out = features_of(model([prepared(process, x) for x in part.column(1).to_pylist()]))
                if out.ndim != 3 or len(out) != part.num_rows:
                    raise ValueError("an encoder returns clips x tokens x dimensions")
                n, t, _ = out.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), t)), pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(list(out.reshape(n * t, -1)), schema.field(2).type)], schema=schema)

    return whole.mapInArrow(run, "clip_index long, token_pos int, vec array<float>")


def run_extraction(spark: SparkSession, datasets: list[Dataset], settings: Extraction, frames_of=read_frames) -> int:
    """Writes tokens and metadata by batch of flush_size clips; batches with both are skipped. Returns the last clip's number, or -1."""
    catalog, slots = numbered_clips(spark, datasets, frames_of)
    out = settings.output_dir
    batch = F.expr(f"clip_index div {int(settings.flush_size)}")
    catalog = catalog.withColumn("batch_id", batch)
    wanted = catalog.groupBy("batch_id").agg(F.count("*").alias("n"))
    done = read_if_there(spark, out / "metadata")
    have = read_if_there(spark, out / "tokens")
    todo = wanted
    if done is not None and have is not None:
        full = done.groupBy("batch_id").agg(F.count("*").alias("n")).join(have.select("batch_id").distinct(), "batch_id")
        todo = wanted.join(full, ["batch_id", "n"], "left_anti")
    # Saved, as what is written next is where the finished batches were read.
    todo = saved(todo.select("batch_id"))
    if not todo.isEmpty():
        left = catalog.join(todo, "batch_id", "left_semi")
        # The clips to do are chosen before any image is encoded.
        images = slots.join(left.select("clip_index"), "clip_index", "left_semi")
        made = encoded(images, settings.encoder, settings.batch_size, settings.processor, settings.device).withColumn("batch_id", batch)
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(str(out / "tokens"))
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(str(out / "metadata"))
    last = catalog.agg(F.max("clip_index")).first()[0]
    return -1 if last is None else int(last)


def raw_batches(spark: SparkSession, raw_dir: Place) -> DataFrame:
    """(batch_id, first_clip, last_clip, clips): the batches that have both tokens and metadata; an error if one lacks a side."""
    metadata, tokens = read_if_there(spark, raw_dir / "metadata"), read_if_there(spark, raw_dir / "tokens")
    if metadata is None or tokens is None:
        raise FileNotFoundError(f"no batches in {raw_dir}")
    lone = tokens.select("batch_id").distinct().join(metadata.select("batch_id").distinct(), "batch_id", "left_anti")
    if not lone.isEmpty():
        raise FileNotFoundError(f"batch {lone.first()[0]} has no metadata")
    return metadata.groupBy("batch_id").agg(F.min("clip_index").alias("first_clip"), F.max("clip_index").alias("last_clip"), F.count("*").alias("clips")).orderBy("batch_id")


def run_compression(spark: SparkSession, settings: Compression) -> int:
    """Fits the model once, compresses the batches that have no shard, and writes the catalog anew. Returns the last shard's number."""
    batches = raw_batches(spark, settings.raw_dir)
    tokens = spark.read.parquet(str(settings.raw_dir / "tokens")).select("clip_index", "token_pos", "vec", "batch_id")
    if read_if_there(spark, settings.model_dir) is None:
        sample = compress.sampled(tokens.withColumn("pos", F.concat_ws(":", "clip_index", "token_pos")), settings.sample_size, settings.seed, batch="batch_id")
        compress.fit(sample, settings.width, settings.n_centroids, settings.seed).save(spark, str(settings.model_dir))
    model = compress.Model.load(spark, str(settings.model_dir))
    done = read_if_there(spark, settings.output_dir / "records")
    todo = batches if done is None else batches.join(done.groupBy(F.col("shard_id").alias("batch_id")).agg(F.count("*").alias("clips")), ["batch_id", "clips"], "left_anti")
    todo = saved(todo.select("batch_id"))
    if not todo.isEmpty():
        rows = tokens.join(todo, "batch_id", "left_semi").withColumnRenamed("clip_index", "clip_id")
        known = rows.select("clip_id", F.col("batch_id").alias("shard_id")).distinct()
        first = batches.select(F.col("batch_id").alias("shard_id"), "first_clip")
        made = compress.clip_records(rows, model).join(known, "clip_id").join(first, "shard_id")
        made = made.select("clip_id", (F.col("clip_id") - F.col("first_clip")).alias("shard_offset"), "centroid_ids", "residuals", F.col("coarse_vector").cast("array<float>").alias("coarse_vector"), "shard_id")
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard_id").parquet(str(settings.output_dir / "records"))
        shards.write(made, str(settings.shard_dir))
    metadata = spark.read.parquet(str(settings.raw_dir / "metadata")).join(batches.select("batch_id", "first_clip"), "batch_id")
    catalog = metadata.withColumn("shard_offset", F.col("clip_index") - F.col("first_clip")).withColumnRenamed("batch_id", "shard_id").withColumn("clip_id", F.col("clip_index")).drop("first_clip")
    catalog.write.mode("overwrite").parquet(str(settings.catalog_path))
    last = batches.agg(F.max("batch_id")).first()[0]
    return -1 if last is None else int(last)


def coarse_vectors(spark: SparkSession, output_dir: Place) -> DataFrame:
    """(clip_id, coarse) of all shards; only that column is read."""
    records = read_if_there(spark, output_dir / "records")
    if records is None:
        raise FileNotFoundError(f"no records in {output_dir}")
    return records.select("clip_id", F.col("coarse_vector").cast("array<double>").alias("coarse"))


def run_index(spark: SparkSession, compression: Compression, settings: IndexSettings) -> index.Index:
    """Builds the index anew and records its recall, by which searches decide whether to use it."""
    vectors = coarse_vectors(spark, compression.output_dir)
    n = vectors.count()
    lists = min(settings.lists, n)
    built = index.Index.build(vectors, str(settings.output_path), lists, min(settings.probes, lists))
    index.record(spark, built.path, built.probes, index.measured(built, vectors), n)
    return built


def index_is_behind(spark: SparkSession, compression: Compression, settings: IndexSettings) -> bool:
    """Whether there are records that the index does not hold."""
    known = index.recorded(spark, str(settings.output_path))
    return known is None or known[2] != coarse_vectors(spark, compression.output_dir).count()


def token_table(spark: SparkSession, compression: Compression, clip_ids: DataFrame | None = None) -> DataFrame:
    """(clip_id, tokens): the decompressed tokens of the clips asked for, as arrays in order."""
    model = compress.Model.load(spark, str(compression.model_dir))
    records = spark.read.parquet(str(compression.output_dir / "records"))
    if clip_ids is not None:
        records = records.join(F.broadcast(clip_ids.select("clip_id")), "clip_id")  # a search's coarse_k rows
    width = model.width // 4
    each = records.select("clip_id", F.posexplode("centroid_ids").alias("token_pos", "centroid_id"), "residuals")
    each = each.withColumn("packed", F.hex(F.substring(F.col("residuals"), F.col("token_pos") * width + 1, F.lit(width))))
    return tok.gathered(compress.decompressed(each.drop("residuals"), model))


def validate(spark: SparkSession, config: Pipeline, clips_sampled: int = 100) -> dict:
    """Recall, reconstruction, three sample queries with five results each, and sizes."""
    c = config.compression
    vectors = coarse_vectors(spark, c.output_dir)
    recall = index.validate(index.Index.open(spark, str(config.index.output_path), config.index.probes), vectors)
    model = compress.Model.load(spark, str(c.model_dir))
    sample = compress.uniform_sample(vectors.select("clip_id"), clips_sampled)
    raw = spark.read.parquet(str(c.raw_dir / "tokens")).withColumnRenamed("clip_index", "clip_id").join(F.broadcast(sample), "clip_id")  # clips_sampled rows
    cosine, n = compress.fidelity(raw, model).agg(F.avg("cosine"), F.count("*")).first()
    if n < sample.count():
        raise KeyError("a sampled clip has no raw tokens")
    asked = compress.uniform_sample(vectors, 3).withColumnsRenamed({"clip_id": "query_id", "coarse": "vec"})
    near = search.knn_join(asked, vectors.withColumnRenamed("coarse", "vec"), 5).orderBy("query_id", "rank").collect()  # 15 rows
    queries: dict[int, list] = {}
    for r in near:
        queries.setdefault(r["query_id"], []).append({"clip_id": r["clip_id"], "score": r["score"]})
    paths = [str(p) for p in (config.extraction.output_dir, c.model_dir, c.shard_dir, c.catalog_path, config.index.output_path)]
    return {"recall": recall, "mean_cosine": float(cosine), "sampled_clips": int(n), "sample_queries": queries, "sizes": dict(shards.sizes(spark, *paths))}


def processed_clips(spark: SparkSession, config: Pipeline, checkpoint: str | None) -> int:
    """Clips done so far: of the catalog, or else of the raw metadata, or else by the extraction's checkpoint."""
    for path in (config.compression.catalog_path, config.extraction.output_dir / "metadata"):
        rows = read_if_there(spark, path)
        if rows is not None:
            return rows.count()
    return int(checkpoint) + 1 if checkpoint is not None else 0


def as_json(report: dict) -> str:
    return json.dumps(report, default=str, sort_keys=True)
