"""The registered queries, each with the SQL that it must agree with (where SQL can say it)."""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clips, compress, index, numbering, search, trajectory
from ..operators import tokens as tok
from . import fixtures as fx
from .fixtures import BOX, GRID, SPEC, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

QUERY_CLIP, EPISODE, OTHER_CLIP = 0, "ep/0", 7


def query(name: str, oracle: str | None = None, recursive: bool = False):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE_SQL[name] = sql(oracle, recursive=recursive)
        return fn

    return add


r6 = lambda c: F.round(c, 6)


# Frames and clips


@query("episode_runs", """WITH x AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> episode_index THEN 1 ELSE 0 END) OVER (ORDER BY arrival_seq) AS run
    FROM (SELECT *, lag(episode_index) OVER (ORDER BY arrival_seq) AS p FROM v_frames))
    SELECT run::BIGINT AS run, any_value(episode_index) AS episode_index, count(*) AS frames, min(arrival_seq) AS first_seq FROM x GROUP BY run""")  # fmt: skip
def episode_runs(spark, sf):
    """Run-length episodes of a stream: S3."""
    runs = clips.streamed_episodes(fx.frames(spark, sf))
    return runs.groupBy("run").agg(F.first("episode_index").alias("episode_index"), F.count("*").alias("frames"), F.min("arrival_seq").alias("first_seq"))


@query("stream_ordinals", """WITH x AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> episode_index THEN 1 ELSE 0 END) OVER (ORDER BY arrival_seq) AS run
    FROM (SELECT *, lag(episode_index) OVER (ORDER BY arrival_seq) AS p FROM v_frames))
    SELECT arrival_seq, run::BIGINT AS run, row_number() OVER (PARTITION BY run ORDER BY arrival_seq) - 1 AS frame FROM x""")  # fmt: skip
def stream_ordinals(spark, sf):
    """Ordinals in place of missing frame numbers, reset by every run: S3, S4."""
    bare = fx.frames(spark, sf).withColumn("frame_index", F.lit(None).cast("long"))
    return clips.streamed_episodes(bare).select("arrival_seq", "run", "frame")


@query("indexed_scan", """WITH x AS (SELECT episode_index, arrival_seq, row_number() OVER (ORDER BY episode_index, arrival_seq) - 1 AS row FROM v_frames),
    g AS (SELECT episode_index AS e, min(row) AS f, max(row) + 1 AS t FROM x GROUP BY 1)
    SELECT e AS episode, arrival_seq, row - f AS frame FROM x JOIN g ON row >= f AND row < t""")  # fmt: skip
def indexed_scan(spark, sf):
    """Frames of episodes given as row ranges: S2, D1."""
    rows = numbering.global_index(fx.frames(spark, sf).withColumn("frame_index", F.lit(None).cast("long")), ["episode_index", "arrival_seq"], "row")
    ranges = rows.groupBy(F.col("episode_index").alias("episode")).agg(F.min("row").alias("from"), (F.max("row") + 1).alias("to"))
    return clips.indexed_episodes(rows, ranges).select("episode", "arrival_seq", "frame")


@query("ordered_frames", "SELECT episode_index, arrival_seq, row_number() OVER (PARTITION BY episode_index ORDER BY frame, arrival_seq) - 1 AS position FROM v_frames")
def ordered_frames(spark, sf):
    """Frames by number within their episode, stable: W3, D2."""
    return clips.ordered(fx.whole_frames(spark, sf), "episode_index").select("episode_index", "arrival_seq", "position")


@query("episode_language", "SELECT * FROM v_lang")
def episode_language(spark, sf):
    """The first instruction of each episode by arrival: A2."""
    return clips.language(fx.whole_frames(spark, sf), "episode_index")


@query("frame_relative_time", "SELECT arrival_seq, round(ts, 6) AS ts FROM v_timed")
def frame_relative_time(spark, sf):
    """Seconds since the episode's first frame: P4."""
    f = fx.whole_frames(spark, sf)
    first = F.min("frame").over(Window.partitionBy("episode_index"))
    return f.select("arrival_seq", r6((F.col("frame") - first) / F.lit(SPEC.source_fps)).alias("ts"))


@query("resampled_frames", "SELECT episode_index, target, frame, arrival_seq FROM v_kept")
def resampled_frames(spark, sf):
    """The frame nearest to each point of the target grid: J1."""
    return clips.resampled(fx.whole_frames(spark, sf), "episode_index", SPEC).select("episode_index", "target", "frame", "arrival_seq")


@query("clip_windows", "SELECT episode_index, j AS win, j * 32 AS start, least(64, n - j * 32) AS originals FROM v_windows")
def clip_windows(spark, sf):
    """Sliding windows over the resampled frames: W1, W2."""
    kept = clips.resampled(fx.whole_frames(spark, sf), "episode_index", SPEC)
    return clips.windows(kept, "episode_index", SPEC).select("episode_index", F.col("window").alias("win"), "start", "originals")


@query("padded_windows", """SELECT w.episode_index, j AS win, count(*) AS slots, sum(frame)::BIGINT AS frame_sum, max(frame) AS last_frame
    FROM (SELECT *, unnest(range(0, 64)) AS slot FROM v_windows) w JOIN v_kept k ON k.episode_index = w.episode_index AND k.target = j * 32 + least(slot, least(64, n - j * 32) - 1) GROUP BY ALL""")  # fmt: skip
def padded_windows(spark, sf):
    """The frames of each window, short ones padded with their last: W1, D4's rows."""
    kept = clips.resampled(fx.whole_frames(spark, sf), "episode_index", SPEC)
    slots = clips.windows(kept, "episode_index", SPEC, frames=True)
    return slots.groupBy("episode_index", F.col("window").alias("win")).agg(F.count("*").alias("slots"), F.sum("frame").alias("frame_sum"), F.max("frame").alias("last_frame"))


_CATALOG = """SELECT row_number() OVER (ORDER BY episode_index, win) - 1 AS clip_index, episode_id, dataset_name, robot_type, clip_start_frame, clip_end_frame,
    round(timestamp_start, 6) AS timestamp_start, round(timestamp_end, 6) AS timestamp_end, language_instruction, num_original_frames FROM v_catalog"""


@query("clip_catalog", _CATALOG)
def clip_catalog(spark, sf):
    """All clips, numbered over all episodes: P2, P3, P6, D3, I26."""
    found = clips.clips(fx.whole_frames(spark, sf), SPEC)
    numbered = numbering.global_index(found, ["episode_index", "window"], "clip_index").drop("episode_index", "window")
    return numbered.withColumns({c: r6(F.col(c)) for c in ("timestamp_start", "timestamp_end")})


@query("clip_resume", f"SELECT clip_index, episode_id FROM ({_CATALOG}) WHERE clip_index >= 100")
def clip_resume(spark, sf):
    """What a run that resumes at a clip still has to do: P5, I5."""
    return clip_catalog(spark, sf).where("clip_index >= 100").select("clip_index", "episode_id")


@query("nested_keys", """SELECT vec_id AS clip_id, CASE WHEN vec_id % 2 = 0 THEN 'flat' ELSE 'flat' END || vec_id AS flat_key, label AS nested_key, 'arm' || (label % 3) AS dataset_name FROM embeddings""")
def nested_keys(spark, sf):
    """A flat column wins over a nested field of the same path; a repository's short name: P1, P2."""
    e = fx.table(spark, sf, "embeddings").select("vec_id", F.struct(F.struct(F.col("label").alias("top")).alias("images")).alias("observation"), F.concat(F.lit("flat"), F.col("vec_id")).alias("observation.state"), F.concat(F.lit("hub/sub/arm"), F.col("label") % 3).alias("repo"))
    return e.select(F.col("vec_id").alias("clip_id"), clips.nested(e, "observation.state").alias("flat_key"), clips.nested(e, "observation.images.top").alias("nested_key"), clips.dataset_name(F.col("repo")).alias("dataset_name"))


# Catalog


@query("shard_catalog", "SELECT clip_id, shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY clip_id) - 1 AS shard_offset, row_number() OVER (ORDER BY shard_id, clip_id) - 1 AS position FROM v_clips")
def shard_catalog(spark, sf):
    """Shards put together, with offsets and positions that do not depend on file order: P7, P8, U1, D10, D11."""
    base = fx.catalog(spark, sf).drop("shard_offset")
    even, odd = base.where("shard_id % 2 = 0"), base.where("shard_id % 2 = 1")
    offset = F.row_number().over(Window.partitionBy("shard_id").orderBy("clip_id")) - 1
    rows = odd.unionByName(even).withColumn("shard_offset", offset.cast("long"))
    return numbering.global_index(rows, ["shard_id", "shard_offset"], "position").select("clip_id", "shard_id", "shard_offset", "position")


_DETAILS = """SELECT episode_id, arg_min(dataset_name, clip_id) AS dataset_name, arg_min(robot_type, clip_id) AS robot_type, count(*) AS clip_count, min(timestamp_start) AS timestamp_start,
    max(timestamp_end) AS timestamp_end, arg_min(language_instruction, clip_id) FILTER (language_instruction IS NOT NULL) AS language_instruction FROM v_clips GROUP BY episode_id"""


@query("episode_details", _DETAILS)
def episode_details(spark, sf):
    """All episodes: A1, D16."""
    return search.episode_details(fx.catalog(spark, sf))


@query("one_episode", f"SELECT * FROM ({_DETAILS}) WHERE episode_id = 'ep/3'")
def one_episode(spark, sf):
    """One episode by its id, which may hold a slash: P9, I17."""
    return search.episode_details(fx.catalog(spark, sf).where(F.col("episode_id") == "ep/3"))


@query("episode_lookup", "SELECT episode_id, arg_min(dataset_name, clip_id) AS dataset_name, arg_min(robot_type, clip_id) AS robot_type FROM v_clips GROUP BY episode_id")
def episode_lookup(spark, sf):
    """Each episode's first dataset and robot: J11."""
    return search.episode_lookup(fx.catalog(spark, sf))


@query("point_fetch", "SELECT clip_id, token_pos, round(list_sum(vec), 6) AS total FROM v_clips JOIN v_tokens USING (clip_id) WHERE (shard_id = 1 AND shard_offset = 5) OR (shard_id = 3 AND shard_offset = 42)")
def point_fetch(spark, sf):
    """Token rows of clips by shard and offset: S10, J4, J5, S12."""
    wanted = spark.createDataFrame([(1, 5), (3, 42)], "shard_id long, shard_offset long")
    ids = fx.catalog(spark, sf).join(F.broadcast(wanted), ["shard_id", "shard_offset"]).select("clip_id")  # two rows
    return fx.tokens(spark, sf).join(F.broadcast(ids), "clip_id").select("clip_id", "token_pos", r6(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("raw_lookup", """WITH p AS (SELECT vec_id AS clip_id FROM embeddings ORDER BY md5('0:' || vec_id), vec_id LIMIT 100)
    SELECT clip_id, printf('tokens_%08d_%08d', clip_id // 100 * 100, clip_id // 100 * 100 + 99) AS file, clip_id % 100 AS place FROM p""")  # fmt: skip
def raw_lookup(spark, sf):
    """File and offset of sampled clips; a clip without a file is an error: J10, T7, V21."""
    ids = compress.uniform_sample(fx.catalog(spark, sf).select("clip_id"), 100)
    files = fx.catalog(spark, sf).groupBy("shard_id").agg(F.min("clip_id").alias("first"))
    met = ids.join(files, F.expr("clip_id div 100") == F.col("shard_id"), "left")
    found = F.when(F.col("first").isNull(), F.raise_error(F.lit("a sampled clip is in no batch"))).otherwise(F.format_string("tokens_%08d_%08d", F.col("first"), F.col("first") + 99))
    return met.select("clip_id", found.alias("file"), (F.col("clip_id") - F.col("first")).alias("place"))


@query("batch_manifest", """SELECT printf('tokens_%08d_%08d', min(clip_id), max(clip_id)) AS file, min(clip_id) AS first_clip, max(clip_id) AS last_clip, count(*) AS clips, count(*) * 4 AS tokens,
    regexp_extract(printf('shard_%06d.bin', shard_id), 'shard_([0-9]+)', 1)::BIGINT AS shard FROM v_clips GROUP BY shard_id""")  # fmt: skip
def batch_manifest(spark, sf):
    """Batch files by name, with counts: S6, S7, A12, T8, V21."""
    name = F.format_string("tokens_%08d_%08d", F.min("clip_id"), F.max("clip_id"))
    out = fx.catalog(spark, sf).groupBy("shard_id").agg(name.alias("file"), F.min("clip_id").alias("first_clip"), F.max("clip_id").alias("last_clip"), F.count("*").alias("clips"), (F.count("*") * 4).alias("tokens"))
    return out.withColumn("shard", F.regexp_extract(F.format_string("shard_%06d.bin", "shard_id"), r"shard_([0-9]+)", 1).cast("long")).drop("shard_id")


@query("missing_siblings", "SELECT shard_id FROM (SELECT DISTINCT shard_id FROM v_clips) WHERE shard_id % 3 = 2")
def missing_siblings(spark, sf):
    """Token batches without their metadata: S6's check."""
    batches = fx.catalog(spark, sf).select("shard_id").distinct()
    return batches.join(batches.where("shard_id % 3 <> 2"), "shard_id", "left_anti")


@query("processed_clips", "SELECT count(*) AS clips, (SELECT max(clip_id) + 1 FROM v_clips) AS by_checkpoint FROM v_clips")
def processed_clips(spark, sf):
    """Clips done, by catalog and by checkpoint: A10."""
    return fx.catalog(spark, sf).agg(F.count("*").alias("clips"), (F.max("clip_id") + 1).alias("by_checkpoint"))


@query("checkpoint_upserts", "SELECT event_type AS key, arg_max(round(value, 6), event_id) AS value, count(*) AS writes FROM events GROUP BY event_type")
def checkpoint_upserts(spark, sf):
    """The last write of each key: S18, D18, D19."""
    return fx.table(spark, sf, "events").groupBy(F.col("event_type").alias("key")).agg(F.max_by(r6(F.col("value")), "event_id").alias("value"), F.count("*").alias("writes"))


_TASKS = "SELECT n_name AS task, CASE n_nationkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' WHEN 2 THEN 'pending' ELSE 'failed' END AS status, n_nationkey AS k FROM nation"


def _tasks(spark, sf):
    return fx.table(spark, sf, "nation").select(F.col("n_name").alias("task"), F.element_at(F.array(*map(F.lit, ("completed", "running", "pending", "failed"))), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("status"), F.col("n_nationkey").alias("k"))


@query("task_progress", f"""SELECT round(u, 6) AS units, round(u / n, 6) AS share, round(CASE WHEN u = 0 THEN NULL WHEN u = n THEN 0 ELSE 60.0::DOUBLE / u * (n - u) END, 6) AS eta
    FROM (SELECT sum(CASE status WHEN 'completed' THEN 1.0 WHEN 'running' THEN 0.5 ELSE 0 END)::DOUBLE AS u, count(*)::DOUBLE AS n FROM ({_TASKS}))""")  # fmt: skip
def task_progress(spark, sf):
    """Progress and time left, 60 s in: A11, I18."""
    unit = F.when(F.col("status") == "completed", 1.0).when(F.col("status") == "running", 0.5).otherwise(0.0)
    x = _tasks(spark, sf).agg(F.sum(unit).alias("u"), F.count("*").cast("double").alias("n"))
    eta = F.when(F.col("u") == 0, None).when(F.col("u") == F.col("n"), 0.0).otherwise(F.lit(60.0) / F.col("u") * (F.col("n") - F.col("u")))
    return x.select(r6(F.col("u")).alias("units"), r6(F.col("u") / F.col("n")).alias("share"), r6(eta).alias("eta"))


@query("pending_tasks", f"SELECT task, row_number() OVER (ORDER BY task) AS place FROM ({_TASKS}) WHERE status IN ('pending', 'failed')")
def pending_tasks(spark, sf):
    """What is still to do, by name: P15, T8."""
    todo = _tasks(spark, sf).where(F.col("status").isin("pending", "failed"))
    return todo.withColumn("place", F.row_number().over(Window.orderBy("task")).cast("long")).select("task", "place")  # a handful of tasks


@query("task_updates", f"""SELECT task, s AS status, CASE WHEN s = 'running' THEN 100 WHEN s = 'pending' THEN NULL ELSE k END AS started, CASE WHEN s = 'completed' THEN 100 END AS completed,
    CASE WHEN s = 'failed' THEN 'e' || k END AS error FROM (SELECT *, CASE (k + 1) % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' WHEN 2 THEN 'pending' ELSE 'failed' END AS s FROM ({_TASKS}))""")  # fmt: skip
def task_updates(spark, sf):
    """What a change of status does to times and errors: P16, I11."""
    s = F.element_at(F.array(*map(F.lit, ("completed", "running", "pending", "failed"))), ((F.col("k") + 1) % 4 + 1).cast("int"))
    x = _tasks(spark, sf).withColumn("status", s)
    started = F.when(F.col("status") == "running", 100).when(F.col("status") == "pending", None).otherwise(F.col("k"))
    return x.select("task", "status", started.cast("int").alias("started"), F.when(F.col("status") == "completed", 100).cast("int").alias("completed"), F.when(F.col("status") == "failed", F.concat(F.lit("e"), F.col("k"))).alias("error"))


@query("record_sizes", "SELECT p_partkey AS id, p_size * 2 + p_size * 32 + 512 AS record_size, 32 + 100 * (p_size * 2 + p_size * 32 + 512) AS shard_size FROM part")
def record_sizes(spark, sf):
    """Bytes of shard records and files: V13, I27."""
    size = F.col("p_size").cast("int") * 2 + F.col("p_size").cast("int") * 32 + 512
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), size.alias("record_size"), (size * 100 + 32).alias("shard_size"))


@query("json_fields", """SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN (props->>'$.k')::BIGINT % 16 >= (props->>'$.k')::BIGINT // 16 THEN (props->>'$.k')::BIGINT // 16 END AS row_start FROM events""")
def json_fields(spark, sf):
    """Metadata and boxes that come as JSON: V19, V20, D17."""
    e = fx.table(spark, sf, "events").withColumn("k", F.from_json("props", "k long")["k"])
    start, end = F.floor(F.col("k") / 16), F.col("k") % 16
    form = F.to_json(F.struct(start.alias("row_start"), end.alias("row_end"), F.lit(0).alias("col_start"), F.lit(1).alias("col_end")))
    return e.select("event_id", "k", tok.box_from_json(form)["row_start"].cast("long").alias("row_start"))


# Tokens and compression


@query("token_grid", "SELECT clip_id, token_pos, 0 AS t, r, c FROM v_tokens")
def token_grid(spark, sf):
    """Positions as slice, row and column: D6."""
    return tok.with_grid(fx.tokens(spark, sf), GRID).select("clip_id", "token_pos", "t", "r", "c")


@query("spatial_tokens", "SELECT clip_id, token_pos FROM v_tokens WHERE c = 1")
def spatial_tokens(spark, sf):
    """Patches of a box in the middle slice: P10, P11."""
    return tok.spatial(fx.tokens(spark, sf), GRID, BOX).select("clip_id", "token_pos")


@query("coarse_vectors", "SELECT clip_id, i - 1 AS dim, round(m, 6) AS x FROM v_dims")
def coarse_vectors(spark, sf):
    """Mean token of each clip: A3, D12, S11, S21."""
    return fx.coarse(spark, sf).select("clip_id", F.posexplode("coarse").alias("dim", "x")).select("clip_id", F.col("dim").cast("long").alias("dim"), r6(F.col("x")).alias("x"))


@query("unit_vectors", "SELECT clip_id, token_pos, i - 1 AS dim, round(vec[i] / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS x FROM (SELECT *, sqrt(list_inner_product(vec, vec)) AS n FROM v_tokens), (SELECT unnest(range(1, 17)) AS i)")
def unit_vectors(spark, sf):
    """Vectors of length 1; zero stays zero: V1."""
    out = tok.unit(fx.tokens(spark, sf), "vec").select("clip_id", "token_pos", F.posexplode("vec").alias("dim", "x"))
    return out.select("clip_id", "token_pos", F.col("dim").cast("long").alias("dim"), r6(F.col("x")).alias("x"))


@query("projected_tokens", "SELECT clip_id, token_pos, d AS dim, round(y[d + 1], 6) AS x FROM v_y, (SELECT unnest(range(8)) AS d)")
def projected_tokens(spark, sf):
    """Centred projection on fixed components: V2."""
    out = compress.projected(fx.tokens(spark, sf), fx.model(spark, sf, levels=False)).select("clip_id", "token_pos", F.posexplode("y").alias("dim", "x"))
    return out.select("clip_id", "token_pos", F.col("dim").cast("long").alias("dim"), r6(F.col("x")).alias("x"))


@query("nearest_centroid", "SELECT clip_id, token_pos, centroid_id::INT AS centroid_id FROM v_assigned")
def nearest_centroid(spark, sf):
    """The codebook entry of each token: J7."""
    m = fx.model(spark, sf, levels=False)
    return compress.assigned(compress.projected(fx.tokens(spark, sf), m), m.centroids).select("clip_id", "token_pos", "centroid_id")


@query("residual_thresholds", "SELECT dim::INT AS dim, round(t0, 6) AS t0, round(t1, 6) AS t1, round(t2, 6) AS t2 FROM v_bounds")
def residual_thresholds(spark, sf):
    """Quartiles of the residuals of each dimension: A4."""
    left = compress.residuals(fx.tokens(spark, sf), fx.model(spark, sf, levels=False))
    return compress.dimension_thresholds(left).select("dim", *[r6(F.col(f"t{i}")).alias(f"t{i}") for i in range(3)])


@query("residual_levels", "SELECT dim::INT AS dim, level::INT AS level, round(value, 6) AS value FROM v_values")
def residual_levels(spark, sf):
    """The value of each level in each dimension: A5."""
    left = compress.residuals(fx.tokens(spark, sf), fx.model(spark, sf, levels=False))
    return compress.level_values(left, compress.dimension_thresholds(left)).select("dim", "level", r6(F.col("value")).alias("value"))


@query("compressed_tokens", "SELECT clip_id, token_pos, centroid_id::INT AS centroid_id, packed FROM v_packed")
def compressed_tokens(spark, sf):
    """Codebook entries and two-bit residuals: V5, V6, V8, D8."""
    return compress.compressed(fx.tokens(spark, sf), fx.model(spark, sf)).select("clip_id", "token_pos", "centroid_id", "packed")


@query("projected_tokens_kernel", "SELECT clip_id, token_pos, d AS dim, round(y[d + 1], 6) AS x FROM v_y, (SELECT unnest(range(8)) AS d)")
def projected_tokens_kernel(spark, sf):
    """Projection by matrix products, as large models take it: V2."""
    rows = compress.projected(fx.tokens(spark, sf), fx.model(spark, sf, levels=False), kernel=True)
    return rows.select("clip_id", "token_pos", F.posexplode("y").alias("dim", "x")).select("clip_id", "token_pos", F.col("dim").cast("long").alias("dim"), r6(F.col("x")).alias("x"))


@query("nearest_centroid_kernel", "SELECT clip_id, token_pos, centroid_id::INT AS centroid_id FROM v_assigned")
def nearest_centroid_kernel(spark, sf):
    """The codebook entry of each token by matrix products: J7."""
    m = fx.model(spark, sf, levels=False)
    return compress.assigned(compress.projected(fx.tokens(spark, sf), m), m.centroids, kernel=True).select("clip_id", "token_pos", "centroid_id")


@query("compressed_tokens_kernel", "SELECT clip_id, token_pos, centroid_id::INT AS centroid_id, packed FROM v_packed")
def compressed_tokens_kernel(spark, sf):
    """Compression in Arrow batches: V5, V6, V8, D8."""
    return compress.compressed(fx.tokens(spark, sf), fx.model(spark, sf), kernel=True).select("clip_id", "token_pos", "centroid_id", "packed")


@query("clip_records", "SELECT clip_id, string_agg(centroid_id, ',' ORDER BY token_pos) AS centroids, string_agg(packed, '' ORDER BY token_pos) AS residuals FROM v_packed GROUP BY clip_id")
def clip_records(spark, sf):
    """One record per clip, as shards hold them: D8, D9."""
    r = compress.clip_records(fx.tokens(spark, sf), fx.model(spark, sf))
    return r.select("clip_id", F.array_join(F.transform("centroid_ids", lambda x: x.cast("string")), ",").alias("centroids"), F.hex("residuals").alias("residuals"))


@query("unpacked_levels", "SELECT clip_id, token_pos, dim::INT AS dim, level::INT AS level FROM v_levels")
def unpacked_levels(spark, sf):
    """Levels back from their bytes: V7."""
    rows = compress.compressed(fx.tokens(spark, sf), fx.model(spark, sf)).withColumn("q", V.unpack2(F.col("packed"), 8))
    return rows.select("clip_id", "token_pos", F.posexplode("q").alias("dim", "level"))


_BACK = "SELECT l.clip_id, l.token_pos, l.dim, l.y, centre + value AS back FROM v_levels l JOIN v_values v ON v.dim = l.dim AND v.level = l.level"


@query("decompressed_tokens", f"SELECT clip_id, token_pos, dim::INT AS dim, round(back, 6) AS x FROM ({_BACK})")
def decompressed_tokens(spark, sf):
    """Vectors back from records: V9, J6."""
    m = fx.model(spark, sf)
    rows = compress.decompressed(compress.compressed(fx.tokens(spark, sf), m), m)
    return rows.select("clip_id", "token_pos", F.posexplode("vec").alias("dim", "x")).withColumn("x", r6(F.col("x")))


@query("decompressed_tokens_kernel", f"SELECT clip_id, token_pos, dim::INT AS dim, round(back, 6) AS x FROM ({_BACK})")
def decompressed_tokens_kernel(spark, sf):
    """Vectors back from records in Arrow batches: V9, J6."""
    m = fx.model(spark, sf)
    rows = compress.decompressed(compress.compressed(fx.tokens(spark, sf), m, kernel=True), m, kernel=True)
    return rows.select("clip_id", "token_pos", F.posexplode("vec").alias("dim", "x")).withColumn("x", r6(F.col("x")))


@query("reconstruction", f"""SELECT clip_id, round(avg(s), 6) AS cosine FROM (SELECT clip_id, token_pos, sum(y * back) / CASE WHEN sum(y * y) * sum(back * back) = 0 THEN 1 ELSE sqrt(sum(y * y)) * sqrt(sum(back * back)) END AS s
    FROM ({_BACK}) GROUP BY ALL) GROUP BY clip_id""")  # fmt: skip
def reconstruction(spark, sf):
    """How near decompression comes, by clip: V10, J13, A8."""
    return compress.fidelity(fx.tokens(spark, sf), fx.model(spark, sf)).select("clip_id", r6(F.col("cosine")).alias("cosine"))


_SHARES = """SELECT batch, n, fl + (rk <= want - sum(fl) OVER ())::BIGINT AS take FROM (SELECT *, row_number() OVER (ORDER BY round(rest, 9) DESC, batch) AS rk FROM (
    SELECT batch, n, want, floor(n * want / total)::BIGINT AS fl, n * want / total - floor(n * want / total) AS rest FROM (
    SELECT user_id AS batch, count(*) AS n, least(777, sum(count(*)) OVER ())::BIGINT AS want, sum(count(*)) OVER ()::BIGINT AS total FROM events GROUP BY user_id)))"""


@query("sample_shares", f"SELECT batch, n, take::BIGINT AS take FROM ({_SHARES})")
def sample_shares(spark, sf):
    """How many training rows each batch gives, by largest remainders: T6."""
    return compress.allocation(fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("batch")).agg(F.count("*").alias("n")), 777)


@query("sample_rows", f"""SELECT user_id AS batch, event_id AS pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('0:' || user_id || ':' || event_id), event_id) AS rn FROM events)
    JOIN ({_SHARES}) ON batch = user_id WHERE rn <= take""")  # fmt: skip
def sample_rows(spark, sf):
    """The training rows themselves: T6, V18."""
    rows = fx.table(spark, sf, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("pos"))
    return compress.sampled(rows, 777)


# Searches

_SIM = "round(list_cosine_similarity(a.{x}, b.{x}), 6)"


@query("coarse_search", f"""SELECT a.clip_id, {_SIM.format(x='coarse')} AS score, row_number() OVER (ORDER BY {_SIM.format(x='coarse')} DESC, a.clip_id)::INT AS rank FROM v_coarse a, v_coarse b WHERE b.clip_id = 0
    QUALIFY rank <= 100""")  # fmt: skip
def coarse_search(spark, sf):
    """The nearest clips by mean token: T1, J8, D13."""
    return search.coarse_search(fx.coarse(spark, sf), fx.query_vector(spark, sf, QUERY_CLIP, "coarse"), 100)


@query("knn_join", """SELECT b.clip_id AS query_id, a.clip_id, round(list_cosine_similarity(a.vec, b.vec), 6) AS score, row_number() OVER (PARTITION BY b.clip_id ORDER BY round(list_cosine_similarity(a.vec, b.vec), 6) DESC, a.clip_id)::INT AS rank
    FROM v_vectors a, v_vectors b WHERE b.clip_id % 20 = 0 QUALIFY rank <= 10""")  # fmt: skip
def knn_join(spark, sf):
    """The nearest rows of every twentieth vector: J8, W9, V11."""
    rows = fx.vectors(spark, sf)
    return search.knn_join(rows.where("clip_id % 20 = 0").withColumnRenamed("clip_id", "query_id"), rows, 10)


_COARSE = f"c AS (SELECT a.clip_id, row_number() OVER (ORDER BY {_SIM.format(x='coarse')} DESC, a.clip_id) AS rk FROM v_coarse a, v_coarse b WHERE b.clip_id = 0 QUALIFY rk <= {{k}})"
_MAXSIM = "m AS (SELECT clip_id, any_value(rk) AS rk, round(sum(s), 6) AS score FROM (SELECT t.clip_id, rk, q.token_pos, max(list_cosine_similarity(t.vec, q.vec)) AS s FROM v_tokens t JOIN c USING (clip_id), v_tokens q WHERE q.clip_id = 0{box} GROUP BY ALL) GROUP BY clip_id)"
_HITS = "SELECT clip_id, score, row_number() OVER (ORDER BY score DESC, rk)::INT AS rank, episode_id, dataset_name, robot_type, timestamp_start, timestamp_end, language_instruction FROM m JOIN v_clips USING (clip_id) QUALIFY rank <= 10"


def _token_search(spark, sf, box: tok.Box | None, coarse_k: int, kernel: bool = False) -> DataFrame:
    coarse = search.coarse_search(fx.coarse(spark, sf), fx.query_vector(spark, sf, QUERY_CLIP, "coarse"), coarse_k)
    query_tokens = fx.query_vector(spark, sf, QUERY_CLIP, "tokens")
    if box is not None:
        query_tokens = [query_tokens[i] for i in box.patches(GRID)]
    hits = search.reranked(coarse, tok.gathered(fx.tokens(spark, sf)), query_tokens, 10, kernel=kernel)
    return search.described(hits, fx.catalog(spark, sf))


@query("image_search", f"WITH {_COARSE.format(k=100)}, {_MAXSIM.format(box='')} {_HITS}")
def image_search(spark, sf):
    """Coarse candidates, reranked by all tokens of the query: I17, J4, J9, A6, T2, P13."""
    return _token_search(spark, sf, None, 100)


@query("image_search_kernel", f"WITH {_COARSE.format(k=100)}, {_MAXSIM.format(box='')} {_HITS}")
def image_search_kernel(spark, sf):
    """The same by the Arrow kernel: V12."""
    return _token_search(spark, sf, None, 100, kernel=True)


@query("spatial_search", f"WITH {_COARSE.format(k=50)}, {_MAXSIM.format(box=' AND q.c = 1')} {_HITS}")
def spatial_search(spark, sf):
    """Whole-clip candidates, reranked by the query's tokens in a box: I17, P10, P11."""
    return _token_search(spark, sf, BOX, 50)


_SIDE = "{n} AS (SELECT a.clip_id, round(list_cosine_similarity(a.coarse, b.coarse), 6) AS score, row_number() OVER (ORDER BY round(list_cosine_similarity(a.coarse, b.coarse), 6) DESC, a.clip_id) AS rk FROM v_coarse a, v_coarse b WHERE b.clip_id = {q} QUALIFY rk <= 100)"


@query("transition_search", f"""WITH {_SIDE.format(n='sa', q=0)}, {_SIDE.format(n='sb', q=7)},
    p AS (SELECT y.clip_id, x.clip_id AS first_clip, y.episode_id, y.dataset_name, y.robot_type, y.timestamp_start, y.timestamp_end, y.language_instruction, round(sa.score + sb.score, 6) AS score, sa.rk AS ra, sb.rk AS rb
    FROM sa JOIN v_clips x ON x.clip_id = sa.clip_id JOIN v_clips y ON y.episode_id = x.episode_id JOIN sb ON sb.clip_id = y.clip_id WHERE y.timestamp_start - x.timestamp_end BETWEEN 0 AND 5),
    e AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, ra, rb) = 1)
    SELECT * EXCLUDE (ra, rb), row_number() OVER (ORDER BY score DESC, episode_id)::INT AS rank FROM e QUALIFY rank <= 10""")  # fmt: skip
def transition_search(spark, sf):
    """One state, then another in the same episode: J2, J3, A13, A15, T3, U2, W8."""
    base = fx.coarse(spark, sf)
    first, second = (search.coarse_search(base, fx.query_vector(spark, sf, q, "coarse"), 100) for q in (QUERY_CLIP, OTHER_CLIP))
    return search.transitions(first, second, fx.catalog(spark, sf), max_gap=5.0)


@query("trajectory_candidates", """SELECT DISTINCT episode_id FROM (SELECT a.episode_id, row_number() OVER (PARTITION BY b.step ORDER BY round(list_cosine_similarity(a.vec, b.vec), 6) DESC, a.episode_id, a.step) AS rk
    FROM v_traj a, v_traj b WHERE b.episode_id = 'ep/0') WHERE rk <= 5 AND episode_id <> 'ep/0'""")  # fmt: skip
def trajectory_candidates(spark, sf):
    """Episodes that own a near frame: T5, P12, U3, S16."""
    return trajectory.candidates(fx.steps(spark, sf), EPISODE, 5)


#: Dynamic time warping in SQL: one cell a step, row by row, for all episodes at once; prev and cur are rows of accumulated costs.
_DTW = """WITH RECURSIVE q AS (SELECT list(vec ORDER BY step) AS a FROM v_traj WHERE episode_id = 'ep/0'),
    o AS (SELECT episode_id, list(vec ORDER BY step) AS b FROM v_traj WHERE episode_id <> 'ep/0' GROUP BY episode_id),
    s AS (SELECT episode_id, a, b, len(a) AS n, len(b) AS m, greatest(ceil(greatest(len(a), len(b)) * 0.2::DOUBLE)::BIGINT, abs(len(a) - len(b))) AS w FROM q, o),
    d AS (SELECT episode_id, 1::BIGINT AS i, 1::BIGINT AS j, [0::DOUBLE] || [1e300::DOUBLE FOR x IN range(m)] AS prev, [1e300::DOUBLE] AS cur FROM s
      UNION ALL SELECT episode_id, CASE WHEN j = m THEN i + 1 ELSE i END, CASE WHEN j = m THEN 1 ELSE j + 1 END, CASE WHEN j = m THEN nxt ELSE prev END, CASE WHEN j = m THEN [1e300::DOUBLE] ELSE nxt END
      FROM (SELECT d.*, n, m, list_append(cur, CASE WHEN abs(i - j) > w THEN 1e300::DOUBLE ELSE 1 - list_cosine_similarity(a[i], b[j]) + least(prev[j + 1], cur[j], prev[j]) END) AS nxt FROM d JOIN s USING (episode_id) WHERE i <= n)),
    f AS (SELECT episode_id, round(prev[m + 1], 6) AS distance FROM d JOIN s USING (episode_id) WHERE i = n + 1)"""


@query("trajectory_rank", f"{_DTW} SELECT episode_id, distance, row_number() OVER (ORDER BY distance, episode_id)::INT AS rank FROM f QUALIFY rank <= 10", recursive=True)
def trajectory_rank(spark, sf):
    """The most similar episodes by dynamic time warping: W4, W7, T4, D14."""
    return trajectory.rank(fx.steps(spark, sf), EPISODE, 10)


@query("trajectory_rank_pruned", f"{_DTW} SELECT episode_id, distance, row_number() OVER (ORDER BY distance, episode_id)::INT AS rank FROM f QUALIFY rank <= 10", recursive=True)
def trajectory_rank_pruned(spark, sf):
    """The same, with lower bounds first: T4, W6, A14."""
    return trajectory.rank(fx.steps(spark, sf), EPISODE, 10, prune=True)


@query("trajectory_search", f"""{_DTW}, c AS (SELECT DISTINCT episode_id FROM (SELECT a.episode_id, row_number() OVER (PARTITION BY b.step ORDER BY round(list_cosine_similarity(a.vec, b.vec), 6) DESC, a.episode_id, a.step) AS rk
    FROM v_traj a, v_traj b WHERE b.episode_id = 'ep/0') WHERE rk <= 5 AND episode_id <> 'ep/0'),
    l AS (SELECT episode_id, arg_min(dataset_name, clip_id) AS dataset_name, arg_min(robot_type, clip_id) AS robot_type FROM v_clips GROUP BY episode_id)
    SELECT f.episode_id, coalesce(dataset_name, '') AS dataset_name, coalesce(robot_type, '') AS robot_type, distance, row_number() OVER (ORDER BY distance, f.episode_id)::INT AS rank FROM f JOIN c USING (episode_id) LEFT JOIN l USING (episode_id) QUALIFY rank <= 10""", recursive=True)  # fmt: skip
def trajectory_search(spark, sf):
    """Candidates by frames, ranked by warping, with what the catalog says: I17, J11."""
    return trajectory.search(fx.steps(spark, sf), fx.catalog(spark, sf), EPISODE, 10, frame_k=5)


_BAND = """SELECT q.step AS i, o.episode_id, dim, q.vec[dim + 1] / nq AS x, max(o.vec[dim + 1] / no) AS hi, min(o.vec[dim + 1] / no) AS lo
    FROM (SELECT *, sqrt(list_inner_product(vec, vec)) AS nq, count(*) OVER () AS n FROM v_traj WHERE episode_id = 'ep/0') q
    JOIN (SELECT *, sqrt(list_inner_product(vec, vec)) AS no, count(*) OVER (PARTITION BY episode_id) AS m FROM v_traj WHERE episode_id <> 'ep/0') o
    ON abs(q.step - o.step) <= greatest(ceil(greatest(n, m) * 0.2::DOUBLE)::BIGINT, abs(n - m)), (SELECT unnest(range(64)) AS dim) GROUP BY ALL"""


@query("trajectory_bounds", f"SELECT episode_id, round(sum(greatest(x - hi, lo - x, 0) ** 2) / 2, 6) AS bound FROM ({_BAND}) GROUP BY episode_id")
def trajectory_bounds(spark, sf):
    """Lower bounds of the warping distance: W6, A14."""
    return trajectory.bounds(fx.steps(spark, sf), EPISODE)


#: The way back from the last cell; of equal predecessors a step back in the query comes first, then in the other series, then in both.
_PATHS = """, t AS (SELECT episode_id FROM f ORDER BY distance, episode_id LIMIT 3),
    acc AS (SELECT episode_id, i - 1 AS i, prev FROM d JOIN t USING (episode_id) WHERE j = 1),
    b AS (SELECT episode_id, n AS i, m AS j, 0 AS back FROM s JOIN t USING (episode_id)
      UNION ALL SELECT b.episode_id, CASE WHEN y.prev[b.j + 1] <= least(x.prev[b.j], y.prev[b.j]) OR x.prev[b.j] > y.prev[b.j] THEN b.i - 1 ELSE b.i END,
        CASE WHEN y.prev[b.j + 1] <= least(x.prev[b.j], y.prev[b.j]) THEN b.j ELSE b.j - 1 END, back + 1
      FROM b JOIN acc x ON x.episode_id = b.episode_id AND x.i = b.i JOIN acc y ON y.episode_id = b.episode_id AND y.i = b.i - 1 WHERE b.i > 0 AND b.j > 0),
    g AS (SELECT *, max(back) OVER (PARTITION BY episode_id) - back AS k FROM b WHERE i > 0 AND j > 0)
    SELECT episode_id, k::INT AS k, (i - 1)::INT AS q, (j - 1)::INT AS c FROM g"""


@query("trajectory_paths", f"{_DTW}{_PATHS}", recursive=True)
def trajectory_paths(spark, sf):
    """The aligned steps of the ranked episodes: W5."""
    s = fx.steps(spark, sf)
    return trajectory.alignments(s, EPISODE, trajectory.rank(s, EPISODE, 3))


@query("episode_steps", "SELECT episode_id, step, round(vec[1], 6) AS x0 FROM v_traj")
def episode_steps(spark, sf):
    """Trajectories, made from clips: D14, V17's shape."""
    steps = fx.steps(spark, sf)
    seq = trajectory.sequences(steps).select("episode_id", F.posexplode("seq").alias("step", "v"))
    return seq.select("episode_id", F.col("step").cast("long").alias("step"), r6(F.get("v", F.lit(0))).alias("x0"))


# Index and validation


@query("neighbour_overlap", """WITH t AS (SELECT b.clip_id AS q, a.clip_id FROM v_vectors a, v_vectors b WHERE b.clip_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY b.clip_id ORDER BY round(list_cosine_similarity(a.vec, b.vec), 6) DESC, a.clip_id) <= 10),
    g AS (SELECT b.clip_id AS q, a.clip_id FROM v_coarse a, v_coarse b WHERE b.clip_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY b.clip_id ORDER BY round(list_cosine_similarity(a.coarse, b.coarse), 6) DESC, a.clip_id) <= 10)
    SELECT t.q AS query_id, round(count(g.q) / 10, 6) AS recall FROM t LEFT JOIN g ON g.q = t.q AND g.clip_id = t.clip_id GROUP BY t.q""")  # fmt: skip
def neighbour_overlap(spark, sf):
    """How many neighbours by whole vector the coarse ones find: J12, A7, U4."""
    v, c = fx.vectors(spark, sf), fx.coarse(spark, sf)
    few = lambda rows, col: search.knn_join(rows.where("clip_id % 20 = 0").select(F.col("clip_id").alias("query_id"), col), rows, 10, vec=col)
    truth, found = few(v, "vec"), few(c, "coarse").select("query_id", "clip_id", F.lit(1).alias("hit"))
    return truth.join(found, ["query_id", "clip_id"], "left").groupBy("query_id").agg(r6(F.count("hit") / 10).alias("recall"))


@query("validation_sample", "SELECT vec_id AS clip_id, row_number() OVER (ORDER BY md5('0:' || vec_id), vec_id) AS place FROM embeddings QUALIFY place <= 100")
def validation_sample(spark, sf):
    """Rows that a validation looks at: T7."""
    ids = compress.uniform_sample(fx.catalog(spark, sf).select("clip_id"), 100)
    return ids.withColumn("place", F.row_number().over(Window.orderBy(F.md5(F.concat_ws(":", F.lit("0"), F.col("clip_id").cast("string"))), "clip_id")).cast("long"))  # 100 rows


def _index(spark, sf, probes: int) -> index.Index:
    """An index of 16 lists, built, and opened again as a search opens it."""
    from ..work import passing, work_dir

    path = passing(spark, f"{work_dir(spark)}/index/{uuid.uuid4().hex}")
    index.Index.build(fx.vectors(spark, sf), path, lists=16, probes=probes, vec="vec")
    return index.Index.open(spark, path, probes=probes)


@query("index_search", """SELECT b.clip_id AS query_id, a.clip_id, round(list_cosine_similarity(a.vec, b.vec), 6) AS score, row_number() OVER (PARTITION BY b.clip_id ORDER BY round(list_cosine_similarity(a.vec, b.vec), 6) DESC, a.clip_id)::INT AS rank
    FROM v_vectors a, v_vectors b WHERE b.clip_id % 20 = 0 QUALIFY rank <= 10""")  # fmt: skip
def index_search(spark, sf):
    """All lists of an index asked: what it holds is whole, and its answer the exact one: I1, S15."""
    asked = fx.vectors(spark, sf).where("clip_id % 20 = 0").withColumnRenamed("clip_id", "query_id")
    return _index(spark, sf, 16).knn(asked, 10)


@query("index_recall", "SELECT 16::INT AS lists, 12::INT AS probes, true AS recall_of_nine_tenths")
def index_recall(spark, sf):
    """Some lists of an index asked, held against exact search; measured, recorded and read again: I1, I2, I3, S15."""
    rows = fx.vectors(spark, sf)
    opened = _index(spark, sf, 12)
    asked = rows.where("clip_id % 20 = 0").withColumnRenamed("clip_id", "query_id")
    index.record(spark, opened.path, 12, index.recall(opened.knn(asked, 10), search.knn_join(asked, rows, 10), 10), rows.count())
    probes, share, _ = index.recorded(spark, opened.path)
    return spark.createDataFrame([(16, probes, share >= 0.9)], "lists int, probes int, recall_of_nine_tenths boolean")


@query("fitted_compressor")
def fitted_compressor(spark, sf):
    """A compressor fitted to a sample, and how near it comes: V3, V4, A8, A9, S14."""
    rows = fx.tokens(spark, sf).withColumns({"batch": F.expr("clip_id div 100"), "pos": F.expr("clip_id * 4 + token_pos")})
    m = compress.fit(compress.sampled(rows, 1000), width=8, n_centroids=16)
    return compress.fidelity(fx.tokens(spark, sf), m).agg(r6(F.avg("cosine")).alias("cosine"), r6(F.lit(sum(m.explained))).alias("explained"))


@query("sql_functions", "SELECT clip_id, round(list_cosine_similarity(vec, vec) * 1.0, 6) AS self_score, 0.0::DOUBLE AS self_distance FROM v_vectors")
def sql_functions(spark, sf):
    """Registered functions, called from SQL: the extension points of §2.11."""
    from ..functions.registered import register

    register(spark)
    rows = fx.vectors(spark, sf).select("clip_id", F.array("vec").alias("m"))
    return rows.select("clip_id", r6(F.call_function("maxsim", F.col("m"), F.col("m"))).alias("self_score"), F.abs(r6(F.call_function("dtw_distance", F.col("m"), F.col("m"), F.lit(0.2)))).alias("self_distance"))


@query("stream_catalog", _CATALOG)
def stream_catalog(spark, sf):
    """The catalog again, from a stream of frames that is drained: S1, S7, I5, I6 and §2.10."""
    from ..streaming.ingest import drained_frames

    frames = drained_frames(spark, sf)
    found = clips.clips(frames, SPEC)
    numbered = numbering.global_index(found, ["episode_index", "window"], "clip_index").drop("episode_index", "window")
    return numbered.withColumns({c: r6(F.col(c)) for c in ("timestamp_start", "timestamp_end")})


@query("stream_sessions", "SELECT episode_index, count(*) AS frames, max(frame) AS last_frame FROM v_frames GROUP BY episode_index")
def stream_sessions(spark, sf):
    """Episodes kept as state over micro-batches: §2.10."""
    from ..streaming.ingest import session_counts

    return session_counts(spark, sf)
