"""The tables' rows as clips, tokens, trajectories and frames, for the registered queries; and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import compress
from ..operators.clips import ClipSpec
from ..operators.tokens import Box, Grid

GRID = Grid(times=1, side=2)
BOX = Box(0, 1, 1, 1)
SPEC = ClipSpec(repo_id="hub/arm", robot_type="rb_arm", source_fps=15.0, target_fps=4.0, length=64, stride=32)
#: Each of the 8 projected dimensions is the scaled sum of two of the 16.
HALF = 0.7071067811865476
COMPONENTS = [[HALF if j // 2 == i else 0.0 for j in range(16)] for i in range(8)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS clip_id", "concat('ep/', vec_id div 10) AS episode_id", "vec_id % 10 AS step", "concat('ds_', label % 3) AS dataset_name", "concat('rb_', label % 2) AS robot_type",
        "cast(vec_id % 10 * 2 AS double) AS timestamp_start", "cast(vec_id % 10 * 2 + 1 AS double) AS timestamp_end",
        "CASE WHEN vec_id % 4 <> 0 THEN concat('task_', label) END AS language_instruction", "vec_id div 100 AS shard_id", "vec_id % 100 AS shard_offset",
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), "embedding", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("token_pos"))
    return rows.select("clip_id", "token_pos", F.slice("embedding", F.col("token_pos") * 16 + 1, 16).cast("array<double>").alias("vec"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), V.doubles(F.col("embedding")).alias("vec"))


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tokens import pooled

    return pooled(tokens(spark, sf_dir), 16)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 10 < 10 - (vec_id div 10) % 3")
    return rows.select(F.expr("concat('ep/', vec_id div 10)").alias("episode_id"), F.expr("vec_id % 10").alias("step"), V.doubles(F.col("embedding")).alias("vec"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole hours since the user's first event number the frames."""
    events = table(spark, sf_dir, "events")
    first = events.groupBy("user_id").agg(F.min("ts").alias("first"))
    met = events.join(first, "user_id").withColumn("i", F.col("ts") - F.col("first"))
    hours = F.expr("cast(extract(DAY FROM i) * 24 + extract(HOUR FROM i) AS long)")
    return met.select(F.col("user_id").alias("episode_index"), hours.alias("frame_index"), F.col("event_id").alias("arrival_seq"), F.col("event_type").alias("language"))


def whole_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames with their episodes gathered, as clips() takes them."""
    return frames(spark, sf_dir).withColumn("frame", F.col("frame_index"))


def query_vector(spark: SparkSession, sf_dir: str, clip_id: int, name: str = "vec") -> list:
    """A vector, or with name tokens a list of them, of one clip: one row."""
    if name == "tokens":
        return [list(r["vec"]) for r in tokens(spark, sf_dir).where(F.col("clip_id") == clip_id).orderBy("token_pos").collect()]
    rows = vectors(spark, sf_dir) if name == "vec" else coarse(spark, sf_dir)
    return list(rows.where(F.col("clip_id") == clip_id).first()[name])


_models: dict[tuple[str, str, bool], compress.Model] = {}


def model(spark: SparkSession, sf_dir: str, levels: bool = True) -> compress.Model:
    """A compressor that is not fitted but read off the data, so that SQL can make the same one; made once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, levels)
    if key not in _models:
        _models[key] = _made(spark, sf_dir, levels)
    return _models[key]


def _made(spark: SparkSession, sf_dir: str, levels: bool) -> compress.Model:
    rows = tokens(spark, sf_dir)
    mean = list(rows.agg(*[F.avg(F.element_at("vec", i + 1)) for i in range(16)]).first())
    base = compress.Model(mean, COMPONENTS, [])
    labels = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min("vec_id").alias("clip_id"))
    first = compress.projected(rows.where("token_pos = 0").join(F.broadcast(labels), "clip_id"), base).orderBy("label")  # one row per label
    centroids = [list(r["y"]) for r in first.select("y").collect()]
    base = compress.Model(mean, COMPONENTS, centroids)
    if not levels:
        return base
    left = compress.residuals(rows, base)
    bounds = compress.dimension_thresholds(left)
    t = sorted(map(tuple, bounds.collect()))  # one row per dimension
    v = {(r["dim"], r["level"]): r["value"] for r in compress.level_values(left, bounds).collect()}
    return compress.Model(mean, COMPONENTS, centroids, [[x[1 + i] for x in t] for i in range(3)], [[v[j, i] for j in range(8)] for i in range(4)])


#: The same views in SQL; each may use those before it.
VIEWS = {
    "v_clips": """SELECT vec_id AS clip_id, 'ep/' || (vec_id // 10) AS episode_id, vec_id % 10 AS step, 'ds_' || (label % 3) AS dataset_name, 'rb_' || (label % 2) AS robot_type,
        (vec_id % 10 * 2)::DOUBLE AS timestamp_start, (vec_id % 10 * 2 + 1)::DOUBLE AS timestamp_end, CASE WHEN vec_id % 4 <> 0 THEN 'task_' || label END AS language_instruction,
        vec_id // 100 AS shard_id, vec_id % 100 AS shard_offset FROM embeddings""",
    "v_vectors": "SELECT vec_id AS clip_id, embedding::DOUBLE[] AS vec FROM embeddings",
    "v_tokens": "SELECT vec_id AS clip_id, p AS token_pos, p // 2 AS r, p % 2 AS c, embedding[p * 16 + 1 : p * 16 + 16]::DOUBLE[] AS vec FROM embeddings, (SELECT unnest(range(4))::INT AS p)",
    "v_dims": "SELECT clip_id, i, avg(vec[i]) AS m FROM v_tokens, (SELECT unnest(range(1, 17)) AS i) GROUP BY clip_id, i",
    "v_coarse": "SELECT clip_id, list(m ORDER BY i) AS coarse FROM v_dims GROUP BY clip_id",
    "v_traj": "SELECT 'ep/' || (vec_id // 10) AS episode_id, vec_id % 10 AS step, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 10 < 10 - (vec_id // 10) % 3",
    "v_frames": "SELECT user_id AS episode_index, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 3600000000 AS frame, event_id AS arrival_seq, event_type AS language FROM events",
    "v_timed": "SELECT *, min(frame) OVER w AS first_frame, (frame - min(frame) OVER w) / 15.0::DOUBLE AS ts FROM v_frames WINDOW w AS (PARTITION BY episode_index)",
    "v_ends": "SELECT episode_index, max(first_frame) AS first_frame, max(ts) AS e FROM v_timed GROUP BY episode_index",
    "v_grid": "SELECT episode_index, first_frame, unnest(range(0, floor(e * 4.0::DOUBLE)::BIGINT + 1)) AS target FROM v_ends",
    "v_both": """SELECT episode_index, first_frame, ts, 0 AS side, frame, arrival_seq, NULL::BIGINT AS target FROM v_timed
        UNION ALL SELECT episode_index, first_frame, target / 4.0::DOUBLE, 1, NULL, NULL, target FROM v_grid""",
    "v_near": """SELECT *, last_value(CASE WHEN side = 0 THEN {'ts': ts, 'frame': frame, 'seq': arrival_seq} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
        first_value(CASE WHEN side = 0 THEN {'ts': ts, 'frame': frame, 'seq': arrival_seq} END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a
        FROM v_both WINDOW w AS (PARTITION BY episode_index ORDER BY ts, side, frame NULLS FIRST, arrival_seq NULLS FIRST, target NULLS FIRST)""",
    "v_kept": """SELECT episode_index, target, first_frame, CASE WHEN a IS NOT NULL AND abs(a.ts - ts) < abs(b.ts - ts) THEN a.frame ELSE b.frame END AS frame,
        CASE WHEN a IS NOT NULL AND abs(a.ts - ts) < abs(b.ts - ts) THEN a.seq ELSE b.seq END AS arrival_seq FROM v_near WHERE side = 1""",
    "v_n": "SELECT episode_index, count(*) AS n FROM v_kept GROUP BY episode_index",
    "v_windows": """SELECT * FROM (SELECT episode_index, n, unnest(range(0, n)) AS j FROM v_n) WHERE j * 32 < n AND (j = 0 OR (j - 1) * 32 + 64 < n)""",
    "v_lang": "SELECT episode_index, arg_min(language, arrival_seq) FILTER (language IS NOT NULL) AS language FROM v_frames GROUP BY episode_index",
    "v_catalog": """SELECT 'hub/arm_' || w.episode_index AS episode_id, w.episode_index, j AS win, 'arm' AS dataset_name, 'rb_arm' AS robot_type, s.frame AS clip_start_frame, e.frame AS clip_end_frame,
        (s.frame - s.first_frame) / 15.0::DOUBLE AS timestamp_start, (e.frame - s.first_frame) / 15.0::DOUBLE AS timestamp_end, l.language AS language_instruction, least(64, n - j * 32) AS num_original_frames
        FROM v_windows w JOIN v_kept s ON s.episode_index = w.episode_index AND s.target = j * 32
        JOIN v_kept e ON e.episode_index = w.episode_index AND e.target = j * 32 + least(64, n - j * 32) - 1 JOIN v_lang l ON l.episode_index = w.episode_index""",
    "v_mean": "SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(vec[i]) AS m FROM v_tokens, (SELECT unnest(range(1, 17)) AS i) GROUP BY i)",
    "v_y": """SELECT clip_id, token_pos, [(vec[2 * d + 1] - mean[2 * d + 1]) * 0.7071067811865476::DOUBLE + (vec[2 * d + 2] - mean[2 * d + 2]) * 0.7071067811865476::DOUBLE FOR d IN range(8)] AS y FROM v_tokens, v_mean""",
    "v_book": """SELECT row_number() OVER (ORDER BY label) - 1 AS centroid_id, y AS centroid FROM (SELECT label, min(vec_id) AS clip_id FROM embeddings GROUP BY label) JOIN v_y USING (clip_id) WHERE token_pos = 0""",
    "v_assigned": """SELECT y.clip_id, y.token_pos, arg_min(centroid_id, (list_distance(y, centroid), centroid_id)) AS centroid_id FROM v_y y, v_book GROUP BY y.clip_id, y.token_pos""",
    "v_res": """SELECT clip_id, token_pos, d AS dim, y[d + 1] AS y, centroid[d + 1] AS centre, y[d + 1] - centroid[d + 1] AS x, centroid_id
        FROM v_assigned JOIN v_y USING (clip_id, token_pos) JOIN v_book USING (centroid_id), (SELECT unnest(range(8)) AS d)""",
    "v_bounds": "SELECT dim, quantile_cont(x, 0.25) AS t0, quantile_cont(x, 0.5) AS t1, quantile_cont(x, 0.75) AS t2 FROM v_res GROUP BY dim",
    "v_levels": "SELECT r.*, t0, t1, t2, (x > t0)::INT + (x > t1)::INT + (x > t2)::INT AS level FROM v_res r JOIN v_bounds USING (dim)",
    "v_values": """SELECT dim, level, coalesce(m, CASE level WHEN 0 THEN t0 WHEN 1 THEN (t0 + t1) / 2 WHEN 2 THEN (t1 + t2) / 2 ELSE t2 END) AS value
        FROM (SELECT *, unnest([0, 1, 2, 3]) AS level FROM v_bounds) LEFT JOIN (SELECT dim, level, median(x) AS m FROM v_levels GROUP BY dim, level) USING (dim, level)""",
    "v_packed": """SELECT clip_id, token_pos, any_value(centroid_id) AS centroid_id, string_agg(format('{:02X}', b), '' ORDER BY byte) AS packed
        FROM (SELECT clip_id, token_pos, centroid_id, dim // 4 AS byte, sum(level * (4 ** (dim % 4)))::INT AS b FROM v_levels GROUP BY ALL) GROUP BY clip_id, token_pos""",
}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """body, with the views that it names and those that these need."""
    import re

    need: set[str] = set()

    def add(text: str) -> None:
        for v in VIEWS:
            if v not in need and re.search(rf"\b{v}\b", text):
                need.add(v)
                add(VIEWS[v])

    add(body + " ".join(views))
    ctes = ",\n".join(f"{v} AS ({q})" for v, q in VIEWS.items() if v in need)
    more = body.lstrip()
    if more.startswith("WITH"):
        more, ctes = more[4:].strip().removeprefix("RECURSIVE"), f"{ctes}," if ctes else " "
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{more}" if ctes or recursive or more is not body.lstrip() else more
