from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipquarry.functions import kernels
from clipquarry.operators import clips, compress, index, numbering, search, tokens, trajectory
from clipquarry.operators.tokens import Box, Grid


def frames_of(spark, episodes: dict[int, list[int | None]]):
    rows, seq = [], 0
    for e, numbers in episodes.items():
        for n in numbers:
            rows.append((e, n, seq, None if seq % 3 else f"say {seq}"))
            seq += 1
    return spark.createDataFrame(rows, "episode_index long, frame_index long, arrival_seq long, language string").withColumn("frame", F.col("frame_index"))


def plain_resample(numbers: list[int], source: float, target: float) -> list[int]:
    """The frame nearest to each grid point, the earlier one of two equally near."""
    numbers = sorted(numbers)
    ts = [(x - numbers[0]) / source for x in numbers]
    out = []
    for i in range(math.floor(ts[-1] * target) + 1):
        t = i / target
        before = max(k for k in range(len(ts)) if ts[k] <= t)
        after = next((k for k in range(len(ts)) if ts[k] > t), None)
        out.append(numbers[after if after is not None and ts[after] - t < t - ts[before] else before])
    return out


def plain_windows(n: int, size: int, step: int) -> list[tuple[int, int]]:
    out, at = [], 0
    while at < n:
        out.append((at, min(size, n - at)))
        if at + size >= n:
            break
        at += step
    return out


@pytest.mark.parametrize("fps", [5, 15, 50])
def test_resampling_equals_plain(spark, fps):
    r = np.random.default_rng(fps)
    episodes = {e: sorted(r.choice(200, r.integers(1, 120), replace=False).tolist()) for e in range(12)}
    spec = clips.ClipSpec("hub/x", source_fps=fps, target_fps=4)
    got = clips.resampled(frames_of(spark, episodes), "episode_index", spec).orderBy("episode_index", "target").collect()
    for e, numbers in episodes.items():
        assert [x.frame for x in got if x.episode_index == e] == plain_resample(numbers, fps, 4)


def test_half_way_takes_the_earlier_frame(spark):
    spec = clips.ClipSpec("hub/x", source_fps=15, target_fps=4)
    got = clips.resampled(frames_of(spark, {0: list(range(100))}), "episode_index", spec).orderBy("target").collect()
    assert len(got) == 27 and got[2].frame == 7 and got[26].frame == 97


@pytest.mark.parametrize(("n", "size", "step"), [(1, 4, 2), (4, 4, 2), (5, 4, 2), (9, 4, 2), (9, 3, 5), (11, 64, 32), (107, 64, 32)])
def test_windows_equal_plain(spark, n, size, step):
    spec = clips.ClipSpec("hub/x", source_fps=4, target_fps=4, length=size, stride=step)
    kept = clips.resampled(frames_of(spark, {0: list(range(n))}), "episode_index", spec)
    got = sorted((x.start, x.originals) for x in clips.windows(kept, "episode_index", spec).collect())
    assert got == plain_windows(n, size, step)
    padded = clips.windows(kept, "episode_index", spec, frames=True).groupBy("window").count().collect()
    assert all(x["count"] == size for x in padded)


def test_clip_rows(spark):
    spec = clips.ClipSpec("hub/sub/arm", "rb", 15, 4, 64, 32)
    got = clips.clips(frames_of(spark, {3: list(range(400)), 4: list(range(40))}), spec).orderBy("episode_id", "clip_start_frame").collect()
    assert [(x.episode_id, x.clip_start_frame, x.num_original_frames) for x in got] == [("hub/sub/arm_3", 0, 64), ("hub/sub/arm_3", 120, 64), ("hub/sub/arm_3", 240, 43), ("hub/sub/arm_4", 0, 11)]
    assert got[0].dataset_name == "arm" and got[0].language_instruction == "say 0" and got[1].timestamp_start == 8.0


def test_streamed_episodes_come_again_and_reset_ordinals(spark):
    rows = [(0, 5), (0, 6), (1, 7), (0, 8), (0, 9)]
    f = spark.createDataFrame([(e, None, s, None) for e, s in rows], "episode_index long, frame_index long, arrival_seq long, language string")
    got = [(x.run, x.frame) for x in clips.streamed_episodes(f).orderBy("arrival_seq").collect()]
    assert got == [(1, 0), (1, 1), (2, 0), (3, 0), (3, 1)]


def test_runs_across_stretches(spark):
    values = [1, 1, 2, 2, 2, 1, 3, 3, 3, 3, 1]
    f = spark.createDataFrame([(v, i * 3) for i, v in enumerate(values)], "v long, o long")
    got = [x.run for x in numbering.run_ids(f, "v", "o", span=4).orderBy("o").collect()]
    assert got == [1, 1, 2, 2, 2, 3, 4, 4, 4, 4, 5]


def test_global_index(spark):
    f = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"))
    got = numbering.global_index(f, ["k"], "n").orderBy("k").collect()
    assert [x.n for x in got] == list(range(1000))


def test_nested_keys(spark):
    d = spark.createDataFrame([(1, ((2,),))], "`a.b.c` int, a struct<b: struct<c: int>>")
    assert d.select(clips.nested(d, "a.b.c").alias("x")).first().x == 1
    assert d.drop("a.b.c").select(clips.nested(d.drop("a.b.c"), "a.b.c").alias("x")).first().x == 2
    with pytest.raises(KeyError):
        clips.nested(d, "a.z")


def test_grid_and_box(spark):
    g = Grid(4, 3)
    assert (g.tokens, g.middle) == (36, 2)
    row = spark.createDataFrame([(23,)], "p int").select(g.t(F.col("p")).alias("t"), g.r(F.col("p")).alias("r"), g.c(F.col("p")).alias("c")).first()
    assert tuple(row) == (2, 1, 2)
    assert Box(0, 1, 1, 2).patches(g) == [1, 2, 4, 5]
    for bad in (Box(1, 0, 0, 0), Box(0, 3, 0, 0), Box(-1, 0, 0, 0)):
        with pytest.raises(ValueError):
            bad.patches(g)


def clustered(spark, n: int, centres: int, d: int = 64, seed: int = 1):
    r = np.random.default_rng(seed)
    points = r.normal(size=(centres, 4)) @ r.normal(size=(4, d))
    x = points[r.integers(0, centres, n)] + 0.01 * r.normal(size=(n, d))
    return spark.createDataFrame([(i // 16, i % 16, v.tolist()) for i, v in enumerate(x)], "clip_id long, token_pos int, vec array<double>")


def test_fitted_model_keeps_clustered_tokens(spark, tmp_path):
    t = clustered(spark, 800, 8).persist()
    m = compress.fit(t, width=8, n_centroids=8)
    assert compress.fidelity(t, m).agg(F.avg("cosine")).first()[0] > 0.97
    m.save(spark, str(tmp_path / "m"))
    back = compress.Model.load(spark, str(tmp_path / "m"))
    assert np.allclose(back.centroids, m.centroids) and np.allclose(back.levels, m.levels) and np.allclose(back.mean, m.mean)


def test_wide_tokens(spark):
    """As many dimensions as real encoders have: nothing is written out as columns, and the projection is what PCA says."""
    t = clustered(spark, 480, 6, d=1280, seed=3).persist()
    m = compress.fit(t, width=128, n_centroids=64)
    assert len(m.mean) == 1280 and m.width == 128
    x = np.array([r.vec for r in t.orderBy("clip_id", "token_pos").collect()])
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(np.array(m.components) @ np.array(m.components).T, np.eye(128), atol=1e-6)
    y = np.array([r.y for r in compress.projected(t, m).orderBy("clip_id", "token_pos").collect()])
    assert np.allclose(y, (x - x.mean(0)) @ np.array(m.components).T)
    assert compress.fidelity(t, m).agg(F.avg("cosine")).first()[0] > 0.9


def test_samples_move_keys_only(spark):
    rows = spark.range(3000).selectExpr("id % 7 AS batch", "id AS pos", "array_repeat(cast(id AS double), 64) AS vec")
    got = compress.sampled(rows, 100)
    assert got.columns == rows.columns and got.count() == 100 and {x.batch: x["count"] for x in got.groupBy("batch").count().collect()}.keys() == set(range(7))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "vec" not in window.split("Relation")[0].split("Range")[0]


def test_model_limits(spark):
    with pytest.raises(ValueError):
        compress.fit(clustered(spark, 64, 2), width=6, n_centroids=2)
    with pytest.raises(ValueError):
        compress.fit(clustered(spark, 64, 2), width=8, n_centroids=65_536)
    with pytest.raises(RuntimeError):
        compress.Model([0.0], [[1.0]], []).require("centroids")


def test_large_codebook_equals_small(spark, monkeypatch):
    t = clustered(spark, 64, 4, d=8).withColumn("y", F.col("vec"))
    book = np.random.default_rng(0).normal(size=(12, 8)).tolist()
    a = compress.assigned(t, book).orderBy("clip_id", "token_pos").collect()
    monkeypatch.setattr(compress, "SMALL_CODEBOOK", 2)
    b = compress.assigned(t, book).orderBy("clip_id", "token_pos").collect()
    assert [x.centroid_id for x in a] == [x.centroid_id for x in b]


def test_kernels_compress_as_columns_do(spark, monkeypatch):
    t = clustered(spark, 160, 4).persist()
    m = compress.fit(t, width=8, n_centroids=8)
    forms = []
    for small in (10**6, 0):
        monkeypatch.setattr(compress, "SMALL_PROJECTION", small)
        rows = compress.compressed(t, m)
        back = compress.decompressed(rows, m)
        forms.append([(x.clip_id, x.token_pos, x.centroid_id, x.packed, [round(v, 6) for v in x.y], [round(v, 6) for v in x.vec]) for x in back.orderBy("clip_id", "token_pos").collect()])
        y = compress.projected(t, m).orderBy("clip_id", "token_pos").first().y
        assert np.allclose(y, forms[0][0][4], atol=1e-5)
    assert forms[0] == forms[1]


def test_allocation_is_exact(spark):
    b = spark.createDataFrame([(i, n) for i, n in enumerate([5, 1, 1, 10, 3])], "batch long, n long")
    got = [x["take"] for x in compress.allocation(b, 7).orderBy("batch").collect()]
    assert sum(got) == 7 and all(g <= n for g, n in zip(got, [5, 1, 1, 10, 3], strict=True))
    assert [x["take"] for x in compress.allocation(b, 100).orderBy("batch").collect()] == [5, 1, 1, 10, 3]


def corpus(spark, n=200, d=8, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, d))
    x = centres[np.arange(n) % 20] + 0.01 * r.normal(size=(n, d))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "clip_id long, coarse array<double>")


def test_coarse_search_and_guards(spark):
    x, c = corpus(spark)
    got = [r.clip_id for r in search.coarse_search(c, x[5].tolist(), 10).orderBy("rank").collect()]
    assert got[0] == 5 and all(i % 20 == 5 for i in got)
    with pytest.raises(ValueError):
        search.coarse_search(c, x[5].tolist(), 0)
    with pytest.raises(Exception, match="width"):
        search.coarse_search(c, [1.0], 3).collect()


def test_index_recall(spark, tmp_path):
    _, c = corpus(spark)
    index.Index.build(c, str(tmp_path / "i"), lists=8, probes=4)
    assert index.validate(index.Index.open(spark, str(tmp_path / "i"), 4), c) > 0.95
    x, _ = corpus(spark)
    hit = index.Index.open(spark, str(tmp_path / "i"), 4).search(spark, x[3].tolist(), 5).orderBy("rank").first()
    assert hit.clip_id == 3


def test_recall_gate(spark, tmp_path):
    r = np.random.default_rng(0)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(300, 16)))], "clip_id long, coarse array<double>")
    built = index.Index.build(c, str(tmp_path / "i"), lists=30, probes=1)
    with pytest.raises(index.RecallError):
        index.validate(built, c)


def test_maxsim_forms_agree(spark):
    r = np.random.default_rng(2)
    t = spark.createDataFrame([(i, r.normal(size=(6, 4)).tolist()) for i in range(9)], "clip_id long, tokens array<array<double>>")
    q = r.normal(size=(5, 4)).tolist()
    a = search.maxsim_scores(t, q).orderBy("clip_id").collect()
    b = search.maxsim_scores(t, q, kernel=True).orderBy("clip_id").collect()
    assert [x.score for x in a] == pytest.approx([x.score for x in b], abs=1e-6)


def test_transition_limits(spark):
    cat = spark.createDataFrame(
        [(0, "a", 0.0, 1.0), (1, "a", 1.0, 2.0), (2, "a", 31.0, 32.0), (3, "a", 31.1, 32.0), (4, "b", 5.0, 5.0), (5, "c", 0.0, 9.0)],
        "clip_id long, episode_id string, timestamp_start double, timestamp_end double",
    ).withColumns({"dataset_name": F.lit("d"), "robot_type": F.lit("r")})
    scored = lambda rows: spark.createDataFrame([(i, s, k + 1) for k, (i, s) in enumerate(rows)], "clip_id long, score double, rank int")
    got = search.transitions(scored([(0, 0.9), (4, 0.5), (5, 0.4)]), scored([(2, 0.9), (1, 0.9), (3, 1.0), (4, 0.5), (5, 0.9)]), cat).orderBy("rank").collect()
    # Gaps of 0 and 30 count, 30.1 does not; of equal scores the better rank wins; a clip of no length follows itself.
    assert [(x.episode_id, x.clip_id, x.first_clip) for x in got] == [("a", 2, 0), ("b", 4, 4)]
    assert got[0].language_instruction is None


def test_trajectory_prune_changes_nothing(spark):
    r = np.random.default_rng(5)
    rows = [(f"e/{e}", s, r.normal(size=4).tolist()) for e in range(12) for s in range(int(r.integers(3, 9)))]
    steps = spark.createDataFrame(rows, "episode_id string, step long, vec array<double>")
    a = trajectory.rank(steps, "e/0", 4).orderBy("rank").collect()
    b = trajectory.rank(steps, "e/0", 4, prune=True).orderBy("rank").collect()
    assert a == b and len(a) == 4
    with pytest.raises(ValueError):
        trajectory.rank(steps, "e/0", 0)


def test_pooling_and_units(spark):
    t = spark.createDataFrame([(1, 0, [3.0, 4.0]), (1, 1, [1.0, 0.0]), (2, 0, [0.0, 0.0])], "clip_id long, token_pos int, vec array<double>")
    got = {x.clip_id: x.coarse for x in tokens.pooled(t, 2).collect()}
    assert got == {1: [2.0, 2.0], 2: [0.0, 0.0]}
    unit = [x.vec for x in tokens.unit(t, "vec").orderBy("clip_id", "token_pos").collect()]
    assert unit == [[0.6, 0.8], [1.0, 0.0], [0.0, 0.0]]


def odd_vectors(n=3000, d=6, seed=7):
    """Vectors with copies, near ties, zeros, and every 50th one odd: null, short, with a null, not a number, infinite."""
    r = np.random.default_rng(seed)
    x = r.integers(-2, 3, size=(n, d)).astype(float) + r.choice([0.0, 1e-7, 1e-6], size=(n, 1))
    odd = [None, [1.0, 2.0], [None] + [1.0] * (d - 1), [math.nan] + [1.0] * (d - 1), [math.inf] + [1.0] * (d - 1), [0.0] * d]
    return [(None if i == 77 else i * 7919 % n, odd[i // 50 % 6] if i % 50 == 0 else v.tolist()) for i, v in enumerate(x)]


def by_query(found):
    return {q: sorted(((x.rank, x.clip_id, str(x.score)) for x in found if x.query_id == q)) for q in {x.query_id for x in found}}


def test_nearest_by_products_equal_columns(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 4000)  # several blocks
    rows = spark.createDataFrame(odd_vectors(), "clip_id long, vec array<double>").repartition(3)
    asked = rows.where("clip_id % 20 = 0").withColumnRenamed("clip_id", "query_id")
    products = search.knn_join(asked, rows, 10)
    # A struct is no whole number, so these meet by columns.
    columns = search.knn_join(asked, rows.select(F.struct("clip_id").alias("key"), "vec"), 10, key="key").withColumn("clip_id", F.col("key.clip_id"))
    assert by_query(products.collect()) == by_query(columns.collect())
    assert products.drop("rank").dtypes == [("query_id", "bigint"), ("clip_id", "bigint"), ("score", "double")]


def test_searches_pair_no_rows_in_the_jvm(spark, tmp_path):
    """Pairs of all queries and rows, made one by one, took minutes for 2,565 queries of 51,282 rows."""
    _, c = corpus(spark)
    asked = c.where("clip_id % 20 = 0").withColumnsRenamed({"clip_id": "query_id", "coarse": "vec"})
    built = index.Index.build(c, str(tmp_path / "i"), lists=8, probes=8)
    exact = search.knn_join(asked, c.withColumnRenamed("coarse", "vec"), 10)
    for found in (exact, built.knn(asked, 10)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "MapInArrow" in plan
    assert by_query(exact.collect()) == by_query(built.knn(asked, 10).collect())


def test_lists_that_a_query_asks(spark, tmp_path):
    """Every query gets the nearest rows of its own lists, and no other ones."""
    x, c = corpus(spark, n=400)
    built = index.Index.build(c, str(tmp_path / "i"), lists=8, probes=2)
    rows = {r.clip_id: (r.list, np.array(r.vec)) for r in spark.read.parquet(str(tmp_path / "i/vectors")).collect()}
    asked = c.where("clip_id % 20 = 3").withColumnsRenamed({"clip_id": "query_id", "coarse": "vec"})
    got = by_query(built.knn(asked, 5).collect())
    for q, found in got.items():
        near = built.nearest_lists(x[q].tolist())
        want = sorted((-round(float(v @ rows[q][1]), 6), i) for i, (at, v) in rows.items() if at in near)[:5]
        assert [i for _, i, _ in found] == [i for _, i in want]
    assert len(got) == 20


def test_rounding_is_spark_s(spark):
    x = [0.1234565, 0.1234575, -0.1234565, 0.12345649999999999, 0.9999995, -4e-7, 5e-7, 0.0, 1.0, -0.3]
    want = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6).alias("y")).collect()]
    assert kernels.rounded(np.array(x), 6).tolist() == want


def test_a_norm_is_computed_once(spark):
    """Once for each of its elements, the norms of these took longer than 40 s, as the work goes with the square of the width."""
    wide = spark.range(0, 200, 1, 4).select("id", F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda x: x + F.col("id") * 0.5).alias("vec"))
    began = time.perf_counter()
    got = tokens.unit(wide, "vec").select(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x).alias("n")).agg(F.min("n"), F.max("n")).first()
    assert got == pytest.approx((1.0, 1.0)) and time.perf_counter() - began < 20
