from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from base64 import b64encode
from http.server import ThreadingHTTPServer
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipquarry.plans import cli, jobs
from clipquarry.plans.control import TaskStore
from clipquarry.plans.orchestrator import STAGES, Orchestrator, human_bytes, seconds_left, stage_name
from clipquarry.operators import index
from clipquarry.plans.serve import Engine, Service, handler
from clipquarry.operators.tokens import Box, Grid
from clipquarry.sources import shards
from clipquarry.sources.datasets import Dataset, Pipeline, load_all, read_frames
from clipquarry.sources.images import decode_image, load, model_of


def toy_encoder():
    """A model: 8 tokens of 16 dimensions from a clip's images, near one of a few directions by what the images hold."""
    directions = np.random.default_rng(0).normal(size=(4, 8, 16))

    def model(clips):
        out = []
        for images in clips:
            first = images[0][0] if images and images[0] else 0
            noise = np.random.default_rng(first).normal(size=(8, 16))
            out.append(directions[first % 4] + 0.02 * noise)
        return np.array(out)

    return model


def write_config(tmp_path: Path, spark) -> Path:
    rows = [(e, f, bytearray([e * 10 + f % 7]), None if f else f"do {e}", e * 100 + f) for e in range(6) for f in range(30)]
    source = str(tmp_path / "frames")
    spark.createDataFrame(rows, "episode_index long, frame_index long, picture binary, words string, arrival_seq long").write.parquet(source)
    (tmp_path / "sets").mkdir()
    (tmp_path / "sets" / "arm.yaml").write_text(f"repo_id: hub/arm\nimage_key: picture\nlanguage_key: words\nsource_fps: 4\ntarget_fps: 4\nrobot_type: rb\nclip_length: 8\nclip_stride: 4\npath: {source}\n")
    at = tmp_path / "pipeline.yaml"
    at.write_text("datasets: [sets/arm.yaml]\noutput_dir: out\nextraction: {encoder: 'test_plans:toy_encoder', batch_size: 3, flush_size: 10}\ncompression: {width: 8, n_centroids: 16, sample_size: 300}\nindex: {lists: 4, probes: 4}\n")
    return at


def test_whole_pipeline(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.syspath_prepend(str(Path(__file__).parent))
    at = write_config(tmp_path, spark)
    config = Pipeline.from_yaml(at)
    assert config.compression.raw_dir == config.extraction.output_dir and config.output_dir == str((tmp_path / "out").resolve())
    work = Orchestrator(spark, config)
    status = work.run()
    assert [t["status"] for t in status["tasks"]] == ["completed"] * 3 and status["clips"] == 42 and status["seconds_left"] == 0.0
    assert work.store.checkpoint("extract") == "41" and work.store.checkpoint("compress") == "4"
    # Run again: nothing is due.
    assert work.run()["clips"] == 42
    catalog = spark.read.parquet(str(config.compression.catalog_path)).orderBy("clip_id").collect()
    assert [(x.shard_id, x.shard_offset) for x in catalog[9:12]] == [(0, 9), (1, 0), (1, 1)]
    read = shards.read(spark, str(config.compression.shard_dir))
    heads = shards.headers(spark, str(config.compression.shard_dir)).orderBy("shard_id").collect()
    assert read.count() == 42 and [h.clips for h in heads] == [10, 10, 10, 10, 2] and heads[0].size == shards.record_size(8, 2, 8)
    records = spark.read.parquet(str(config.compression.output_dir / "records"))
    assert read.select("shard_id", "shard_offset", "residuals").exceptAll(records.select("shard_id", "shard_offset", "residuals").withColumn("shard_id", F.col("shard_id").cast("long"))).isEmpty()
    one = spark.createDataFrame([(1, 5)], "shard_id long, shard_offset long")
    assert shards.fetch(read, one).count() == 1
    with pytest.raises(Exception, match="outside"):
        shards.fetch(read, spark.createDataFrame([(1, 99)], "shard_id long, shard_offset long")).collect()
    report = work.validate()
    assert report["recall"] > 0.95 and report["mean_cosine"] > 0.9 and len(report["sample_queries"]) == 3 and all(len(v) == 5 for v in report["sample_queries"].values())
    assert all(n > 0 for n in report["sizes"].values()) and json.loads(jobs.as_json(report))["sampled_clips"] == 42
    assert cli.main(["status", "--config", str(at)], make=lambda p: work) == 0
    assert cli.main(["validate", "--config", str(at)], make=lambda p: work) == 0
    assert "recall" in capsys.readouterr().out

    model = toy_encoder()
    engine = Engine(spark, config.compression, str(config.index.output_path), lambda image: model([[image]])[0], Grid(2, 2), 4)
    image = bytes([13])  # the first image of a clip of episode 1
    hits = engine.search_image(image, 5, 42).collect()
    assert len(hits) == 5 and [h.rank for h in hits] == [1, 2, 3, 4, 5] and hits[0].score >= hits[4].score
    assert len(engine.search_spatial(image, Box(0, 0, 0, 1), 3).collect()) == 3
    assert engine.search_transition(image, image, 10, 30.0).count() > 0
    assert engine.search_trajectory("hub/arm_1", 3).count() == 3
    assert engine.episode("hub/arm_1").first().clip_count == 7
    assert np.shape(engine.frame_vectors([image, bytes([20])])) == (2, 8)
    with pytest.raises(ValueError):
        engine.frame_vectors([])
    with pytest.raises(KeyError):
        engine.episode("hub/none")
    with pytest.raises(KeyError):
        engine.search_trajectory("hub/none")

    # Exact unless the index is known to be good: fewer probes than the recall was recorded with, a poor recall or another number of vectors rule it out.
    at_index = str(config.index.output_path)
    assert engine.index is not None and index.recorded(spark, at_index) == (4, 1.0, 42)
    new = lambda probes: Engine(spark, config.compression, at_index, engine.encode, Grid(2, 2), probes)
    exact = new(2)
    assert exact.index is None and [tuple(x) for x in exact.search_image(image, 5, 42).collect()] == [tuple(x) for x in hits]
    query = exact.query(image)[1]
    assert [tuple(x) for x in exact.nearest(query, 42).orderBy("rank").collect()] == [tuple(x) for x in engine.nearest(query, 42).orderBy("rank").collect()]
    index.record(spark, at_index, 4, 0.9, 42)
    assert new(4).index is None
    index.record(spark, at_index, 1, 0.99, 42)
    few = new(1)  # one list has too few clips for this search, which is then exact
    assert few.index is not None and few.nearest(query, 42).count() == 42
    # A completed index that lacks records is built again.
    index.record(spark, at_index, 4, 1.0, 41)
    assert new(4).index is None and work.run()["clips"] == 42 and index.recorded(spark, at_index)[2] == 42

    work.run_stage("compress")
    assert [t["status"] for t in work.status()["tasks"]] == ["completed", "completed", "pending"]


def test_what_encoders_return():
    x = np.arange(6, dtype=np.float64).reshape(1, 2, 3)

    class Tensor:
        def __init__(self):
            self.done = []

        def __getattr__(self, name):
            if name not in ("detach", "cpu", "float"):
                raise AttributeError(name)
            return lambda: (self.done.append(name), self)[1]

        def __array__(self, dtype=None, copy=None):
            return x.astype(dtype or x.dtype)

    class Out:
        vision_features = x

    class Both(Out):
        last_hidden_state = x + 1

    for out in (x, (x, None), {"last_hidden_state": x, "vision_features": x + 1}, {"vision_features": x}, Out(), ({"last_hidden_state": x},), Tensor()):
        got = jobs.features_of(out)
        assert got.dtype == np.float32 and (got == x).all()
    assert (jobs.features_of(Both()) == x + 1).all()
    with pytest.raises(ValueError):
        jobs.features_of({"logits": x})


def test_processors():
    images = [b"a", b"b"]
    assert jobs.prepared(None, images) is images
    clip = np.zeros((2, 3, 4, 4))
    for made in (clip, clip[None], {"pixel_values": clip[None]}, {"pixel_values_videos": clip}, {"pixel_values": None, "pixel_values_videos": clip[None]}):
        assert jobs.prepared(lambda x, made=made: made, images).shape == clip.shape
    assert jobs.prepared(lambda x: np.zeros((2, 2, 3, 4, 4)), images).shape == (2, 2, 3, 4, 4)
    with pytest.raises(ValueError):
        jobs.prepared(lambda x: {"other": clip}, images)


def on_a_device(device, dtype):
    return device, dtype


def test_models_by_device(monkeypatch):
    monkeypatch.syspath_prepend(str(Path(__file__).parent))
    assert model_of("test_plans:on_a_device") == ("cpu", "float32") and model_of("test_plans:on_a_device", "cuda:1") == ("cuda:1", "float16")
    assert callable(model_of("test_plans:toy_encoder", "cuda"))


def samples(spark, dataset):
    """A source that yields frames one by one, as a remote one does."""
    for e in range(2):
        for f in range(600):
            yield {"episode_index": e, "observation": {"picture": bytes([e, f % 256])}, "words.said": None if f % 2 else f"do {e}"}


def tables(spark, dataset):
    return spark.range(3).selectExpr("id AS episode_index", "cast('x' AS binary) AS picture", "id AS arrival_seq")


def test_sources_as_plug_ins(spark, monkeypatch, tmp_path):
    monkeypatch.syspath_prepend(str(Path(__file__).parent))
    d = Dataset("hub/x", "observation.picture", 4, language_key="words.said", source="test_plans:samples")
    got = read_frames(spark, d).orderBy("arrival_seq").collect()
    assert len(got) == 1200 and [x.arrival_seq for x in got] == list(range(1200)) and got[700].episode_index == 1 and bytes(got[700].image) == bytes([1, 100])
    assert got[1].language is None and got[0].language == "do 0" and got[0].frame_index is None
    assert read_frames(spark, Dataset("hub/x", "picture", 4, source="test_plans:tables")).count() == 3
    spark.range(2).selectExpr("id AS episode_index", "'x' AS picture", "id AS arrival_seq").write.json(str(tmp_path / "j"))
    assert read_frames(spark, Dataset("hub/x", "picture", 4, path=str(tmp_path / "j"), format="json")).count() == 2
    with pytest.raises(ValueError):
        read_frames(spark, Dataset("hub/x", "picture", 4))
    with pytest.raises(KeyError):
        read_frames(spark, Dataset("hub/x", "no.picture", 4, source="test_plans:samples"))


def test_places(tmp_path):
    (tmp_path / "sets").mkdir()
    (tmp_path / "sets" / "a.yaml").write_text("repo_id: hub/a\nimage_key: i\nsource_fps: 15\n")
    (tmp_path / "p.yaml").write_text("datasets: [sets/a.yaml]\noutput_dir: s3a://bucket/run\n")
    c = Pipeline.from_yaml(tmp_path / "p.yaml")
    assert c.compression.model_dir == "s3a://bucket/run/compression/model" and c.index.output_path == "s3a://bucket/run/compression/index"
    assert c.pipeline_db == (tmp_path / "checkpoints" / "pipeline.sqlite3").resolve()


def test_shards_by_uri(spark, tmp_path):
    rows = [(s, o, [1, 2], bytearray([s, o, 3, 4]), [0.5, float(o)]) for s in range(3) for o in range(4)]
    for path in (str(tmp_path / "a"), f"file://{tmp_path}/b", f"file:{tmp_path}/c"):
        for _ in range(2):  # again over what is there
            shards.write(spark.createDataFrame(rows, shards.RECORDS), path)
        assert sorted((x.shard_id, x.shard_offset, bytes(x.residuals)) for x in shards.read(spark, path).collect()) == [(s, o, bytes(r)) for s, o, _, r, _ in rows]
    assert not list((tmp_path / "a").glob("*.tmp"))


def test_failure_and_resume(spark, tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(Path(__file__).parent))
    config = Pipeline.from_yaml(write_config(tmp_path, spark))
    work = Orchestrator(spark, config)
    right = work._execute
    monkeypatch.setattr(work, "_execute", lambda s: (_ for _ in ()).throw(OSError("no disk")) if s == "compress" else right(s))
    with pytest.raises(OSError):
        work.run()
    task = work.store.get("compress")
    assert (task.status, task.retry_count, task.error_message) == ("failed", 1, "no disk") and work.store.get("extract").status == "completed"
    monkeypatch.setattr(work, "_execute", right)
    assert [t["status"] for t in work.run()["tasks"]] == ["completed"] * 3


def test_store(tmp_path):
    s = TaskStore(tmp_path / "x" / "db.sqlite3")
    s.create("extract")
    s.create("extract", "failed")
    assert s.get("extract").status == "pending" and s.get("none") is None
    s.update("extract", "running")
    began = s.get("extract").started_at
    s.update("extract", "failed", "broken")
    assert s.get("extract").error_message == "broken" and s.get("extract").started_at == began and s.get("extract").completed_at is None
    assert s.retry("extract") == 1 and [t.task_name for t in s.pending()] == ["extract"]
    s.update("extract", "completed", "ignored")
    assert s.get("extract").error_message is None and s.get("extract").completed_at and not s.pending()
    s.set_checkpoint("extract", "7")
    s.set_metadata("m", {"clips": 12})
    s.set_metadata("m", {"clips": 13})
    assert s.checkpoint("extract") == "7" and s.metadata("m") == {"clips": 13} and s.metadata("none") is None
    for call in (lambda: s.update("none", "running"), lambda: s.retry("none"), lambda: s.checkpoint("none")):
        with pytest.raises(KeyError):
            call()
    with pytest.raises(ValueError):
        s.update("extract", "lost")


def test_small_helpers():
    assert stage_name(" Build-Index ") == "build_index" and human_bytes(512) == "512 B" and human_bytes(1536) == "1.5 KiB"
    with pytest.raises(ValueError):
        stage_name("fly")

    class T:
        def __init__(self, status):
            self.status = status

    assert seconds_left([T("pending")], 9) is None and seconds_left([T("completed")], 9) == 0.0
    assert seconds_left([T("completed"), T("running"), T("pending")], 30) == pytest.approx(30)


@pytest.mark.parametrize("command", ["run", "extract", "compress", "build-index", "status"])
def test_cli(command, capsys):
    class Fake:
        def __getattr__(self, name):
            return lambda *a: {"tasks": [{"task_name": "extract", "status": "running", "retry_count": 0, "error_message": None}], "clips": 3, "seconds_left": None}

    assert cli.main([command], make=lambda p: Fake()) == 0
    assert "extract: running" in capsys.readouterr().out


def test_configs(tmp_path):
    (tmp_path / "b.yml").write_text("repo_id: hub/b\nimage_key: i\nsource_fps: 5\n")
    (tmp_path / "a.yaml").write_text("repo_id: hub/a\nimage_key: i\nsource_fps: 15\n")
    (tmp_path / "c.txt").write_text("no")
    assert [d.repo_id for d in load_all(tmp_path)] == ["hub/a", "hub/b"]
    (tmp_path / "bad.yaml").write_text("- 1\n")
    with pytest.raises(TypeError):
        Dataset.from_yaml(tmp_path / "bad.yaml")
    with pytest.raises(KeyError):
        (tmp_path / "none.yaml").write_text("output_dir: x\n")
        Pipeline.from_yaml(tmp_path / "none.yaml")


def test_shard_codec():
    r = np.random.default_rng(0)
    ids, res, coarse = r.integers(0, 60_000, (3, 8)), r.integers(0, 256, (3, 8, 2), dtype=np.uint8), r.normal(size=(3, 8)).astype(np.float32)
    data = shards.encode(ids, res, coarse)
    assert len(data) == 32 + 3 * shards.record_size(8, 2, 8)
    back = shards.decode(data)
    assert (back["ids"] == ids).all() and (back["residuals"] == res).all() and (back["coarse"] == coarse).all()
    for broken in (data[:20], b"x" * 8 + data[8:], data[:-1]):
        with pytest.raises(ValueError):
            shards.decode(broken)
    with pytest.raises(ValueError):
        shards.encode(ids[:0], res[:0], coarse[:0])


def test_images():
    assert load("math:sqrt")(4) == 2
    with pytest.raises(ValueError):
        load("math")
    assert decode_image(b"x", lambda b: np.zeros((16, 20))).shape == (16, 20, 3)
    for data, decoder in ((b"", None), (b"x", lambda b: 1 / 0), (b"x", lambda b: np.zeros((8, 20, 3)))):
        with pytest.raises(ValueError):
            decode_image(data, decoder)


class FakeEngine:
    clips = 7

    def __init__(self):
        self.active = self.most = 0
        self.lock = threading.Lock()

    def search_image(self, image, top_k, coarse_k):
        with self.lock:
            self.active += 1
            self.most = max(self.most, self.active)
        time.sleep(0.02)
        with self.lock:
            self.active -= 1
        troubles = {b"broken": ValueError("no image"), b"memory": MemoryError(), b"device": RuntimeError("device: Out of memory"), b"other": RuntimeError("x")}
        if image in troubles:
            raise troubles[image]
        return [{"clip_id": len(image), "top_k": top_k}]

    def search_spatial(self, image, box, top_k):
        return [{"patches": box.patches(Grid(1, 16))}]

    def search_trajectory(self, episode_id, top_k):
        raise KeyError(episode_id)

    def search_transition(self, a, b, top_k, gap):
        return [{"gap": gap}]

    def episode(self, episode_id):
        return [{"episode_id": episode_id}]


def test_gate_and_http():
    engine = FakeEngine()
    service = Service(engine, 1)
    threads = [threading.Thread(target=service.image, args=(b"x",)) for _ in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert engine.most == 1
    seen = []
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(service, lambda *a: seen.append(a)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def call(path, form=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, json.dumps(form).encode() if form is not None else None)) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    def upload(path, *parts):
        body = b""
        for name, data, *kind in parts:
            file = f'; filename="{name}.png"\r\nContent-Type: {kind[0]}' if kind else ""
            body += f'--xyz\r\nContent-Disposition: form-data; name="{name}"{file}\r\n\r\n'.encode() + data + b"\r\n"
        request = urllib.request.Request(base + path, body + b"--xyz--\r\n", {"Content-Type": "multipart/form-data; boundary=xyz"})
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    picture = b64encode(b"abc").decode()
    box = json.dumps({"row_start": 0, "row_end": 0, "col_start": 1, "col_end": 2})
    assert call("/health")[1]["indexed_clips"] == 7
    assert call("/search/image", {"image": picture}) == (200, [{"clip_id": 3, "top_k": 10}])
    assert call("/search/spatial", {"image": picture, "bbox": box})[1] == [{"patches": [1, 2]}]
    assert call("/search/transition", {"state_a": picture, "state_b": picture})[1] == [{"gap": 30.0}]
    assert call("/search/trajectory", {"episode_id": "hub/x_1"}) == (404, {"detail": "hub/x_1"})
    assert call("/episodes/hub/x_1")[1] == {"episode_id": "hub/x_1"}
    # Forms, with numbers in the query; bytes of any value.
    png = ("image", bytes(range(256)), "image/png")
    assert upload("/search/image?top_k=2&coarse_k=4", png) == (200, [{"clip_id": 256, "top_k": 2}])
    assert upload("/search/spatial", png, ("bbox", box.encode()))[1] == [{"patches": [1, 2]}]
    assert upload("/search/transition?max_gap_seconds=1.5", ("state_a", b"a", "image/jpeg"), ("state_b", b"b", "image/webp"))[1] == [{"gap": 1.5}]
    wrong = {
        422: [
            call("/search/image", {}), call("/search/image", {"image": picture, "top_k": 0}), call("/search/image", {"image": picture, "top_k": "x"}), call("/search/spatial", {"image": picture, "bbox": "{"}),
            call("/search/spatial", {"image": picture}), call("/search/spatial", {"image": picture, "bbox": {"row_start": 0}}), call("/search/trajectory", {}), call("/search/trajectory", [1]),
            upload("/search/image?coarse_k=-1", png), upload("/search/transition?max_gap_seconds=-1", ("state_a", b"a", "image/png"), ("state_b", b"b", "image/png")), upload("/search/spatial", png),
        ],
        400: [upload("/search/image", ("image", b"x", "text/plain")), call("/search/image", {"image": b64encode(b"broken").decode()})],
        404: [call("/nowhere", {}), call("/nowhere")],
        503: [call("/search/image", {"image": b64encode(b"memory").decode()}), call("/search/image", {"image": b64encode(b"device").decode()})],
        500: [call("/search/image", {"image": b64encode(b"other").decode()})],
    }
    assert {code: {x[0] for x in got} for code, got in wrong.items()} == {code: {code} for code in wrong}
    server.shutdown()
    assert len(seen) == 9 + sum(map(len, wrong.values()))


def test_stages_are_named():
    assert STAGES == ("extract", "compress", "build_index")
