"""The searches as a service: an engine over finished artefacts, a gate for concurrent queries, and HTTP."""

from __future__ import annotations

import json
import os
import threading
import time
from base64 import b64decode
from collections.abc import Callable
from dataclasses import dataclass
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import compress, index, search, trajectory
from ..operators.tokens import Box, Grid
from ..sources.datasets import Compression, Serving
from . import jobs


class Engine:
    """Searches over the artefacts of a pipeline. encode makes of an image the tokens of a clip (tokens x dimensions), before projection.

    Coarse search is exact. It goes through the index only where that has a recorded recall above index.LEAST_RECALL, with no more probes than are asked for here, over
    all the vectors that there are now. A search of the index that finds fewer than it was asked for is made again exactly.
    """

    def __init__(self, spark: SparkSession, compression: Compression, index_path: str, encode: Callable[[bytes], np.ndarray], grid: Grid, probes: int = 16, coarse_k: int = 100) -> None:
        self.spark, self.compression, self.encode, self.grid, self.coarse_k = spark, compression, encode, grid, coarse_k
        self.catalog = spark.read.parquet(str(compression.catalog_path))
        self.model = compress.Model.load(spark, str(compression.model_dir))
        self.clips = self.catalog.count()
        known = index.recorded(spark, index_path)
        good = known is not None and known[1] > index.LEAST_RECALL and known[0] <= probes and known[2] == jobs.coarse_vectors(spark, compression.output_dir).count()
        self.index = index.Index.open(spark, index_path, probes) if good else None

    def nearest(self, coarse: list[float], k: int) -> DataFrame:
        """(clip_id, score, rank) of the k nearest clips."""
        if self.index is not None:
            found = self.index.search(self.spark, coarse, k)
            if found.count() >= min(k, self.clips):
                return found
        return search.coarse_search(jobs.coarse_vectors(self.spark, self.compression.output_dir), coarse, k)

    def query(self, image: bytes) -> tuple[list[list[float]], list[float]]:
        """(tokens of the middle slice, coarse vector) of an image, projected."""
        raw = np.asarray(self.encode(image), float)
        y = (raw - np.array(self.model.mean)) @ np.array(self.model.components).T
        if len(y) != self.grid.tokens:
            raise ValueError(f"the encoder made {len(y)} tokens, the grid has {self.grid.tokens}")
        middle = self.grid.middle * self.grid.side**2
        return y[middle : middle + self.grid.side**2].tolist(), y.mean(0).tolist()

    def frame_vectors(self, images: list[bytes]) -> list[list[float]]:
        """The coarse vector of each image: a trajectory made of pictures."""
        if not images:
            raise ValueError("a sequence has at least one image")
        return [self.query(x)[1] for x in images]

    def candidates(self, image: bytes, top_k: int | None, coarse_k: int, box: Box | None = None) -> DataFrame:
        tokens, coarse = self.query(image)
        if box is not None:
            tokens = [tokens[i] for i in box.patches(self.grid)]
        near = self.nearest(coarse, min(coarse_k, max(self.clips, 1)))
        return search.reranked(near, jobs.token_table(self.spark, self.compression, near), tokens, top_k, kernel=True)

    def search_image(self, image: bytes, top_k: int = 10, coarse_k: int = 100) -> DataFrame:
        return search.described(self.candidates(image, top_k, coarse_k), self.catalog).orderBy("rank")

    def search_spatial(self, image: bytes, box: Box, top_k: int = 10) -> DataFrame:
        return search.described(self.candidates(image, top_k, self.coarse_k, box), self.catalog).orderBy("rank")

    def search_transition(self, image_a: bytes, image_b: bytes, top_k: int = 10, max_gap: float = 30.0) -> DataFrame:
        a, b = (self.candidates(x, None, self.coarse_k) for x in (image_a, image_b))
        return search.transitions(a, b, self.catalog, max_gap, top_k).orderBy("rank")

    def search_trajectory(self, episode_id: str, top_k: int = 10, frame_k: int = 50) -> DataFrame:
        vectors = jobs.coarse_vectors(self.spark, self.compression.output_dir).join(self.catalog.select("clip_id", "episode_id", "timestamp_start"), "clip_id")
        steps = vectors.select("episode_id", F.struct("timestamp_start", "clip_id").alias("step"), V.doubles(F.col("coarse")).alias("vec"))
        return trajectory.search(steps, self.catalog, episode_id, top_k, frame_k).orderBy("rank")

    def episode(self, episode_id: str) -> DataFrame:
        found = search.episode_details(self.catalog.where(F.col("episode_id") == episode_id))
        if found.isEmpty():
            raise KeyError(episode_id)
        return found


class Service:
    """The engine behind a gate: searches that encode images wait for a place; trajectory and episode queries do not."""

    def __init__(self, engine, max_concurrent: int | None = None, model_id: str = "", device: str = "cpu") -> None:
        self.engine, self.model_id, self.device = engine, model_id, device
        self.limit = max_concurrent or max(1, os.cpu_count() or 1)
        if self.limit <= 0:
            raise ValueError("concurrent queries are positive")
        self._gate = threading.BoundedSemaphore(self.limit)
        self._began = time.time()

    def _gated(self, fn: Callable, *args):
        with self._gate:
            return rows(fn(*args))

    def image(self, image: bytes, top_k: int = 10, coarse_k: int = 100) -> list[dict]:
        return self._gated(self.engine.search_image, image, top_k, coarse_k)

    def spatial(self, image: bytes, box: Box, top_k: int = 10) -> list[dict]:
        return self._gated(self.engine.search_spatial, image, box, top_k)

    def transition(self, image_a: bytes, image_b: bytes, top_k: int = 10, max_gap: float = 30.0) -> list[dict]:
        return self._gated(self.engine.search_transition, image_a, image_b, top_k, max_gap)

    def trajectory(self, episode_id: str, top_k: int = 10) -> list[dict]:
        return rows(self.engine.search_trajectory(episode_id, top_k))

    def episode(self, episode_id: str) -> dict:
        return rows(self.engine.episode(episode_id))[0]

    def health(self) -> dict:
        return {"status": "ok", "indexed_clips": self.engine.clips, "model_id": self.model_id, "device": self.device, "uptime_seconds": round(time.time() - self._began, 3), "max_concurrent_queries": self.limit}


def rows(result) -> list[dict]:
    """A search's rows, top_k at most."""
    return [r.asDict() for r in result.collect()] if isinstance(result, DataFrame) else list(result)


class Invalid(Exception):
    """A request that lacks a field, or has one of the wrong kind: 422."""


#: Media types of uploads; one that says nothing of itself is taken as well.
MEDIA_TYPES = ("image/jpeg", "image/png", "image/webp", "application/octet-stream")


def status_of(error: BaseException) -> int:
    if isinstance(error, Invalid):
        return 422
    if isinstance(error, MemoryError) or isinstance(error, RuntimeError) and "out of memory" in str(error).lower():
        return 503
    if isinstance(error, KeyError | FileNotFoundError):
        return 404
    return 400 if isinstance(error, ValueError) else 500


def detail_of(error: BaseException) -> str:
    return str(error.args[0]) if isinstance(error, KeyError) and error.args else str(error)


@dataclass(frozen=True)
class Upload:
    data: bytes
    media_type: str | None = None


def fields_of(body: bytes, content_type: str, query: str) -> dict:
    """What a request carries: the query's values, and the parts of a form (files as Upload) or the members of a JSON object. Images in JSON are base64."""
    out: dict = {k: v[-1] for k, v in parse_qs(query).items()}
    if content_type.lower().startswith("multipart/form-data"):
        form = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
        if not form.is_multipart():
            raise Invalid("the form has no parts")
        for part in form.iter_parts():
            name = part.get_param("name", header="content-disposition")
            data = part.get_payload(decode=True) or b""
            said = part.get_content_type() if part["content-type"] else None
            out[name] = Upload(data, said) if part.get_filename() is not None or said else data.decode()
    elif body:
        try:
            got = json.loads(body)
        except ValueError as error:
            raise Invalid(f"the body is not JSON: {error}") from error
        if not isinstance(got, dict):
            raise Invalid("the body is not a JSON object")
        out |= got
    return out


def number(fields: dict, name: str, default, kind=int, least=1):
    try:
        x = kind(fields.get(name, default))
    except (TypeError, ValueError) as error:
        raise Invalid(f"{name} is not a number") from error
    if not x >= least:
        raise Invalid(f"{name} is at least {least}")
    return x


def picture(fields: dict, name: str) -> bytes:
    x = fields.get(name)
    if isinstance(x, Upload):
        if x.media_type is not None and x.media_type.lower() not in MEDIA_TYPES:
            raise ValueError("an image is JPEG, PNG or WebP")
        return x.data
    if not isinstance(x, str):
        raise Invalid(f"{name} is missing")
    try:
        return b64decode(x, validate=True)
    except ValueError as error:
        raise Invalid(f"{name} is not base64") from error


def region(fields: dict) -> Box:
    x = fields.get("bbox")
    try:
        x = json.loads(x) if isinstance(x, str) else x
        edges = {k: x[k] for k in ("row_start", "row_end", "col_start", "col_end")}
        if any(isinstance(v, bool) or int(v) != v for v in edges.values()):
            raise ValueError("the edges are whole numbers")
        return Box(**{k: int(v) for k, v in edges.items()})
    except (KeyError, TypeError, ValueError) as error:
        raise Invalid(f"bbox is an object with row_start, row_end, col_start and col_end: {error}") from error


def handler(service: Service, log: Callable[[str, str, int, float], None] | None = None) -> type[BaseHTTPRequestHandler]:
    """POST /search/{image,spatial,trajectory,transition}, GET /episodes/{id} and /health; searches answer with a list.

    Images are files of a multipart form or base64 in a JSON object; numbers may stand in the query. Statuses: 422 for a field that is missing or of the wrong
    kind, 400 for an image or value that cannot be used, 404 for what is not there, 503 out of memory.
    """

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, work: Callable[[], object]) -> None:
            began, code = time.perf_counter(), 500
            try:
                try:
                    body, code = work(), 200
                except Exception as error:
                    code, body = status_of(error), {"detail": detail_of(error)}
                data = json.dumps(body, default=str).encode()
                self.send_response(code)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)
            finally:
                if log:
                    log(self.command, self.path, code, time.perf_counter() - began)

        def do_GET(self) -> None:
            path = urlsplit(self.path).path
            if path == "/health":
                self._answer(service.health)
            elif path.startswith("/episodes/"):
                self._answer(lambda: service.episode(unquote(path.removeprefix("/episodes/"))))
            else:
                self._answer(lambda: (_ for _ in ()).throw(KeyError(path)))

        def do_POST(self) -> None:
            self._answer(self._search)

        def _search(self) -> list[dict]:
            url = urlsplit(self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if url.path not in ("/search/image", "/search/spatial", "/search/trajectory", "/search/transition"):
                raise KeyError(url.path)
            given = fields_of(body, self.headers.get("Content-Type") or "", url.query)
            top_k = number(given, "top_k", 10)
            if url.path == "/search/image":
                return service.image(picture(given, "image"), top_k, number(given, "coarse_k", 100))
            if url.path == "/search/spatial":
                return service.spatial(picture(given, "image"), region(given), top_k)
            if url.path == "/search/transition":
                return service.transition(picture(given, "state_a"), picture(given, "state_b"), top_k, number(given, "max_gap_seconds", 30.0, float, 0))
            episode = given.get("episode_id")
            if not isinstance(episode, str) or not episode:
                raise Invalid("episode_id is missing")
            return service.trajectory(episode, top_k)

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(service: Service, settings: Serving) -> None:
    with ThreadingHTTPServer((settings.host, settings.port), handler(service)) as server:
        server.serve_forever()
