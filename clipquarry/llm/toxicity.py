"""Toxicity: cumulative-link ordinal regression on sparse text features, with expected severity as the result.

Grades come with the labels: whole numbers from 0 (harmless) up, as many as there are. The model is the proportional-odds one,
P(grade >= k) = sigmoid(w.x - t_k) with one weight vector w for all thresholds t_1 <= t_2 <= ..., fitted by penalised maximum likelihood.
Expected severity is the sum of these over k, and a document is toxic if P(grade >= 1) is at least CUT.

Features are the distinct words of the whole text and the first letters of its longer words (stems),
hashed. All that LEAST labelled documents of the sample have, harmful or not, go into the fit. A feature's value, where it occurs, is its log odds between harmful and other
documents, drawn in by one standard error; so what tells nothing starts at nothing, unseen words weigh nothing, and weights (of either sign) come from the fit, under a ridge penalty.
The fit uses a bounded sample of labelled documents, SAMPLE of grade 0 and as many above
in the order of a hash of their ids; all documents are scored, each where it is read.

Defined results: a null or empty text has no features and the grades' base score; labels that are null or below 0
are not used; a document with several labels has the largest; of rows that share an id the fit uses the first text in order; equal hashes of ids, where the sample ends, go by id;
without a label above 0 every document gets severity 0; repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, whole, written

#: Labelled documents of grade 0, and of higher grades, that the fit uses, at most.
SAMPLE = 4000
#: Letters of a stem, and the shortest word that has one.
STEM = 5
#: Documents of the sample that have a feature, at least.
LEAST = 3
#: Share of documents above grade 0 that the fit assumes, and its ridge penalty.
PRIOR, RIDGE = 0.3, 3e-4
CUT = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> np.ndarray:
    """Hashes of the distinct words and stems of a text."""
    words = set(_WORD.findall(text.lower()))
    words |= {"^" + w[:STEM] for w in words if len(w) > STEM}
    return np.unique(np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = pa.array([features(t or "").tobytes() for t in batch.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), x], ["y", "x"])


def sample(docs: DataFrame, labels: DataFrame, size: int) -> list[tuple[int, np.ndarray]]:
    """(grade, features) of at most ``size`` labelled documents of grade 0 and as many of higher ones."""
    order = F.md5(F.concat(F.lit("toxicity:"), F.col("id").cast("string")))
    marks = labels.where("y >= 0 and id is not null").groupBy("id").agg(F.max("y").cast("int").alias("y")).withColumn("o", order)
    ids = written(marks.where("y = 0").orderBy("o", "id").limit(size).unionByName(marks.where("y > 0").orderBy("o", "id").limit(size)).select("y", "id"))  # at most 2 * size rows
    met = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).groupBy("id").agg(F.first("y").alias("y"), F.min("t").alias("t")).select("y", "t")
    got = met.mapInArrow(_extract, "y int, x binary").toArrow()
    rows = sorted((y, bytes(x)) for y, x in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    return [(y, np.frombuffer(x, np.uint32)) for y, x in rows]


class Loss:
    """The negative log-likelihood of grades, weighted by document, and a ridge penalty; rows are sparse, given as (row, column, value)."""

    def __init__(self, grade: np.ndarray, say: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, width: int, ridge: float) -> None:
        self.grade, self.say, self.row, self.col, self.value, self.width, self.ridge = grade, say, row, col, value, width, ridge
        self.top = int(grade.max())

    def at(self, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(loss, its gradients in w and t); infinite where thresholds are out of order."""
        if (np.diff(t) <= 0).any():
            return np.inf, w, t
        n, g = len(self.grade), self.grade
        z = np.bincount(self.row, w[self.col] * self.value, n)[:, None] - t
        above = np.c_[np.ones(n), 1 / (1 + np.exp(-np.clip(z, -60, 60))), np.zeros(n)]
        i = np.arange(n)
        p = np.maximum(above[i, g] - above[i, g + 1], 1e-300)
        error = -(1 - above[i, g] - above[i, g + 1]) * self.say
        slope = above * (1 - above) * (self.say / p)[:, None]
        dt = np.array([slope[g == k, k].sum() - slope[g == k - 1, k].sum() for k in range(1, self.top + 1)])
        dw = np.bincount(self.col, error[self.row] * self.value, self.width) + self.ridge * w
        return float(-(self.say * np.log(p)).sum() + self.ridge / 2 * (w @ w)), dw, dt


def solve(loss: Loss, t: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least loss, by gradient steps with momentum, each as long as the loss allows."""
    w = np.zeros(loss.width)
    v, u, pace, rate = w, t, 1.0, 1.0
    for _ in range(steps):
        value, dw, dt = loss.at(v, u)
        size = dw @ dw + dt @ dt
        if size < 1e-16:
            break
        while loss.at(v - rate * dw, u - rate * dt)[0] > value - rate / 2 * size + 1e-15:
            rate /= 2
        w_next, t_next = v - rate * dw, u - rate * dt
        # Momentum starts anew where it leads uphill or out of order.
        back = dw @ (w_next - w) + dt @ (t_next - t) > 0
        pace_next = 1.0 if back else (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = 0.0 if back else (pace - 1) / pace_next
        v, u = w_next + ahead * (w_next - w), t_next + ahead * (t_next - t)
        if (np.diff(u) <= 0).any():
            v, u = w_next, t_next
        w, t, pace, rate = w_next, t_next, pace_next, rate * 1.2
    return w, t


def fit(rows: list[tuple[int, np.ndarray]], steps: int = 150) -> dict:
    """The model: features (sorted hashes), weights, thresholds; the thresholds are infinite if no document is above grade 0."""
    grade = np.array([y for y, _ in rows], int)
    harmful = grade > 0
    if not harmful.any():
        return {"features": np.empty(0, np.int64), "weights": np.empty(0), "thresholds": np.full(1, np.inf)}
    # Grades that no document has are left out of the fit, and have the next one's threshold.
    kinds = np.unique(np.r_[0, grade])
    grade = np.searchsorted(kinds, grade)
    some, none = harmful.sum(), (~harmful).sum()
    # The share of harmful documents is fixed, whatever it is in the sample.
    say = np.where(harmful, PRIOR / some, (1 - PRIOR) / max(none, 1))
    vocabulary, col = np.unique(np.concatenate([x for _, x in rows]), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(x) for _, x in rows])
    there = np.bincount(col, harmful[row], len(vocabulary))
    else_ = np.bincount(col, ~harmful[row], len(vocabulary))
    odds = np.log((there + 0.5) / (some + 1)) - np.log((else_ + 0.5) / (none + 1))
    odds = np.sign(odds) * np.maximum(np.abs(odds) - np.sqrt(1 / (there + 0.5) + 1 / (else_ + 0.5)), 0)
    used = (there + else_ >= LEAST) & (odds != 0)
    number = np.cumsum(used) - 1
    use = used[col]
    vocabulary, odds, col, row = vocabulary[used], odds[used], number[col[use]], row[use]
    # Without features, thresholds are the shares of the grades.
    up = np.cumsum(np.bincount(grade, say, len(kinds))[::-1])[::-1][1:] / say.sum()
    up = np.clip(up, 1e-9, 1 - 1e-9)
    w, t = solve(Loss(grade, say, row, col, odds[col], len(vocabulary), RIDGE), np.log((1 - up) / up), steps)
    at = np.searchsorted(kinds, np.arange(1, kinds[-1] + 1)) - 1
    return {"features": vocabulary.astype(np.int64), "weights": w * odds, "thresholds": t[at]}


def severity(model: dict, x: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k from 1."""
    at = np.searchsorted(model["features"], x)
    at = at[at < len(model["features"])] if len(model["features"]) == 0 else np.minimum(at, len(model["features"]) - 1)
    known = model["features"][at] == x[: len(at)]
    z = model["weights"][at[known]].sum() - model["thresholds"]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500))) if np.isfinite(z).all() else np.zeros(len(z))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        telling = set(model["features"].tolist())
        cache: dict[str, tuple[int, ...]] = {}

        def hashes(w: str) -> tuple[int, ...]:
            found = tuple(h for h in (zlib.crc32(w.encode()), zlib.crc32(("^" + w[:STEM]).encode()) if len(w) > STEM else -1) if h in telling)
            if len(cache) < 500_000:
                cache[w] = found
            return found

        for batch in slices(batches, 2048):
            ps = []
            for text in batch.column(1).to_pylist():
                x = {h for w in set(_WORD.findall((text or "").lower())) for h in (cache[w] if w in cache else hashes(w))}
                ps.append(severity(model, np.fromiter(sorted(x), np.int64, len(x))))
            p = np.array(ps).reshape(-1, len(model["thresholds"]))
            grade = (p >= 0.5).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(grade.astype(np.int32)), pa.array(p[:, 0] >= CUT)], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return run


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label_id: str = "doc_id", label: str = "toxic", size: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, severity (expected grade), p_toxic (of any grade above 0), grade (the largest that is as likely as not) and toxic.

    ``label`` names a column of whole grades from 0 up; 0 and 1 make a model with one threshold.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), whole(text).alias("t"))
    marks = labels.select(F.col(f"`{label_id}`").alias("id"), F.col(f"`{label}`").alias("y"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample(rows, marks, size)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_score(shared), f"doc_id {kind}, severity double, p_toxic double, grade int, toxic boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of this table know two grades, toxic or not, so this model has one threshold and severity lies in 0 to 1."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return score(docs, labels)
