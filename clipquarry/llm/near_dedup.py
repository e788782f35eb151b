"""Near dedup by a chosen-path set similarity join on word shingles.

Documents with equal shingle sets become one class first, so copies cost nothing further. Each class
has TREES minwise tokens that choose its nodes in as many independent trees, and a sketch of 128 more, a byte
each. A node that is too large branches, again and again: two of its classes' minwise tokens, picked by the node, choose the
children, so a linked pair parts in a branch only if it differs in both. Small nodes are compared exhaustively by
sketch. A pair at the threshold meets in some tree with probability 1 - (1 - 0.85) ** 8 or better.
A large node that branching no longer parts is full of classes that are alike. It is cut into blocks, of which each is first
compared with the next one only; where that does not connect the whole node, all pairs of blocks are compared: slower, but whole.

Pairs that may be links make clusters, a few per cent of all classes; only for these the full sets are
made again and shuffled, each once, and inside a cluster links are confirmed exactly on full sets, skipping
pairs that are already connected. Large clusters are dealt out by pairs of blocks. The first tree runs
alone, and the others only look at nodes that its clusters do not hold already.

Defined results: a null text, or one without words, has the empty set and is linked with nothing; a text with fewer
words than a shingle has its whole sequence as one; rows without doc_id take no part unless their set
equals another's, and are kept; rows that share a doc_id count as one document, which all their texts link
(a row of it without words stays alone); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, few, slices, table, whole, written
from .groups import Forest, components, map_groups, stars

TREES, SKETCH = 8, 128
#: A child with a larger share of its parent's classes does not branch again.
PARTED = 0.7
#: Classes in a node that is compared in one task, and shingles in one that is confirmed there, at most (about).
NODE, NODE_SHINGLES = 4096, 8_000_000
#: Standard errors by which a sketch may fall short of the threshold.
SLACK = 4.5

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_random = np.random.Generator(np.random.PCG64(20240229))
_ODD64 = _random.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_ODD32 = (_random.integers(0, 1 << 31, SKETCH, np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD32 = _random.integers(0, 1 << 32, SKETCH, np.uint32)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A to Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()  # bytes.split() knows the six ASCII spaces only
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; of the whole sequence if it is shorter; none without words."""
    k = min(size, len(words))
    if not k:
        return words
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mixed(h * _ODD64[i] + words[i : i + n])
    return h


def shingles(text: str, size: int) -> np.ndarray:
    return np.unique(sequence_hashes(word_hashes(text), size))


def sketch(h: np.ndarray) -> tuple[bytes, bytes]:
    """(keys of the trees, sketch) of a set."""
    trees = [int((h * _ODD64[32 + t]).min()) for t in range(TREES)]
    keys = mixed(np.array(trees, np.uint64) + np.arange(TREES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = h.astype(np.uint32)
    least = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(least, (low[at : at + 4096, None] * _ODD32 + _ADD32).min(0), out=least)
    return keys.tobytes(), ((least * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


def digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, digests, keys, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingles(text, size) if text else np.empty(0, np.uint64)
                n.append(len(h))
                k, s = sketch(h) if len(h) else (None, None)
                digests.append(digest(h) if len(h) else None)
                keys.append(np.frombuffer(k, np.int64) if k else None)
                sketches.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "n", "digest", "keys", "sketch"])

    return run


def _sets(size: int):
    """(..., digest, t) -> (..., set): the sets of texts that have the digest asked for; a doc_id may stand for other texts too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            width = batch.num_columns - 2
            sets = [shingles(x or "", size) for x in batch.column(width + 1).to_pylist()]
            at = pa.array([i for i, (h, d) in enumerate(zip(sets, batch.column(width).to_pylist(), strict=True)) if digest(h) == d], pa.int64())
            packed = pa.array([sets[i].tobytes() for i in at.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:width]), packed], [*batch.schema.names[:width], "set"])

    return run


def _near(group: pa.Table, floor: float, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each member, the later ones that may be linked to it by sketch and size; those of one cluster, where it is given, are connected already."""
    n = group.column("n").to_numpy()
    s = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    cluster = group.column("cluster").to_numpy() if "cluster" in group.column_names else None
    need = int(np.ceil(floor * SKETCH))
    for i in range(len(n) - 1):
        ok = 100 * np.minimum(n[i], n[i + 1 :]) >= percent * np.maximum(n[i], n[i + 1 :])
        if cluster is not None:
            ok &= cluster[i + 1 :] != cluster[i]
        fits = np.flatnonzero(ok) + i + 1
        if len(fits):
            yield i, fits[np.count_nonzero(s[fits] == s[i], axis=1) >= need]


def _candidates(floor: float, percent: int):
    """For map_groups: stars of the classes in a node that may be linked, directly or by others."""

    def run(group: pa.Table) -> dict[str, np.ndarray]:
        forest = Forest(group.num_rows)
        for i, near in _near(group, floor, percent):
            for j in near.tolist():
                forest.join(i, j)
        return stars(group.column("cid").to_numpy(), forest)

    return run


def _confirmed(floor: float, percent: int):
    """For map_groups: stars of the classes in a cluster that are linked on full sets, directly or by others. Pairs that are connected already are skipped."""

    def run(group: pa.Table) -> dict[str, np.ndarray]:
        sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        forest, parts = Forest(len(sets)), len(sets)
        for i, found in _near(group, floor, percent):
            for j in found.tolist():
                if forest.find(i) != forest.find(j):
                    a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
                    at = np.searchsorted(b, a)
                    at[at == len(b)] = 0
                    both = int(np.count_nonzero(b[at] == a))
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        parts -= forest.join(i, j)
            if parts == 1:
                break
        return stars(group.column("cid").to_numpy(), forest)

    return run


def _grown(nodes: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, cid) -> (node, cid) of nodes small enough to compare, and (node, cid, size) of large ones that branching no longer parts, if any."""
    nodes = nodes.withColumn("was", F.lit(None).cast("long"))
    leaves = stuck = None
    depth = 0
    while True:
        sizes = nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        met = written(nodes.join(sizes, "node"))
        small = met.where(F.col("size") <= NODE).select("node", "cid")
        leaves = small if leaves is None else leaves.unionByName(small)
        large = met.where(F.col("size") > NODE)
        if large.isEmpty():
            return leaves, stuck
        alike = F.coalesce(F.col("size") > PARTED * F.col("was"), F.lit(False))
        stay = large.where(alike).select("node", "cid", "size")
        stuck = stay if stuck is None else stuck.unionByName(stay)
        at = lambda b: F.pmod(F.xxhash64("node", F.lit(depth), F.lit(b)), F.lit(SKETCH)).cast("int")  # noqa: B023, E731
        with_sketch = large.where(~alike).join(classes.select("cid", "sketch"), "cid")
        child = lambda b: F.xxhash64("node", at(b), F.substring(F.col("sketch"), at(b) + 1, F.lit(1)))  # noqa: B023, E731
        nodes = with_sketch.select("cid", F.col("size").alias("was"), F.explode(F.array_distinct(F.array(child(0), child(1)))).alias("node")).select("node", "cid", "was")
        depth += 1


def _blocks(rows: DataFrame, key: str, ring: bool = False) -> DataFrame:
    """Rows with parts > 1, once for each pair of blocks that holds theirs (in a ring, for the two with a neighbour); key becomes the pair's."""
    mine = F.pmod(F.xxhash64("cid"), F.col("parts"))
    others = F.array_distinct(F.array(F.pmod(F.col("mine") + 1, F.col("parts")), F.pmod(F.col("mine") - 1 + F.col("parts"), F.col("parts")))) if ring else F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(others))
    return rows.withColumn(key, F.xxhash64(key, F.least("mine", "other"), F.greatest("mine", "other"))).drop("mine", "other")


def _linked(nodes: DataFrame, classes: DataFrame, floor: float, percent: int) -> DataFrame:
    """(node, cid) -> (a, b): stars of classes that may be linked."""

    def compare(leaves: DataFrame) -> DataFrame:
        full = leaves.join(classes.select("cid", "n", "sketch"), "cid")
        return map_groups(full.select("node", *[c for c in full.columns if c != "node"]), "node", _candidates(floor, percent), "a long, b long")

    leaves, stuck = _grown(nodes, classes)
    found = written(compare(leaves))
    if stuck is None or stuck.isEmpty():
        return found
    stuck = stuck.withColumn("parts", F.ceil(F.col("size") / (NODE // 2)).cast("long"))
    found = found.unionByName(written(compare(_blocks(stuck, "node", ring=True).select("node", "cid"))))
    known = components(found).withColumnsRenamed({"id": "cid", "component": "cluster"})
    stuck = written(stuck.join(known, "cid", "left").withColumn("cluster", F.coalesce("cluster", "cid")))
    open_ = stuck.groupBy("node").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).where("x <> y").select("node")
    return found.unionByName(written(compare(_blocks(stuck.join(open_, "node"), "node").select("node", "cid", "cluster"))))


def _clusters(classes: DataFrame, floor: float, percent: int) -> DataFrame:
    """(id, component) of the classes that may be linked."""
    tree = lambda at: classes.select(F.explode(at).alias("node"), "cid")
    first = _linked(tree(F.slice("keys", 1, 1)), classes, floor, percent)
    known = components(first).withColumnsRenamed({"id": "cid", "component": "cluster"})
    others = tree(F.slice("keys", 2, TREES)).join(known, "cid", "left").withColumn("cluster", F.coalesce("cluster", "cid"))
    # A node inside one cluster has nothing to add.
    open_ = others.groupBy("node").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).where("x <> y").select("node")
    return components(first.unionByName(_linked(others.join(open_, "node").select("node", "cid"), classes, floor, percent)))


def _classes(described: DataFrame) -> DataFrame:
    """(cid, rep, digest, n, keys, sketch): one row per different set, under a number of its own; rep is the smallest doc_id that has it."""
    with_id = described.where("n > 0 and doc_id is not null")
    least = with_id.groupBy(F.col("digest").alias("d")).agg(F.min("doc_id").alias("rep"))
    # No id is below the least one: the rows meet by digest alone, and stay dealt by it.
    first = with_id.join(least, (F.col("digest") == F.col("d")) & (F.col("doc_id") <= F.col("rep"))).dropDuplicates(["digest"])
    return first.select(F.monotonically_increasing_id().alias("cid"), "rep", "digest", "n", "keys", "sketch")


def _same_id(described: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): stars of the classes that one doc_id stands for."""
    texts = described.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y"))
    many = few(written(texts.where("x <> y").select(F.col("doc_id").alias("m"))))
    asked = described.where("n > 0").join(many, F.col("doc_id") == F.col("m")).select("m", "digest").distinct()
    held = written(asked.join(classes.select(F.col("digest").alias("d"), "cid"), F.col("digest") == F.col("d")).select("m", "cid"))
    least = held.groupBy(F.col("m").alias("t")).agg(F.min("cid").alias("a"))
    return held.join(least, F.col("m") == F.col("t")).where("a <> cid").select("a", F.col("cid").alias("b"))


def link(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept.

    Documents are linked if their sets of ``size``-word shingles have 100 * intersection >= percent * union.
    """
    share = percent / 100
    floor = share - SLACK * (share * (1 - share) / SKETCH) ** 0.5
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), whole(text).alias("t"))
    described = written(rows.mapInArrow(_describe(size), "doc_id long, n long, digest binary, keys array<long>, sketch binary"))
    classes = written(_classes(described))
    clusters = written(_clusters(classes, floor, percent))
    weights = clusters.join(classes.select(F.col("cid").alias("id"), "n"), "id").groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("sum"))
    parts = F.ceil(F.greatest(F.col("size") / (NODE // 2), F.col("sum") / (NODE_SHINGLES // 2))).cast("long")
    asked = clusters.join(weights, "component").select("id", "component", F.when((F.col("size") <= NODE) & (F.col("sum") <= NODE_SHINGLES), 1).otherwise(parts).alias("parts"))
    asked = few(written(asked.join(classes.select("cid", "rep", "digest"), F.col("id") == F.col("cid")).select("id", "component", "parts", "rep", "digest")))
    sets = rows.join(asked, F.col("doc_id") == F.col("rep")).select("id", "component", "parts", "digest", "t")
    sets = sets.mapInArrow(_sets(size), "id long, component long, parts long, set binary").dropDuplicates(["id"])
    sets = sets.join(classes.select("cid", "n", "sketch"), F.col("id") == F.col("cid")).select("component", "parts", "cid", "n", "sketch", "set")
    sets = _blocks(sets, "component").select("component", "cid", "n", "sketch", "set")
    confirmed = written(map_groups(sets, "component", _confirmed(floor, percent), "a long, b long"))
    linked = written(components(confirmed.unionByName(_same_id(described, classes))))
    reps = classes.select("cid", "rep")
    least = linked.join(reps, F.col("id") == F.col("cid")).groupBy(F.col("component").alias("root")).agg(F.min("rep").alias("least"))
    named = linked.join(least, F.col("component") == F.col("root")).select("id", "least")
    named = classes.select(F.col("digest").alias("d"), "cid", "rep").join(named, F.col("cid") == F.col("id"), "left").select("d", F.coalesce("least", "rep").alias("c"))
    out = described.select("doc_id", "n", "digest").join(named, F.col("digest") == F.col("d"), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))


def survivors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """One document of each component, with the columns of docs; of rows that share a doc_id all stay or go."""
    gone = few(written(link(docs, text, doc_id, **how).where("not kept").select(F.col("doc_id").alias("__id")).distinct()))
    return docs.join(gone, F.col(f"`{doc_id}`") == F.col("__id"), "left_anti")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=85)


SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, h FROM (
    SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS h FROM t WHERE len(w) > 2
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 2)
), n AS (SELECT t.doc_id, count(h) AS n FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
