"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's symbols are classes of characters, of which there are 64 whatever the language, and its order
is 4. So its lower orders have a proven bound (64 ** 3 entries, 2 MB each for their probabilities and their back-off weights), and the classifier sees what spoils
web text: symbols strewn in, shouting, tables, repeated syllables. Letters of scripts other than Latin are dealt over the letters' symbols, so that
their text is modelled at the same order. (Words tell less here: under a bigram model of words 16 to 28 per cent of labelled junk lay among the good
documents of its language, under this one 4.)

The counts of the highest order are sharded, by a scramble of the n-gram, and never gathered. The lower orders, counts of the different n-grams that continue each of theirs, become
probabilities and back-off weights on the driver and go to every task. Documents are read once, in blocks. A block's different n-grams, and for each the documents that
have it and how often, are packed into one row per shard (about two bytes for each different n-gram of a document) and joined with the shard's counts. What
comes back is a block's sums over one shard, which are added up by block. A shard is dealt to as many tasks as there are shuffle partitions for it.

One in HELD of the trusted texts is not counted; these set the thresholds. A document's log perplexity is compared with the
median of its language, in units of the spread that documents of its length have there (that of long documents, and that of a mean of so few
symbols). It is rejected beyond the language's quantiles of this figure, widened by WIDEN, and never within LEAST.

Defined results: a null or empty text has no symbols, perplexity null and is rejected; a null language, or one with fewer than ENOUGH held texts,
has the thresholds of all held texts (of all trusted ones if so few are held); with no trusted text at all everything but empty texts is
kept; a document with several labels is trusted if one says so; repeated rows, and rows that share an id or have none, are judged each by its own text;
equal texts are held out together.
"""

from __future__ import annotations

import string
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, slices, table, whole, written

BITS, ORDER = 6, 4
SIZE = 1 << BITS
#: Shards of the highest order, a power of two, and the scramble that deals n-grams to them (odd, so that it can be undone).
SHARDS = 16
_KEYS = 1 << (BITS * ORDER)
_ODD = 0x9E3779B1 % _KEYS
_UNDO = pow(_ODD, -1, _KEYS)
#: Different n-grams of documents in a block, and its documents, at most (a document is never split).
BLOCK, BLOCK_DOCS = 1_000_000, 50_000
#: One in so many trusted texts sets thresholds; quantiles, the factor by which they are widened, and what they are at least.
HELD, QUANTILES, WIDEN, LEAST = 8, (0.005, 0.995), 1.5, 2.0
#: Held texts that a language needs for thresholds of its own; what thresholds are at least without them.
ENOUGH, LEAST_OF_ALL = 50, 4.0
#: Symbols of a long document.
LONG = 1000
#: Least share of a count that is discounted, so that no context leaves unseen symbols without mass.
FLOOR = 0.05


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point: 0 start, 1 space, 2 line end, then letters (without accents), capitals, digits, punctuation, other Latin letters, others.

    Letters and signs of other scripts are dealt over the classes of letters and of other Latin letters.
    """
    marks = ".,;:!?'\"()-/|#$%&*=+<>@_"
    rest = 31 + len(marks)
    dealt = [*range(3, 29), *range(rest, SIZE - 1)]
    out = np.full(0x110000, SIZE - 1, np.uint8)
    for p in range(0x32400):  # beyond, Unicode has no letters
        c = chr(p)
        kind = unicodedata.category(c)
        if c == "\n":
            out[p] = 2
        elif c.isspace():
            out[p] = 1
        elif c in marks:
            out[p] = 31 + marks.index(c)
        elif kind == "Lu":
            out[p] = 29
        elif c.isdigit():
            out[p] = 30
        elif kind[0] in "LM":
            base = unicodedata.normalize("NFD", c)[0]
            if base in string.ascii_lowercase:
                out[p] = 3 + ord(base) - ord("a")
            elif 0x300 <= p < 0x370 or unicodedata.name(c, "").startswith("LATIN"):
                out[p] = rest + p % (SIZE - 1 - rest)
            else:
                out[p] = dealt[p * 0x9E3779B1 % (1 << 32) * len(dealt) >> 32]
    return out


def keys(text: str) -> np.ndarray:
    """The n-gram that ends at each character, as a number; the text starts after ORDER - 1 start symbols."""
    s = classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)
    padded = np.concatenate([np.zeros(ORDER - 1, np.int32), s])
    k = s
    for back in range(1, ORDER):
        k = k | padded[ORDER - 1 - back : len(padded) - back] << (BITS * back)
    return k


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << (BITS * ORDER), np.uint32)
    held = 0

    def counted() -> pa.RecordBatch:
        k = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k].astype(np.int64))], ["k", "c"])

    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            if text:
                k, n = np.unique(keys(text), return_counts=True)
                total[k] += n.astype(np.uint32)
                held += len(text)
                if held > 1 << 31:  # before a count can overflow
                    yield counted()
                    total[:] = held = 0
    yield counted()


def counts(texts: DataFrame) -> DataFrame:
    """(text) -> (k, c): counts of all n-grams of the highest order, sharded by k."""
    return texts.mapInArrow(_count, "k int, c long").groupBy("k").agg(F.sum("c").alias("c"))


def discounts(n: dict[int, int]) -> list[float]:
    """What is taken off counts of 0, 1, 2 and more, by how many n-grams occur 1 to 4 times."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    return [0.0] + [min(max(i - (i + 1) * y * b / a, FLOOR * i), float(i)) if a and b else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def train(texts: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(text) -> the n-grams seen of the highest order (k, a: their discounted shares), the back-off weight of each of its contexts, and P(symbol | shorter
    context) of every n-gram of the order below, interpolated from order 1 upwards."""
    tables = [written(counts(texts))]
    for order in range(ORDER - 1, 0, -1):
        tables.insert(0, tables[0].groupBy(F.col("k").bitwiseAND((1 << (BITS * order)) - 1).alias("k")).agg(F.count("*").alias("c")))
    low = np.full(1, 1 / SIZE)
    for order, t in enumerate(tables, 1):
        d = discounts(t.groupBy(F.least("c", F.lit(5)).alias("c")).agg(F.count("*").alias("n")).toPandas().set_index("c")["n"].to_dict())
        cut = F.element_at(F.array(*[F.lit(x) for x in d[1:]]), F.least("c", F.lit(3)).cast("int"))
        t = t.withColumns({"h": F.shiftright("k", BITS), "d": cut})
        contexts = t.groupBy("h").agg(F.sum("c").cast("double").alias("all"), F.sum("d").alias("left"))
        seen = t.join(contexts, "h").select("k", ((F.col("c") - F.col("d")) / F.col("all")).alias("a"))
        back = contexts.select("h", (F.col("left") / F.col("all")).alias("g")).toPandas()  # one row per context: 64 ** 3 at most
        weight = np.ones(1 << (BITS * (order - 1)))
        weight[back["h"].to_numpy(np.int64)] = back["g"].to_numpy(np.float64)
        if order == ORDER:
            return written(seen), weight, low
        share = seen.toPandas()  # as many at most
        low = np.repeat(weight * low, SIZE) if order == 1 else (weight.reshape(SIZE, -1, 1) * low.reshape(1, -1, SIZE)).reshape(-1)
        low[share["k"].to_numpy(np.int64)] += share["a"].to_numpy(np.float64)
    raise AssertionError


#: What is shuffled by shard: n-grams seen (k, a), packed blocks (payload), and the blocks' documents, which only come along.
KINDS = SEEN, PACKED, DOCUMENT = 0, 1, 2
_HEAD = "shard int, salt int, kind int, k int, a double, block long, idx int, payload binary"
_META = "lang string, part int, x long, y int, n_symbols long"


def occurrences(n: np.ndarray) -> bytes:
    """Numbers from 1 up, a byte each; those of 255 and more follow in four bytes each."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<u4").tobytes()


def pack(shards: int, found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
    """(scrambled n-grams in order, how often) of each document of a block -> (shard, payload) of each shard that has some of its n-grams.

    A payload has, behind three numbers (documents, n-grams, entries), the n-grams, how many documents have each, these documents and how often.
    """
    keys = np.concatenate([k for k, _ in found]) if found else np.empty(0, np.int64)
    if not len(keys):
        return
    doc = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
    order = np.argsort(keys, kind="stable")  # runs that are in order already
    keys, doc, often = keys[order], doc[order], np.concatenate([n for _, n in found])[order]
    edges = np.searchsorted(keys, np.arange(shards + 1) * (_KEYS // shards))
    for shard, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b:
            first = np.flatnonzero(np.r_[True, keys[a + 1 : b] != keys[a : b - 1]])
            kinds, lengths = keys[a:b][first], np.diff(np.r_[first, b - a])
            parts = (np.array([len(found), len(kinds), b - a], "<u4").tobytes(), np.diff(kinds, prepend=0).astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), doc[a:b].astype("<u2").tobytes(), occurrences(often[a:b]))
            yield shard, zlib.compress(b"".join(parts), 1)


def unpack(payload: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents of the block, n-grams, how many documents have each, these documents, how often)"""
    data = zlib.decompress(payload)
    docs, kinds, entries = np.frombuffer(data, "<u4", 3).tolist()
    at = 12 + 8 * kinds
    keys, lengths = np.cumsum(np.frombuffer(data, "<u4", kinds, 12), dtype=np.int64), np.frombuffer(data, "<u4", kinds, 12 + 4 * kinds)
    doc, often = np.frombuffer(data, "<u2", entries, at), np.frombuffer(data, np.uint8, entries, at + 2 * entries).astype(np.int64)
    often[often == 255] = np.frombuffer(data, "<u4", offset=at + 3 * entries)
    return docs, keys, lengths, doc, often


def _pack(salts: int, schema: pa.Schema):
    """(doc_id, lang, part, x, y, t) -> rows to be shuffled by shard: the blocks' documents, and packed n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        found: list[tuple[np.ndarray, np.ndarray]] = []
        entries = 0

        def close() -> pa.RecordBatch:
            nonlocal block, entries
            rows = list(pack(SHARDS, found))
            n = len(rows)
            values = {"shard": [s for s, _ in rows], "salt": [block % salts] * n, "kind": [PACKED] * n, "block": [block] * n, "idx": [-1] * n, "payload": [p for _, p in rows]}
            found.clear()
            block, entries = block + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(values.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

        for batch in slices(batches):
            texts = batch.column(5).to_pylist()
            n = len(texts)
            blocks, places, sizes = [], [], []
            closed = []
            for text in texts:
                k = np.sort(keys(text).astype(np.int64) * _ODD & (_KEYS - 1)) if text else np.empty(0, np.int64)
                first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
                blocks.append(block)
                places.append(len(found))
                sizes.append(len(k))
                found.append((k[first], np.diff(np.r_[first, len(k)])))
                entries += len(first)
                if entries >= BLOCK or len(found) == BLOCK_DOCS:
                    closed.append(close())
            at = np.array(blocks, np.int64)
            values = {"shard": pa.array(at % SHARDS, pa.int32()), "salt": pa.array(at // SHARDS % salts, pa.int32()), "kind": pa.array(np.full(n, DOCUMENT), pa.int32()), "block": pa.array(at), "idx": pa.array(places, pa.int32()), "n_symbols": pa.array(sizes, pa.int64())}
            values |= dict(zip(("doc_id", "lang", "part", "x", "y"), batch.columns[:5], strict=True))
            yield pa.RecordBatch.from_arrays([values[f.name] if f.name in values else pa.nulls(n, f.type) for f in schema], schema=schema)
            yield from closed
        if found:
            yield close()

    return run


def _join(shared, schema: pa.Schema):
    """Rows sorted by shard, salt, kind and k -> the blocks' documents as they are, and for each packed block its documents' sums of -log P and of its square."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back, low = shared.value
        name = {f.name: i for i, f in enumerate(schema)}
        here, held, table = None, [], (np.empty(0, np.int64), np.empty(0))

        def sums(payload: bytes) -> bytes:
            docs, scrambled, lengths, doc, often = unpack(payload)
            k = scrambled * _UNDO & (_KEYS - 1)
            p = back[k >> BITS] * low[k & (len(low) - 1)]
            known, share = table
            if len(known):
                at = np.minimum(np.searchsorted(known, k), len(known) - 1)
                p += np.where(known[at] == k, share[at], 0)
            x = np.repeat(-np.log(p), lengths)
            return np.stack([np.bincount(doc, often * x, docs), np.bincount(doc, often * x * x, docs)]).tobytes()

        for batch in batches:
            kind = batch.column(name["kind"]).to_numpy()
            place = batch.column(name["shard"]).to_numpy().astype(np.int64) << 32 | batch.column(name["salt"]).to_numpy()
            edges = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (kind[1:] != kind[:-1])])
            for a, b in zip(edges, [*edges[1:], len(kind)]):
                if place[a] != here:
                    here, held, table = place[a], [], (np.empty(0, np.int64), np.empty(0))
                part = batch.slice(a, b - a)
                if kind[a] == SEEN:
                    held.append((part.column(name["k"]).to_numpy().astype(np.int64), part.column(name["a"]).to_numpy()))
                    continue
                if held:
                    table, held = tuple(np.concatenate(x) for x in zip(*held, strict=True)), []
                if kind[a] == PACKED:
                    made = pa.array([sums(x) for x in part.column(name["payload"]).to_pylist()], pa.binary())
                    part = part.set_column(name["payload"], schema.field("payload"), made)
                yield part

    return run


def _add(schema: pa.Schema):
    """Rows sorted by block and idx, the sums (idx -1) first -> the documents with bits and squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = None, None
        for batch in batches:
            idx, block = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | ((idx[1:] < 0) != (idx[:-1] < 0))])
            for a, b in zip(edges, [*edges[1:], len(idx)]):
                if block[a] != here:
                    here, total = block[a], None
                part = batch.slice(a, b - a)
                if idx[a] < 0:
                    for x in part.column(2).to_pylist():
                        x = np.frombuffer(x).reshape(2, -1)
                        total = x if total is None else total + x
                    continue
                s, q = total[:, idx[a:b]] if total is not None else np.zeros((2, b - a))
                yield pa.RecordBatch.from_arrays([*part.columns[3:], pa.array(s), pa.array(q)], schema=schema)

    return run


def summed(marked: DataFrame, seen: DataFrame, back: np.ndarray, low: np.ndarray) -> DataFrame:
    """(doc_id, lang, part, x, y, t) -> the same without t, and n_symbols, bits and squares."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = lambda ddl: to_arrow_schema(_parse_datatype_string(ddl))
    spark = marked.sparkSession
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARDS)
    meta = f"doc_id {marked.schema['doc_id'].dataType.simpleString()}, {_META}"
    whole_row = f"{_HEAD}, {meta}"
    packed = marked.mapInArrow(_pack(salts, arrow(whole_row)), whole_row)
    shard = F.floor((F.col("k").cast("long") * _ODD).bitwiseAND(_KEYS - 1) / (_KEYS // SHARDS)).cast("int")
    model = seen.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(SEEN).alias("kind"), "k", "a")
    model = model.select(*[F.col(c) if c in model.columns else F.lit(None).cast(packed.schema[c].dataType).alias(c) for c in packed.columns])
    dealt = packed.unionByName(model).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind", "k")
    met = dealt.mapInArrow(_join(spark.sparkContext.broadcast((back, low)), arrow(whole_row)), whole_row)
    columns = ["block", "idx", "payload", "doc_id", *[c.split()[0] for c in _META.split(", ")]]
    by_block = met.select(*columns).repartition("block").sortWithinPartitions("block", "idx")
    result = f"{meta}, bits double, squares double"
    return by_block.mapInArrow(_add(arrow(result)), result)


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    return labels.where(F.col(f"`{label}`") == 1).select(F.col(f"`{doc_id}`").alias("trusted")).where("trusted is not null").distinct()


def scores(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, lang: str, label_id: str, label: str) -> DataFrame:
    """One row per document: doc_id, lang, part (1 counted, 2 held, else 0), x and y (hashes of language and text), n_symbols, bits, squares and log_perplexity."""
    ids = few(written(trusted_ids(labels, label_id, label)))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{lang}`").alias("lang"), whole(text).alias("t"))
    part = F.when(F.col("trusted").isNull(), 0).when(F.pmod(F.xxhash64("t"), F.lit(HELD)) == 0, 2).otherwise(1)
    meet = lambda how: rows.join(ids, F.col("doc_id") == F.col("trusted"), how).withColumn("part", part)
    model = train(meet("inner").where("part = 1").select("t"))
    marked = meet("left").select("doc_id", "lang", "part", F.xxhash64("lang", "t").alias("x"), F.hash("t").alias("y"), "t")
    scored = summed(marked, *model)
    return written(scored.withColumn("log_perplexity", F.when(F.col("n_symbols") > 0, F.col("bits") / F.col("n_symbols"))))


def spread(far: str, one: str) -> Column:
    """Of documents of n_symbols: far is the spread of long ones, one that of a symbol."""
    return F.sqrt(F.col(far) * F.col(far) + F.col(one) * F.col(one) / F.greatest("n_symbols", F.lit(1)))


def thresholds(held: DataFrame, least: float) -> DataFrame:
    """(lang, n_symbols, bits, squares, log_perplexity) -> per language l: held texts, middle, far, one, below and above (in spreads, from the middle)."""
    held = held.where("n_symbols > 0 and lang is not null").withColumnRenamed("lang", "l")
    mean, quartiles = F.sum("bits") / F.sum("n_symbols"), [0.25, 0.75]
    q = F.coalesce(F.percentile_approx(F.when(F.col("n_symbols") >= LONG, F.col("log_perplexity")), quartiles, 10_000), F.percentile_approx("log_perplexity", quartiles, 10_000))
    per = held.groupBy("l").agg(
        F.count("*").alias("texts"), F.percentile_approx("log_perplexity", 0.5, 10_000).alias("middle"),
        F.greatest((F.get(q, F.lit(1)) - F.get(q, F.lit(0))) / 1.349, F.lit(1e-6)).alias("far"), F.sqrt(F.greatest(F.sum("squares") / F.sum("n_symbols") - mean * mean, F.lit(0.0))).alias("one"),
    )
    per = few(written(per))
    z = (F.col("log_perplexity") - F.col("middle")) / spread("far", "one")
    cut = held.join(per, "l").groupBy("l").agg(F.percentile_approx(z, list(QUANTILES), 10_000).alias("z"))
    below, above = F.least(F.get("z", F.lit(0)) * WIDEN, F.lit(-least)), F.greatest(F.get("z", F.lit(1)) * WIDEN, F.lit(least))
    return per.join(cut, "l").select("l", "texts", "middle", "far", "one", below.alias("below"), above.alias("above"))


def judged(scored: DataFrame) -> DataFrame:
    """scored with low and high (the log perplexities that are kept) and kept."""
    held = scored.where("part = 2")
    of_all = held if held.count() >= ENOUGH else scored.where("part > 0")
    own = few(written(thresholds(held, LEAST).where(F.col("texts") >= ENOUGH)))
    # At most one row.
    rest = thresholds(of_all.withColumn("lang", F.lit("")), LEAST_OF_ALL).select(*[F.col(c).alias(f"all_{c}") for c in ("l", "middle", "far", "one", "below", "above")])
    # A few languages hold nearly all rows: their thresholds are broadcast, as a shuffle by language would be uneven.
    met = scored.join(own, F.col("lang") == F.col("l"), "left").join(F.broadcast(rest), F.col("all_l") == "", "left")
    met = met.withColumns({c: F.coalesce(c, f"all_{c}") for c in ("middle", "far", "one", "below", "above")})
    edge = lambda c: F.col("middle") + F.col(c) * spread("far", "one")
    met = met.withColumns({"low": edge("below"), "high": edge("above")})
    inside = F.col("low").isNull() | F.col("log_perplexity").between(F.col("low"), F.col("high"))
    return met.withColumn("kept", F.col("log_perplexity").isNotNull() & inside)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """One row per document: doc_id, lang, n_symbols, log_perplexity, low, high (its thresholds) and kept."""
    return judged(scores(docs, labels, text, doc_id, lang, label_id, label)).select("doc_id", "lang", "n_symbols", "log_perplexity", "low", "high", "kept")


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """The documents that are not rejected, with the columns of docs. Verdicts go by id and hashes of language and text, so rows that share an id, or have none, each have their own."""
    verdicts = judged(scores(docs, labels, text, doc_id, lang, label_id, label))
    rejected = few(written(verdicts.where("not kept").select(F.col("doc_id").alias("__id"), F.col("x").alias("__x"), F.col("y").alias("__y")).distinct()))
    t = whole(text)
    same = (F.xxhash64(F.col(f"`{lang}`"), t) == F.col("__x")) & (F.hash(t) == F.col("__y")) & F.col(f"`{doc_id}`").eqNullSafe(F.col("__id"))
    return docs.join(rejected, same, "left_anti")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return classify(docs, labels)
