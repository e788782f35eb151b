"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The driver reads the rank file (its path is a parameter) and broadcasts it, if it is below a fixed size;
each Python worker builds the encoder once. Long texts are cut at safe boundaries, where the default pattern
always ends one match and starts another, so the pieces encode as the whole text would: behind a letter or number that another kind of character
follows, in any script, and around long runs of white space, which overflow the library's regex stack and are therefore given to it as
single pieces. A run of letters without any such place is one match of the pattern and stays whole, and with another pattern texts are not cut.

Defined results: a null text is empty (no ids, no bytes); repeated rows are encoded each; other columns
stay, but for those named like a result column, which are replaced; an empty table gives an empty result. Ids that the ranks lack raise an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table, without

#: Characters after which a long text is cut at the next safe boundary.
CHUNK = 1 << 16
#: Runs of white space from this length are encoded as single pieces.
LONG_SPACE = 4096
#: Largest rank file that is broadcast, in bytes.
MAX_RANKS = 64 << 20

_BOUNDARY = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")
_RUN = regex.compile(r"\p{White_Space}{%d,}" % LONG_SPACE)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    pairs = (x.split() for x in ranks.splitlines() if x)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def pieces(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """text, cut at safe boundaries into parts of about chunk characters."""
    at = 0
    while len(text) - at > chunk:
        m = _BOUNDARY.search(text, at + chunk)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def encode_text(enc: tiktoken.Encoding, text: str, cut: bool = True) -> list[int]:
    if len(text) < LONG_SPACE or not cut:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for m in _RUN.finditer(text):
        for x in pieces(text[at : m.start()]):
            ids += enc.encode_ordinary(x)
        # Before a visible character the pattern leaves the last white space to the next match.
        at = m.end() - (m.end() < len(text))
        ids += enc._encode_single_piece(text[m.start() : at].encode())
    for x in pieces(text[at:]):
        ids += enc.encode_ordinary(x)
    return ids


def _pass(ranks, pattern: str, text: str | None, ids: str | None, schema: pa.Schema, keep: list[str], encode: bool, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cut = encoder(ranks.value, pattern), pattern == default_pattern()
        for batch in slices(batches):
            columns = [batch.column(i) for i, _ in enumerate(keep)]
            packed = []
            if encode:
                packed = [np.asarray(encode_text(enc, x or "", cut), "<u4") for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                columns.append(pa.array([x.tobytes() for x in packed], pa.binary()))
            else:
                packed = [np.frombuffer(x or b"", "<u4") for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            if decode:
                columns.append(pa.array([enc.decode_bytes(x.tolist()) for x in packed], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _run(df: DataFrame, text: str | None, ids: str | None, add: dict[str, bool], ranks_path: str | None, pattern: str | None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    raw = open(ranks_path or default_ranks(), "rb").read()
    if len(raw) > MAX_RANKS:
        raise ValueError(f"the rank file has {len(raw)} bytes; at most {MAX_RANKS} are broadcast")
    shared = spark.sparkContext.broadcast(raw)
    added = [k for k, v in add.items() if v]
    keep = without(df, *added).columns
    source = text if text is not None else ids
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{source}`").alias("__source"))
    out = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.BinaryType()) for c in added])
    fn = _pass(shared, pattern or default_pattern(), "__source", "__source", to_arrow_schema(out), keep, add["token_ids"] and text is not None, add["decoded"])
    return rows.mapInArrow(fn, out)


def encode(df: DataFrame, text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with token_ids: the ids as packed little-endian unsigned 32-bit integers."""
    return _run(df, text, None, {"token_ids": True, "decoded": False}, ranks_path, pattern)


def decode(df: DataFrame, ids: str = "token_ids", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with decoded: the raw bytes of packed ids. The bytes of part of a text need not be valid UTF-8."""
    return _run(df, None, ids, {"token_ids": False, "decoded": True}, ranks_path, pattern)


def encode_decode(df: DataFrame, text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Both in one pass: df with token_ids and decoded."""
    return _run(df, text, None, {"token_ids": True, "decoded": True}, ranks_path, pattern)


def digests(df: DataFrame, *keep: str) -> DataFrame:
    """Of token_ids and decoded: n_tokens, ids_sha256 and decoded_sha256, with doc_id and the columns to keep."""
    return df.select(
        "doc_id",
        *keep,
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode_decode(docs)
    return digests(both.drop("text"))
