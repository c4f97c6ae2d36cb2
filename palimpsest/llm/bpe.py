"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

#: A match of a byte-level pattern never runs from a visible character into the white space after it, and
#: what follows is matched by looking ahead only. So the text may be cut before any white space that
#: follows an ASCII letter, digit, full stop or comma.
_SAFE = re.compile(r"(?<=[A-Za-z0-9.,])(?=[ \n])")
CUT_CHARS, STEP = 1 << 16, 512


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """tiktoken's encoder without special tokens, one for each rank file and worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = CUT_CHARS):
    """Cut a long text at safe boundaries; a stretch without one stays whole."""
    at = 0
    while len(text) - at > most:
        found = _SAFE.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode(text: str, path: str, pattern: str) -> np.ndarray:
    own = encoding(path, pattern)
    found = [own.encode_ordinary(x) for x in pieces(text) if x]
    return np.concatenate([np.asarray(x, dtype="<u4") for x in found]) if found else np.zeros(0, dtype="<u4")


def decode(ids: np.ndarray, path: str, pattern: str) -> bytes:
    """Raw bytes: tokens may end inside a character, so nothing is decoded to text."""
    return encoding(path, pattern).decode_bytes(ids.tolist())


def tokenize(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with ids array<int>, n_tokens and decoded binary (replacing columns so named).

    A null or empty text has no ids and decodes to no bytes. Repeated rows stay; an empty table stays empty.
    No shuffle: each task encodes the texts that it reads, STEP rows at a time.
    """
    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded", "n_tokens", text.lower())]
    own = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                ids = [encode(t or "", path, pattern) for t in b.column("__text").to_pylist()]
                cuts = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                new = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)), pa.array([len(x) for x in ids], pa.int64()), pa.array([decode(x, path, pattern) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in range(b.num_columns - 1)], *new], names=[*kept, "ids", "n_tokens", "decoded"])

    schema = StructType([f for f in own.schema.fields if f.name != "__text"]).add("ids", ArrayType(IntegerType())).add("n_tokens", LongType()).add("decoded", BinaryType())
    return own.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; the ids leave the worker only as digests."""

    def run(batches):
        for b in batches:
            n, a, d = [], [], []
            for t in b.column("__text").to_pylist():
                ids = encode(t or "", path, pattern)
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                d.append(hashlib.sha256(decode(ids, path, pattern)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select("doc_id", F.col(f"`{text}`").alias("__text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
