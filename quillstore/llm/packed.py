"""Exchanges of packed hashes between chunks of documents and buckets of hashes.

A chunk is a group of documents that one task reads at once; a bucket is a part of the hash space. A chunk sends
a bucket one row with all its entries, packed to a few bytes each, and the bucket answers the chunk the
same way. Rows of single hashes would weigh several times as much.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SMALLEST_CHUNK = 4 << 20
LARGEST_CHUNK = 32 << 20
#: Square of a chunk's bytes, for each byte of all text.
GROWTH = 4096


def layout(docs: DataFrame, chunks_to_bucket: int, growth: int = GROWTH) -> tuple[DataFrame, int]:
    """``docs`` as (chunk, doc_id, text), and the number of buckets.

    Chunks grow with the root of the text's bytes, between two bounds, so that the rows between chunks and buckets don't
    become too many; a bucket serves the entries of about ``chunks_to_bucket`` chunks. Documents are dealt by a hash of
    doc_id and text, so that long documents, hot sources and null doc_ids spread.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk = min(LARGEST_CHUNK, max(SMALLEST_CHUNK, math.isqrt(size * growth)))
    least = common.shuffle_partitions(docs.sparkSession)
    chunks, buckets = max(least, -(-size // chunk)), max(least, -(-size // (chunk * chunks_to_bucket)))
    number = F.pmod(F.xxhash64(docs["doc_id"], docs["text"]), F.lit(chunks)).cast("int")
    return docs.select(number.alias("chunk"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), buckets


def narrowed(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def widened(payload: bytes, width: int) -> np.ndarray:
    """Values from ``width`` bytes each."""
    n = len(payload) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(payload, np.uint8).reshape(n, width)
    return out.view("<u8").ravel().astype(np.uint64)


def dealt(chunk: int, hashes: np.ndarray, columns: list[np.ndarray], buckets: int, widths: tuple[int, ...]) -> pa.Table:
    """Rows (bucket, chunk, payload, keys): for each bucket the columns of its entries, cut to so many bytes each."""
    bucket = ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows: list[tuple] = []
    packed = [narrowed(c[order], w) for c, w in zip(columns, widths)]
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        rows.append((b, chunk, *[p[bounds[b] : bounds[b + 1]].tobytes() for p in packed]))
    names = ["bucket", "chunk", *[f"c{i}" for i in range(len(columns))]]
    return pa.table({n: pa.array([r[i] for r in rows], pa.int32() if i < 2 else pa.binary()) for i, n in enumerate(names)})


def replies(chunks: np.ndarray, columns: list[np.ndarray], widths: tuple[int, ...]) -> pa.Table:
    """Rows (chunk, payloads): for each chunk the columns of its entries."""
    order = np.argsort(chunks, kind="stable")
    chunks = chunks[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]]), len(chunks)] if len(chunks) else np.zeros(1, np.int64)
    packed = [narrowed(c[order], w) for c, w in zip(columns, widths)]
    out = {"chunk": pa.array(chunks[cuts[:-1]].astype(np.int32), pa.int32())}
    for i, p in enumerate(packed):
        out[f"c{i}"] = pa.array([p[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
    return pa.table(out)
