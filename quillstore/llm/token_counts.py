"""Token counts by a two-tier lookup on the map side.

A text is cut into segments that the tokenizer never joins (``segments_of``), so a text's
count is the sum over its segments. Pass one sums up
the most frequent segments of every partition (a bounded summary each), merges the
summaries in two levels, and broadcasts a table of at most ``TABLE`` lengths (14 bytes an
entry, so at most 1 MB at any input size). The first level merges as many summaries as the root of their number, so that a task
holds few of them; the second deals what they gave by hash of the segment, so that no task gathers all. Pass two looks each segment up in the table; misses go through a
bounded cache in each worker and, new ones, through the tokenizer itself. No segment is
shuffled; only the bounded summaries are. The table decides speed alone, never a count: an entry is taken for a segment of equal
64-bit hash and length, and inside a block of a megabyte segments of equal hash count as equal. Two that differ do so with a chance under
1e-9 a block, so about one segment in 100 TB is expected to be miscounted.

Null texts count as empty: 0 bytes, 0 tokens. Whole texts are counted, of any length. Rows
come back as they came in, repeated doc_ids and null doc_ids included; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, textkit

TOKENIZER = "word_bpe_49k.json"
TABLE = 1 << 16
SUMMARY = 1 << 14
CACHED = 1 << 19
#: Parts that merged summaries are dealt into by hash of the segment.
PARTS = 64
#: Longer segments are kept out of the table.
LONG_SEGMENT = 256


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class SegmentEncoder:
    """Token ids of segments, through a bounded cache. One lives in each worker process."""

    _by_path: dict[str, "SegmentEncoder"] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begins = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.used = 0

    @classmethod
    def of(cls, path: str) -> "SegmentEncoder":
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def ids(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all known segments, and where those of each given one (no two equal) begin in them, and how many they are."""
        if len(self.places) > CACHED:
            self.clear()
        at = np.fromiter(map(self.places.get, segments, itertools.repeat(-1)), np.int64, len(segments))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast([segments[i].decode("utf-8", "replace") for i in missing], add_special_tokens=False)]
            n, sizes = len(self.places), np.fromiter(map(len, encoded), np.int64, len(encoded))
            fresh = np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, int(sizes.sum()))
            self.flat = _grown(self.flat, self.used + len(fresh))
            self.begins, self.sizes = _grown(self.begins, n + len(missing)), _grown(self.sizes, n + len(missing))
            self.flat[self.used : self.used + len(fresh)] = fresh
            self.sizes[n : n + len(missing)] = sizes
            self.begins[n : n + len(missing)] = self.used + np.r_[0, np.cumsum(sizes)[:-1]]
            self.used += len(fresh)
            at[missing] = np.arange(n, n + len(missing))
            self.places.update((segments[i], n + k) for k, i in enumerate(missing))
        return self.flat, self.begins[at], self.sizes[at]


def _grown(array: np.ndarray, n: int) -> np.ndarray:
    return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])


def _folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z, but for capitals before a byte that isn't ASCII: a mark may follow that composes with one case only."""
    upper = (data >= 65) & (data <= 90)
    upper[:-1] &= data[1:] < 128
    return data + (upper * np.uint8(32))


def segments_of(data: np.ndarray, offsets: np.ndarray) -> textkit.Words:
    """Pieces of the block's texts that the tokenizer never joins, in lower case where that can't change their ids.

    Its pre-tokenizer ends a run of letters at any other character and begins one after any
    but an apostrophe; its normaliser composes first, nothing across the cuts, and lower-cases then.
    Special strings would be cut or change their case, so blocks that may hold one are cut at white space only.
    """
    plain = b"<|" in data.tobytes()
    return textkit.Words(data if plain else _folded(data), offsets, cut=not plain)


def distinct(words: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its distinct form, and a place where each form stands."""
    codes, _ = pd.factorize(words.hashes)
    first = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first


def segment_bytes(words: textkit.Words, at: np.ndarray) -> list[bytes]:
    raw = words.data.tobytes()
    return [raw[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist())]


def _summary(counts: dict[bytes, int], keep: int) -> dict[bytes, int]:
    return dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:keep])


def _summaries(size: int, width: int):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        partition = None
        for batch in batches:
            for _, _, data, offsets in textkit.blocks(batch.column(0)):
                words = segments_of(data, offsets)
                codes, first = distinct(words)
                per = np.bincount(codes, minlength=len(first))
                short = np.flatnonzero((per > 1) & (words.ends[first] - words.starts[first] <= LONG_SEGMENT))
                for s, n in zip(segment_bytes(words, first[short]), per[short].tolist()):
                    counts[s] = counts.get(s, 0) + n
                if len(counts) > 4 * size:
                    counts = _summary(counts, size)
            partition = True
        if partition and counts:
            from pyspark import TaskContext

            counts = _summary(counts, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() % width], pa.int32()), pa.array([list(counts)], pa.list_(pa.binary())), pa.array([list(counts.values())], pa.list_(pa.int64()))],
                ["shard", "segments", "counts"],
            )

    return summarise


def _merged(size: int, parts: int):
    """Merges summaries to one of at most ``size``, dealt into ``parts`` rows by hash of the segment."""

    def merge(table: pa.Table) -> pa.Table:
        counts: dict[bytes, int] = {}
        for segments, numbers in zip(table.column("segments"), table.column("counts")):
            for s, n in zip(segments.as_py(), numbers.as_py()):
                counts[s] = counts.get(s, 0) + n
            if len(counts) > 4 * size:
                counts = _summary(counts, size)
        dealt: list[dict[bytes, int]] = [{} for _ in range(parts)]
        for s, n in _summary(counts, size).items():
            dealt[zlib.crc32(s) % parts][s] = n
        rows = [(i, list(d), list(d.values())) for i, d in enumerate(dealt) if d]
        kinds = (pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(("shard", "segments", "counts"), kinds))})

    return merge


def frequent_lengths(texts: DataFrame, path: str, entries: int = TABLE, summary: int = SUMMARY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, bytes and token count of the segments most frequent in ``texts`` (column 0), sorted by hash. At most ``entries``."""
    schema = "shard int, segments array<binary>, counts array<bigint>"
    shards = max(16, math.isqrt(texts.rdd.getNumPartitions()))
    each = -(-2 * entries // PARTS)
    top = (
        texts.mapInArrow(_summaries(summary, shards), schema)
        .groupBy("shard").applyInArrow(_merged(entries, PARTS), schema)
        .groupBy("shard").applyInArrow(_merged(each, 1), schema)
        .select("segments", "counts").collect()
    )
    # Twice the table at most.
    known = {bytes(s): n for row in top for s, n in zip(row["segments"], row["counts"])}
    segments = list(_summary(known, entries))
    if not segments:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint16)
    raw = b" ".join(segments)
    words = textkit.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    lengths = SegmentEncoder.of(path).ids(segments)[2].astype(np.uint16)
    order = np.argsort(words.hashes)
    return words.hashes[order], (words.ends - words.starts)[order].astype(np.uint32), lengths[order]


def count_words(words: textkit.Words, table: tuple[np.ndarray, np.ndarray, np.ndarray], encoder: SegmentEncoder) -> np.ndarray:
    """Tokens of each document of the block."""
    codes, first = distinct(words)
    hashes, sizes = words.hashes[first], (words.ends - words.starts)[first]
    lengths = np.zeros(len(first), np.int64)
    known = np.zeros(len(first), bool)
    if len(table[0]) and len(first):
        at = np.minimum(np.searchsorted(table[0], hashes), len(table[0]) - 1)
        known = (table[0][at] == hashes) & (table[1][at] == sizes)
        lengths[known] = table[2][at[known]]
    missing = np.flatnonzero(~known)
    if len(missing):
        lengths[missing] = encoder.ids(segment_bytes(words, first[missing]))[2]
    total = np.r_[0, np.cumsum(lengths[codes])]
    return total[words.bounds[1:]] - total[words.bounds[:-1]]


def count_tokens(docs: DataFrame, limit: int = 2048, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    common.ship(spark)
    path = path or tokenizer_path()
    table = spark.sparkContext.broadcast(frequent_lengths(docs.select("text"), path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SegmentEncoder.of(path)
        for batch in batches:
            text = textkit.text_column(batch.column("text"))
            tokens = np.zeros(len(text), np.int64)
            for a, b, data, offsets in textkit.blocks(text):
                tokens[a:b] = count_words(segments_of(data, offsets), table.value, encoder)
            sizes = np.diff(textkit.buffers(text)[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        textkit.give_back()

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
