"""Hierarchical multi-length packing of token ids into context windows.

Every document is tokenised whole and ended with one terminator id. Full windows of the
largest size are cut off first; what is left goes to the tier (context size) that is the
smallest to hold it. Tiers are packed from long to short: an item opens a window of its
tier, gaps are filled with the longest whole items of shorter tiers that fit, and what gap
then remains takes the head of one more item, whose rest goes back to its own tier. So each
window but a partition's last is full. Windows of one tier are dealt into step groups of
``GROUP`` windows with even attention cost (sum of squared piece lengths), in snake order.

Packing is local to an input partition and runs over blocks of about ``BLOCK_TOKENS`` ids,
so its memory doesn't grow with the partition; no shuffle is needed. A sequence id is the
partition number times 2**32 plus a counter.

Null texts count as empty: their document is the terminator alone. Rows with equal doc_ids
are packed one by one; a null doc_id stays null. Extra columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textkit
from .token_counts import SegmentEncoder, distinct, segment_bytes, segments_of, tokenizer_path

TIERS = (2048, 1024, 512, 256)
TERMINATOR = 1
GROUP = 16
BLOCK_TOKENS = 1 << 21
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def encode_block(words: textkit.Words, encoder: SegmentEncoder, terminator: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the block's documents one after another, each with its terminator, and their bounds."""
    codes, first = distinct(words)
    flat, begins, sizes = encoder.ids(segment_bytes(words, first))
    each = sizes[codes]
    ends = np.r_[0, np.cumsum(each)]
    bounds = ends[words.bounds] + np.arange(len(words.bounds))
    ids = np.empty(int(ends[-1]) + len(words.bounds) - 1, np.uint32)
    ids[bounds[1:] - 1] = terminator
    plain = np.ones(len(ids), bool)
    plain[bounds[1:] - 1] = False
    ids[plain] = flat[np.repeat(begins[codes] - ends[:-1], each) + np.arange(int(ends[-1]))]
    return ids, bounds


class Packer:
    """Items are (doc_id, start, ids, doc_tokens), with ids shorter than the largest tier or equal."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.by_length: list[list] = [[] for _ in range(self.tiers[0] + 1)]
        self.lengths: list[int] = []
        self.closed: dict[int, list[list]] = {t: [] for t in self.tiers}
        self.waiting = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        top, n = self.tiers[0], len(ids)
        whole = n - n % top
        for at in range(0, whole, top):
            self.closed[top].append([(doc_id, at, ids[at : at + top], n)])
        if whole < n:
            self._put((doc_id, whole, ids[whole:], n))

    def _put(self, item) -> None:
        n = len(item[2])
        if not self.by_length[n]:
            bisect.insort(self.lengths, n)
        self.by_length[n].append(item)
        self.waiting += n

    def _take(self, most: int, least: int = 1):
        """The longest item of at most ``most`` and at least ``least`` ids, if there is one."""
        at = bisect.bisect_right(self.lengths, most) - 1
        if at < 0 or self.lengths[at] < least:
            return None
        n = self.lengths[at]
        item = self.by_length[n].pop()
        if not self.by_length[n]:
            del self.lengths[at]
        self.waiting -= n
        return item

    def _fill(self, sequence: list, gap: int, shorter: int) -> int:
        """Fill the gap with whole items, then with the head of one. What is left of the gap."""
        while gap and (item := self._take(gap)):
            sequence.append(item)
            gap -= len(item[2])
        if gap and (item := self._take(shorter) or self._take(self.tiers[0])):
            doc_id, start, ids, n = item
            sequence.append((doc_id, start, ids[:gap], n))
            self._put((doc_id, start + gap, ids[gap:], n))
            gap = 0
        return gap

    def pack(self) -> None:
        """Close full windows; items that can't fill one wait."""
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0)):
            while item := self._take(tier, below + 1):
                sequence = [item]
                if self._fill(sequence, tier - len(item[2]), below or tier):
                    for x in sequence:
                        self._put((x[0], x[1], x[2].copy(), x[3]))
                    return
                self.closed[tier].append(sequence)

    def finish(self) -> None:
        """Close what waits too: windows as long as can be filled, then one that is padded."""
        self.pack()
        for tier in self.tiers:
            while self.waiting >= tier:
                self._fill(sequence := [], tier, tier)
                self.closed[tier].append(sequence)
        if self.waiting:
            sequence = []
            while item := self._take(self.tiers[0]):
                sequence.append(item)
            self.closed[self.tiers[-1]].append(sequence)

    def groups(self, size: int = GROUP, last: bool = False) -> Iterator[tuple[int, list[list]]]:
        """Step groups of closed windows, of one tier each and even in cost; incomplete groups only at the end."""
        for tier in self.tiers:
            ready = self.closed[tier]
            n = -(-len(ready) // size) if last else len(ready) // size
            if not n:
                continue
            taken, self.closed[tier] = ready[: n * size], ready[n * size :]
            taken.sort(key=lambda s: -sum(len(x[2]) ** 2 for x in s))
            dealt: list[list] = [[] for _ in range(n)]
            for i, sequence in enumerate(taken):
                turn, place = divmod(i, n)
                dealt[place if turn % 2 == 0 else n - 1 - place].append(sequence)
            for group in dealt:
                yield tier, group


class _Numbered:
    def __init__(self, partition: int):
        self.sequence = self.group = partition << 32

    def batch(self, groups: Iterator[tuple[int, list[list]]]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in SCHEMA.split(", ")]
        for tier, group in groups:
            for sequence in group:
                offset = 0
                for doc_id, start, ids, n in sequence:
                    row = (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.sequence, offset, tier, self.group)
                    for column, value in zip(columns, row):
                        column.append(value)
                    offset += len(ids)
                self.sequence += 1
            self.group += 1
        if columns[0]:
            fields = [x.split(" ") for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if kind == "int" else pa.int64()) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, group: int = GROUP, terminator: int = TERMINATOR, path: str | None = None) -> DataFrame:
    """One row per piece: where it comes from in its document and where it lies in its sequence."""
    common.ship(docs.sparkSession)
    path = path or tokenizer_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer, numbered, held = SegmentEncoder.of(path), Packer(tiers), _Numbered(TaskContext.get().partitionId()), 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for a, b, data, offsets in textkit.blocks(batch.column("text")):
                ids, bounds = encode_block(segments_of(data, offsets), encoder, terminator)
                for i in range(a, b):
                    packer.add(doc_ids[i], ids[bounds[i - a] : bounds[i - a + 1]])
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    packer.pack()
                    yield from numbered.batch(packer.groups(group))
                    held = 0
        packer.finish()
        yield from numbered.batch(packer.groups(group, last=True))
        del packer
        textkit.give_back()

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(work, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4's result, what SQL can say too: per document, whether its pieces lie end to end from its first id to its last, and hold them all."""
    pieces = op4_packing(spark, sf_dir)
    # The pieces of one document.
    each = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("p"), F.max("doc_tokens").alias("most"), F.min("doc_tokens").alias("least"))
    joined = F.aggregate("p", F.lit(0).cast("long"), lambda at, x: F.when(x["start"] == at, at + x["length"]).otherwise(F.lit(-1)))
    return each.select("doc_id", ((joined == F.col("most")) & (F.col("most") == F.col("least"))).alias("whole"))


WHOLE_ORACLE = "SELECT doc_id, true AS whole FROM documents"
