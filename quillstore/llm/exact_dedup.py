"""Exact deduplication through counting quotient filters.

Each partition builds a counting quotient filter of the 64-bit fingerprints of its
normalised texts: the high bits (quotient) pick a slot run, the low bits (remainder) are
kept sorted inside the run, with a count. Filters merge losslessly, because equal
fingerprints meet at equal places of sorted runs. A hot text weighs one entry in each
partition's filter, however many copies there are. Fingerprints counted above one route their
documents to byte verification: grouping by the whole normalised text, with partial sums.
Repeated fingerprints and verified groups are broadcast while they are few (``common.sized``), and joined by shuffles
beyond, where Spark splits the partitions of hot fingerprints.

Null texts count as empty. Equal doc_ids with equal texts are one document: every such row
of the smallest doc_id is marked kept (``drop_duplicates`` keeps exactly one row). A null
doc_id loses to any other; a group of null ids has a null keep_id and its rows count as kept. An empty
table gives an empty result. Extra columns are ignored by ``mark_duplicates`` and kept by
``drop_duplicates``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REMAINDER_BITS = 40


class CountingQuotientFilter:
    """Quotient runs of sorted remainders, with the exact count of each."""

    def __init__(self, quotients: np.ndarray, lengths: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.lengths, self.remainders, self.counts = quotients, lengths, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> "CountingQuotientFilter":
        """From fingerprints in any order, each with a count (1 if none are given)."""
        order = np.argsort(fingerprints, kind="stable")
        prints = fingerprints[order]
        counts = np.ones(len(prints), np.int64) if counts is None else counts[order]
        new = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else np.zeros(0, np.int64)
        prints, counts = prints[new], np.add.reduceat(counts, new) if len(new) else counts
        quotients, lengths = np.unique(prints >> np.uint64(REMAINDER_BITS), return_counts=True)
        return cls(quotients.astype(np.uint32), lengths.astype(np.uint32), prints & np.uint64((1 << REMAINDER_BITS) - 1), counts)

    @classmethod
    def merged(cls, filters: list["CountingQuotientFilter"]) -> "CountingQuotientFilter":
        """One filter with the sums: a stable sort of runs that are sorted already is a merge."""
        return cls.of(np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters]))

    def fingerprints(self) -> np.ndarray:
        return (np.repeat(self.quotients.astype(np.uint64), self.lengths) << np.uint64(REMAINDER_BITS)) | self.remainders

    def repeated(self) -> np.ndarray:
        return self.fingerprints()[self.counts > 1]

    def to_row(self) -> tuple[bytes, bytes, bytes, bytes]:
        """Remainders take 5 bytes, counts one where all fit."""
        narrow = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : REMAINDER_BITS // 8]
        counts = self.counts.astype(np.uint8 if len(self.counts) and self.counts.max() < 256 else np.int64)
        return self.quotients.tobytes(), self.lengths.tobytes(), narrow.tobytes(), counts.tobytes()

    @classmethod
    def from_row(cls, quotients: bytes, lengths: bytes, remainders: bytes, counts: bytes) -> "CountingQuotientFilter":
        n = len(remainders) // (REMAINDER_BITS // 8)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, : REMAINDER_BITS // 8] = np.frombuffer(remainders, np.uint8).reshape(n, -1)
        return cls(np.frombuffer(quotients, np.uint32), np.frombuffer(lengths, np.uint32), wide.view("<u8").ravel(), np.frombuffer(counts, np.uint8 if len(counts) == n else np.int64).astype(np.int64))

    def split(self, bits: int) -> Iterator[tuple[int, "CountingQuotientFilter"]]:
        """Parts by the highest ``bits`` bits of the quotient."""
        if not len(self.quotients):
            return
        part = self.quotients >> np.uint32(64 - REMAINDER_BITS - bits) if bits else np.zeros(len(self.quotients), np.uint32)
        cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
        ends = np.r_[0, np.cumsum(self.lengths)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(part[a]), CountingQuotientFilter(self.quotients[a:b], self.lengths[a:b], self.remainders[ends[a] : ends[b]], self.counts[ends[a] : ends[b]])


def normalised(text: Column) -> Column:
    """Runs of space and 0x09-0x0D become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _built(bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, pending, held = None, [], 0
        for batch in batches:
            pending.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            held += len(pending[-1])
            if held > 4_000_000:
                kept, pending, held = _fold(kept, pending), [], 0
        kept = _fold(kept, pending)
        rows = [(part, *f.to_row()) for part, f in kept.split(bits)] if kept is not None else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], ["part", "quotients", "lengths", "remainders", "counts"])

    return build


def _fold(kept: CountingQuotientFilter | None, pending: list[np.ndarray]) -> CountingQuotientFilter | None:
    fresh = [CountingQuotientFilter.of(np.concatenate(pending))] if pending else []
    filters = ([kept] if kept is not None else []) + fresh
    return CountingQuotientFilter.merged(filters) if len(filters) > 1 else filters[0] if filters else None


def _merge_part(table: pa.Table) -> pa.Table:
    rows = zip(*(table.column(c).to_pylist() for c in ("quotients", "lengths", "remainders", "counts")))
    found = CountingQuotientFilter.merged([CountingQuotientFilter.from_row(*r) for r in rows]).repeated()
    return pa.table({"fp": pa.array(found.view(np.int64), pa.int64())})


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """Fingerprints (column 0, long) that occur more than once, one row each. ``rows`` sizes the parts: about a million entries each."""
    bits = min(64 - REMAINDER_BITS, max(4, int(np.ceil(np.log2(max(1, rows / 1e6))))))
    parts = fingerprints.mapInArrow(_built(bits), "part int, quotients binary, lengths binary, remainders binary, counts binary")
    return parts.groupBy("part").applyInArrow(_merge_part, "fp long")


def _prints(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as (row struct, id, norm, fp), and the fingerprints that occur more than once."""
    common.ship(docs.sparkSession)
    norm = normalised(docs["text"])
    base = docs.select(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), docs["doc_id"].alias("id"), norm.alias("norm"), F.xxhash64(norm).alias("fp"))
    return base, common.sized(common.written(repeated_fingerprints(base.select("fp"), docs.count()), "repeated"))


def mark_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    base, repeated = _prints(docs)
    verified = common.written(
        base.select("id", "norm", "fp").join(repeated, "fp", "left_semi")
        .groupBy("fp", "norm").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .select("fp", F.sha2("norm", 256).alias("sha"), "first_id", "copies"), "verified",
    )
    rows = base.select("id", "fp", F.sha2("norm", 256).alias("sha"))
    joined = rows.join(common.sized(verified), ["fp", "sha"], "left")
    keep = F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("first_id"))
    return joined.select(
        F.col("id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: exactly one of each normalised text, all columns as they came."""
    base, repeated = _prints(docs)
    alone = base.join(repeated, "fp", "left_anti").select("row")
    first = base.join(repeated, "fp", "left_semi").groupBy("fp", "norm").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id")).alias("row")).select("row")
    names = docs.columns
    return alone.unionByName(first).select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(names)])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
