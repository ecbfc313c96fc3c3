"""Removal of word windows that an earlier document holds, by difference-cover anchors.

A window is ``WINDOW`` consecutive words. With the difference cover D = {0, 1, 3} modulo 7,
any two positions i and j have a shift s < 7 that takes both into D; so two equal windows of
13 words share an equal run of 7 words whose place is in the cover in both documents. Only
runs at cover places are hashed and shuffled (three of seven), and each chunk of documents
sends a run once, however often it holds it, so that a passage in a third of all documents
weighs one entry a chunk. Runs found in two chunks, or in two documents of a chunk, are anchors.
A second exchange extends them: only windows around anchors are compared, whole, by 96 bits
of hash, again once a chunk with the smallest doc_id there.

1. chunks -> hashes of runs -> buckets -> (chunk, anchors);
2. chunks with anchors -> hashes of whole windows, smallest doc_id -> buckets -> (chunk, windows with a smaller doc_id elsewhere);
3. chunks with those windows -> words covered by them, or by a window of a smaller doc_id in the chunk.

Chunks deal documents by a hash of the whole row, so long or hot sources spread; all
three steps read the one exchange of documents by chunk.

Words are equal when 64 bits of hash agree, windows of different chunks by 96 bits, of one chunk by 64. In 100 TB some 1e10
different words make about three pairs of equal hash, which matter only inside windows equal in all other words;
windows (1e13) make about a thousandth of a pair by 96 bits, and about two by 64 over all chunks. So a handful of documents
of some 1e10 may lose thirteen words by chance.

Null texts have no words. A null doc_id is larger than any other; rows of equal doc_id never
remove each other's words. Texts of fewer than ``WINDOW`` words are kept whole. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, packed, textkit

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
RUN = WINDOW - PERIOD + 1
#: Some two million entries at the smallest chunks: three of seven words are sent.
CHUNKS_TO_BUCKET = 6
_NO_ID = np.iinfo(np.int64).max
_RUN_BITS = np.uint64((1 << 48) - 1)


class Chunk:
    """The documents of one chunk, block by block: ids, words, and hashes."""

    def __init__(self, table: pa.Table, window: int):
        self.ids = table.column("doc_id")
        self.keys = self.ids.fill_null(_NO_ID).to_numpy().astype(np.int64)
        self.text = textkit.text_column(table.column("text"))
        self.window = window

    def blocks(self) -> Iterator[tuple[int, int, textkit.Words]]:
        for a, b, data, offsets in textkit.blocks(self.text):
            yield a, b, textkit.Words(data, offsets)


def _places(words: textkit.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place where ``width`` words of one document begin: document of the block, and place."""
    n = max(0, len(words.hashes) - width + 1)
    doc = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))[:n]
    at = np.arange(n)
    fits = at + width <= words.bounds[doc + 1] if n else np.zeros(0, bool)
    return doc[fits], at[fits]


def _runs(words: textkit.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs at cover places: document of the block, place, 64-bit hash."""
    doc, at = _places(words, RUN)
    covered = np.isin((at - words.bounds[doc]) % PERIOD, COVER)
    doc, at = doc[covered], at[covered]
    return doc, at, words.windows(RUN)[at]


def _shared_inside(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each hash, and per code the smallest key; with it, whether two keys hold it is seen from any larger one."""
    codes, forms = pd.factorize(hashes)
    least = np.full(len(forms), _NO_ID, np.int64)
    np.minimum.at(least, codes, keys)
    return codes, least


def _sent(table: pa.Table, buckets: int) -> pa.Table:
    chunk = Chunk(table, WINDOW)
    found = [np.unique(h) for _, _, w in chunk.blocks() for h in (_runs(w)[2],) if len(h)]
    hashes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    return packed.dealt(table.column("chunk")[0].as_py(), hashes, [(hashes & _RUN_BITS)], buckets, (6,))


def _meet(table: pa.Table) -> pa.Table:
    """Runs that two chunks sent, for each chunk that did."""
    chunk = table.column("chunk").to_numpy()
    parts = [packed.widened(x.as_py(), 6) for x in table.column("c0")]
    sizes = [len(p) for p in parts]
    hashes = np.concatenate(parts)
    owner = np.repeat(chunk, sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    same = hashes[1:] == hashes[:-1]
    shared = np.r_[False, same] | np.r_[same, False]
    return packed.replies(owner[shared], [hashes[shared]], (6,))


def _windows_near(table: pa.Table, anchors: pa.Table, buckets: int) -> pa.Table:
    """Whole windows around anchors, each once with the smallest doc_id of the chunk."""
    if not table.num_rows:
        return packed.dealt(0, np.zeros(0, np.uint64), [np.zeros(0, np.uint64)] * 3, buckets, (8, 4, 8))
    chunk = Chunk(table, WINDOW)
    known = np.unique(np.concatenate([packed.widened(x.as_py(), 6) for x in anchors.column("c0")])) if anchors.num_rows else np.zeros(0, np.uint64)
    blocks, runs, keys = [], [], []
    for a, _, words in chunk.blocks():
        doc, at, hashes = _runs(words)
        blocks.append((a, words, at))
        runs.append(hashes)
        keys.append(chunk.keys[a + doc])
    hashes, key = np.concatenate(runs), np.concatenate(keys)
    codes, least = _shared_inside(hashes, key)
    most = np.full(len(least), np.iinfo(np.int64).min)
    np.maximum.at(most, codes, key)
    anchored = (least != most)[codes] if len(codes) else np.zeros(0, bool)
    if len(known) and len(hashes):
        short = hashes & _RUN_BITS
        anchored |= known[np.minimum(np.searchsorted(known, short), len(known) - 1)] == short
    first, second, owner, done = [], [], [], 0
    for a, words, at in blocks:
        mine = anchored[done : done + len(at)]
        done += len(at)
        ahead = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(ahead, at[mine] + 1, 1)
        ahead = np.cumsum(ahead)
        doc, place = _places(words, WINDOW)
        near = ahead[place + PERIOD] > ahead[place]
        doc, place = doc[near], place[near]
        first.append(words.windows(WINDOW)[place])
        second.append(words.windows(WINDOW, 1)[place])
        owner.append(chunk.keys[a + doc])
    first, second, owner = np.concatenate(first), np.concatenate(second), np.concatenate(owner)
    order = np.lexsort((owner, second, first))
    first, second, owner = first[order], second[order], owner[order]
    new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])] if len(first) else np.zeros(0, bool)
    first, second, owner = first[new], second[new], owner[new]
    return packed.dealt(table.column("chunk")[0].as_py(), first, [first, second & np.uint64(0xFFFFFFFF), owner.view(np.uint64)], buckets, (8, 4, 8))


def _earlier(table: pa.Table) -> pa.Table:
    """Windows whose smallest doc_id lies in another chunk, for each chunk that holds them."""
    chunk = table.column("chunk").to_numpy()
    columns = [np.concatenate([packed.widened(x.as_py(), w) for x in table.column(f"c{i}")]) for i, w in enumerate((8, 4, 8))]
    sizes = [len(x.as_py()) // 4 for x in table.column("c1")]
    first, second, owner = columns[0], columns[1], columns[2].view(np.int64)
    source = np.repeat(chunk, sizes)
    order = np.lexsort((owner, second, first))
    first, second, owner, source = first[order], second[order], owner[order], source[order]
    new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])] if len(first) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    least = owner[starts][np.cumsum(new) - 1] if len(first) else owner
    late = owner > least
    return packed.replies(source[late], [first[late], second[late]], (8, 4))


def _cut(table: pa.Table, earlier: pa.Table) -> pa.Table:
    """Per document: words, words removed, digest of what is kept, and the kept text."""
    if not table.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.large_string())})
    chunk = Chunk(table, WINDOW)
    if earlier.num_rows:
        gone = [np.concatenate([packed.widened(x.as_py(), w) for x in earlier.column(f"c{i}")]) for i, w in enumerate((8, 4))]
        gone = np.unique(textkit.mix(gone[0] ^ textkit.mix(gone[1])))
    else:
        gone = np.zeros(0, np.uint64)
    blocks, both, keys = [], [], []
    for a, b, words in chunk.blocks():
        doc, place = _places(words, WINDOW)
        second = words.windows(WINDOW, 1)[place] & np.uint64(0xFFFFFFFF)
        both.append(textkit.mix(words.windows(WINDOW)[place] ^ textkit.mix(second)))
        keys.append(chunk.keys[a + doc])
        blocks.append((a, b, words, place))
    hashes, key = np.concatenate(both), np.concatenate(keys)
    codes, least = _shared_inside(hashes, key)
    late = key > least[codes] if len(codes) else np.zeros(0, bool)
    if len(gone) and len(hashes):
        late |= gone[np.minimum(np.searchsorted(gone, hashes), len(gone) - 1)] == hashes
    counts, removed, kept, done = [], [], [], 0
    for a, b, words, place in blocks:
        mine = place[late[done : done + len(place)]]
        done += len(place)
        cover = np.zeros(len(words.hashes) + 1, np.int64)
        cover[mine] += 1
        np.subtract.at(cover, np.minimum(mine + WINDOW, len(words.hashes)), 1)
        stays = np.cumsum(cover)[:-1] == 0
        total = np.r_[0, np.cumsum(~stays)]
        raw, starts, ends = words.data.tobytes(), words.starts, words.ends
        for i in range(b - a):
            lo, hi = int(words.bounds[i]), int(words.bounds[i + 1])
            cut = int(total[hi] - total[lo])
            own = raw[starts[lo] : ends[hi - 1]].split() if hi > lo else []
            kept.append(b" ".join(own if not cut else itertools.compress(own, stays[lo:hi].tolist())))
            counts.append(hi - lo)
            removed.append(cut)
    offsets = pa.py_buffer(np.r_[0, np.cumsum([len(x) for x in kept])].astype(np.int64).tobytes())
    text = pa.Array.from_buffers(pa.large_string(), len(kept), [None, offsets, pa.py_buffer(b"".join(kept))])
    return pa.table({"doc_id": chunk.ids.cast(pa.int64()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": text})


def _digested(table: pa.Table) -> pa.Table:
    digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in table.column("kept")]
    return table.drop_columns("kept").append_column("kept_sha256", pa.array(digests, pa.string()))


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, and kept_text (or with ``digest`` kept_sha256)."""
    common.ship(docs.sparkSession)
    by_chunk, buckets = packed.layout(docs, CHUNKS_TO_BUCKET)

    def send(table: pa.Table) -> pa.Table:
        out = _sent(table, buckets)
        textkit.give_back()
        return out

    def near(table: pa.Table, anchors: pa.Table) -> pa.Table:
        out = _windows_near(table, anchors, buckets)
        textkit.give_back()
        return out

    def cut(table: pa.Table, earlier: pa.Table) -> pa.Table:
        out = _cut(table, earlier)
        textkit.give_back()
        return _digested(out) if digest else out.rename_columns(["doc_id", "n_words", "n_removed", "kept_text"]).set_column(3, "kept_text", out.column("kept").cast(pa.string()))

    anchors = by_chunk.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, c0 binary").groupBy("bucket").applyInArrow(_meet, "chunk int, c0 binary")
    windows = by_chunk.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(near, "bucket int, chunk int, c0 binary, c1 binary, c2 binary")
    earlier = windows.groupBy("bucket").applyInArrow(_earlier, "chunk int, c0 binary, c1 binary")
    return by_chunk.groupBy("chunk").cogroup(earlier.groupBy("chunk")).applyInArrow(cut, f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept_text'} string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"), digest=True)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS x FROM d),
f AS (SELECT x, min(doc_id) AS first FROM s GROUP BY x),
k AS (SELECT doc_id, i, first FROM s JOIN f ON s.x = f.x),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k WHERE first < doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS t, count(*) AS n FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY p.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
