"""Size-aware heavy-light Jaccard join of documents' shingle sets, down to connected classes.

1. Chunks of documents send each distinct shingle once to the shingle's bucket, which
   answers with the number of chunks that hold it. A shingle in no other document can be in no
   overlap: a set with more of them than the threshold leaves room for links with nothing.
2. Equal sets of a chunk fold into their smallest doc_id. Light sets, for which listing all
   subsets of the least overlap is cheaper than scanning lists, send the hashes of those
   fixed-size subsets: sharing one *is* the link. Heavy sets send entries of inverted lists. The
   list of a single shingle holds unrelated texts wherever shingles are common, so a list's key is
   the content of one *part*: shingles are dealt by hash into some parts more than two linked sets
   of a size class can differ in, so linked sets agree wholly in some parts. A part without
   shingles says nothing; there are so many parts more that linked sets agree in another, too, and where a set has
   more empty ones, those are joined with each of the set's rarest shingles (as many as any partner must share one of). Entries of one key fold into a star around its smallest member, in the chunk and again
   in the bucket, so a key in a third of all documents weighs one entry a chunk.
3. Stars connect heavy sets to clusters, which only say what travels together: each set is
   compared with those alone that share one of its lists, whose size allows a link, and which the search has not yet
   reached; overlaps are counted on whole 64-bit shingles, each pair once. Small clusters share
   tasks. Larger ones (``BLOCK_SETS``, ``CLUSTER_ELEMENTS``) are dealt into blocks, each searched
   together with a few hubs of its cluster. Sets of one class need no more comparing, so only
   those outside their cluster's largest class are then held against the rest, in clusters of those alone that share enough lists for a
   link (``_apart``), unless other sets hold too few of their shingles for a
   link with any: list by list, or block by block, whichever copies fewer sets.
4. Components over all links give each document the smallest doc_id it reaches.

No link between different texts is lost: each filter follows from the threshold alone. So unrelated texts over
common shingles cost what their own sets cost, and near copies that link cost a few hubs each. What stays
quadratic is a group of many sets that all share parts and yet don't link (similar by some 70 percent at a threshold
of 90; at 80 percent parts are half as large, and sets that share a third may meet): it is compared block by block or list by
list, so its time grows, and no task's memory.

Shingles are equal when 64 bits of hash agree; within one pair of sets of n shingles that errs with a chance under
n * n / 2**64. Subsets and equal sets are matched over the whole corpus, by 128 bits.

Null or empty texts have empty sets and link with nothing. Texts with fewer words than a
shingle are one shingle. Rows with a null doc_id link with nothing and have a null class.
Rows that share a doc_id are one node. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph, packed, textkit

#: Some two million entries at the smallest chunks: each word begins a shingle.
CHUNKS_TO_BUCKET = 3
#: Chunks stay at the smallest up to 64 GB of text, and so does what a task holds; a row between a chunk and a bucket has 100 shingles and more up to 4 TB.
CHUNK_GROWTH = 256
#: Bytes of text hashed at once, and shingles of sets whose lists are named at once.
TEXT_BLOCK = 1 << 18
KEYED_ELEMENTS = 250_000
#: Entries of lists are fewer: of sets that may link at all, half a key for each shingle. In fewer buckets the same pairs meet less often.
LISTS_TO_BUCKET = 4
#: Of a task of the search: shingles at most (one longer set is a block), and sets of one cluster. Where blocks are held against one
#: another, fewer larger ones copy fewer sets.
CLUSTER_ELEMENTS = 2_000_000
BLOCK_SETS = 128
SEEK_SETS = 256
#: Sets of a large cluster that every block is held against, about.
HUBS = 32
#: Lists of a large cluster with more sets count as common: their sets stay together. Of others, each pair is counted.
COMMON_SETS = 32
#: Entries of lists that one task counts pairs of, about.
PAIR_ENTRIES = 500_000
_COMMON = 1 << 40
#: Copies of each set, on average, from which on a large cluster's lists are looked at: they cost a few copies themselves.
BLOCK_COPIES = 16
_LOW = np.uint64((1 << 40) - 1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of what a chunk sends: documents, list entries, subset hashes, links found, sets.
DOCS, LISTS, SUBSETS, LINKS, SETS = range(5)


@dataclass(frozen=True)
class Rule:
    """Sets of ``width``-word shingles link when 100 * overlap >= percent * union."""

    width: int
    percent: int

    def spare(self, n):
        """Most shingles of a set of n that a partner can lack."""
        return n * (100 - self.percent) // 100

    def linked(self, overlap, a, b):
        return 100 * overlap >= self.percent * (a + b - overlap)

    def subsets(self, n: int) -> int:
        return sum(math.comb(n, k) for k in range(self.spare(n) + 1))

    def boundary(self) -> int:
        """The largest size of light sets: listing subsets costs less than sending list entries and scanning a cluster's set."""
        n = 1
        while self.subsets(n + 1) <= (n + 1) + 2 * (self.spare(n + 1) + 1):
            n += 1
        return n

    @functools.cached_property
    def size_classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where size classes begin, the parts of each, and how many parts more than one two linked sets agree in.

        A linked set is at most 100 / percent times as large, so it is in the same class or the next. Pairs meet under the
        larger one's class, whose sizes are all under the next class's beginning: that bounds their difference, and they agree in all
        parts but so many. Of agreeing parts, some may be empty; a few parts more make sure that one isn't, unless a set has more
        empty ones than that. How many is chosen to give the fewest keys.
        """
        starts = [1]
        while starts[-1] < 1 << 40:
            starts.append(starts[-1] * 100 // self.percent + 1)
        begin, most = np.array(starts[:-1], np.int64), np.array(starts[1:], np.int64) - 1
        differ = (100 - self.percent) * 2 * most // (100 + self.percent)
        more = ((differ + 1)[:, None] * np.linspace(0, 0.6, 61)).astype(np.int64)
        parts = differ[:, None] + 1 + more
        empty = parts * np.exp(-0.9 * begin[:, None] / parts)
        spread = np.sqrt(empty) + 1e-9
        z = (more - empty) / spread
        beyond = spread * np.maximum(0, np.exp(-z * z / 2) / math.sqrt(2 * math.pi) - z * np.vectorize(math.erfc)(z / math.sqrt(2)) / 2)
        best = np.argmin(parts - empty + beyond * (self.spare(begin)[:, None] + 1), 1)
        every = np.arange(len(begin))
        return begin, parts[every, best], more[every, best]

    def lists(self, sizes: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the lists that sets are in, and which set each is of.

        Set k has sizes[k] shingles, of which flat[bounds[k]:bounds[k + 1]] may be in others, rarest first.
        """
        starts, parts, more = self.size_classes
        every, held = np.arange(len(sizes)), np.diff(bounds)
        owner, own = np.repeat(every, held), np.searchsorted(starts, sizes, side="right") - 1
        mixed = textkit.mix(flat ^ _GOLDEN)
        prefix = np.minimum(self.spare(sizes) - (sizes - held) + 1, held)
        keys, owners = [], []
        for label in (own, own + 1):
            number = parts[label]
            first = np.r_[0, np.cumsum(number)]
            cell = first[owner] + ((mixed >> np.uint64(32)) % number[owner].astype(np.uint64)).astype(np.int64)
            total = np.zeros(int(first[-1]), np.uint64)
            np.add.at(total, cell, mixed)
            of = np.repeat(every, number)
            name = textkit.mix(((label[of] << 40) + np.arange(len(of)) - first[of]).astype(np.uint64) + _GOLDEN)
            full = np.bincount(cell, minlength=len(of)) > 0
            keys.append(textkit.mix(total[full] ^ name[full]))
            owners.append(of[full])
            # Of a set's empty parts, all but the last ``more``: the first that two linked sets agree in is among those of both, or they agree in one that isn't empty.
            bare = np.flatnonzero(~full)
            count = np.bincount(of[bare], minlength=len(sizes))
            bare = bare[np.arange(len(bare)) - np.r_[0, np.cumsum(count)][of[bare]] < (count - more[label])[of[bare]]]
            each = prefix[of[bare]]
            at = _ranges(bounds[of[bare]], each)
            keys.append(textkit.mix(flat[at] + np.repeat(name[bare] * _GOLDEN, each)))
            owners.append(np.repeat(of[bare], each))
        return np.concatenate(keys), np.concatenate(owners)

    def full(self, sizes: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The size class of each set of ``lists``, and how many parts aren't empty under that class and under the next."""
        starts, parts, _ = self.size_classes
        own = np.searchsorted(starts, sizes, side="right") - 1
        owner, mixed = np.repeat(np.arange(len(sizes)), np.diff(bounds)), textkit.mix(flat ^ _GOLDEN)
        counts = []
        for label in (own, own + 1):
            first = np.r_[0, np.cumsum(parts[label])]
            cell = np.unique(first[owner] + ((mixed >> np.uint64(32)) % parts[label][owner].astype(np.uint64)).astype(np.int64))
            counts.append(np.diff(np.searchsorted(cell, first)))
        return own, *counts


def _sets(text: pa.Array, rule: Rule) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    for a, b, data, offsets in textkit.blocks(text, TEXT_BLOCK):
        words = textkit.Words(data, offsets, lower=True)
        hashes = words.windows(rule.width)
        for i in range(b - a):
            lo, hi = int(words.bounds[i]), int(words.bounds[i + 1])
            if hi - lo >= rule.width:
                yield np.unique(hashes[lo : hi - rule.width + 1])
            elif hi > lo:
                own = words.hashes[lo:hi]
                yield textkit.rolled(own, np.array([0]), np.array([hi - lo]), textkit._WORD_MULTIPLIERS[0])
            else:
                yield np.zeros(0, np.uint64)


def _bucket_key(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40)) | (hashes & _LOW)


def _sent(table: pa.Table, rule: Rule, buckets: int) -> pa.Table:
    found = list(_sets(textkit.text_column(table.column("text")), rule))
    hashes = np.unique(np.concatenate(found))
    return packed.dealt(table.column("chunk")[0].as_py(), hashes, [hashes & _LOW], buckets, (5,))


def _counted(table: pa.Table) -> pa.Table:
    """Shingles that two chunks hold, with the number of chunks, for each of them."""
    parts = [packed.widened(x.as_py(), 5) for x in table.column("c0")]
    hashes = np.concatenate(parts)
    owner = np.repeat(table.column("chunk").to_numpy(), [len(p) for p in parts])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    new = np.r_[True, hashes[1:] != hashes[:-1]]
    counts = np.diff(np.r_[np.flatnonzero(new), len(hashes)])
    each = counts[np.cumsum(new) - 1]
    many = each > 1
    out = packed.replies(owner[many], [hashes[many], np.minimum(each[many], 65535).astype(np.uint64)], (5, 2))
    return out.append_column("bucket", pa.array([table.column("bucket")[0].as_py()] * out.num_rows, pa.int32()))


def _stars(keys: list[np.ndarray], docs: np.ndarray, sizes: np.ndarray | None = None, overlaps: np.ndarray | None = None, rule: Rule | None = None):
    """Entries folded around the smallest member of each key: links (hub, doc), and which entries still stand for the key.

    With a rule, a member joins its hub only if their overlap links them. If it doesn't, no larger member of the key is linked by it either.
    """
    order = np.lexsort((docs, *([sizes] if rule else []), *keys))
    keys, docs = [k[order] for k in keys], docs[order]
    new = np.r_[True, functools.reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])] if len(docs) else np.zeros(0, bool)
    hub = np.flatnonzero(new)[np.cumsum(new) - 1] if len(docs) else np.zeros(0, np.int64)
    joined = ~new
    if rule:
        sizes = sizes[order]
        joined &= rule.linked(overlaps[order], sizes, sizes[hub])
    return (docs[hub[joined]], docs[joined]), order[~joined]


def _sums(shingles: np.ndarray) -> np.ndarray:
    """Two independent values of each shingle: their sums name sets by 128 bits."""
    return np.stack([textkit.mix(shingles), textkit.mix(shingles ^ np.uint64(0xC2B2AE3D27D4EB4F))])


def _named(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return textkit.mix(sums + sizes.astype(np.uint64) * _GOLDEN)


def _subset_hashes(rule: Rule, own: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each subset that a partner may share, and their sizes. Shingles that no other document has are left out of all."""
    rest = _sums(own[~alone])
    n = rest.shape[1]
    level, last = rest.sum(1, dtype=np.uint64, keepdims=True), np.array([-1])
    sums, sizes = [level], [np.array([n])]
    for k in range(1, rule.spare(len(own)) - int(alone.sum()) + 1):
        each = n - 1 - last
        at = np.repeat(last + 1 - np.r_[0, np.cumsum(each)][:-1], each) + np.arange(int(each.sum()))
        level, last = np.repeat(level, each, axis=1) - rest[:, at], at
        sums.append(level)
        sizes.append(np.full(len(at), n - k))
    each = np.concatenate(sizes)
    return _named(np.concatenate(sums, 1), each), each


def _ranges(starts: np.ndarray, each: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each."""
    return np.repeat(starts - np.r_[0, np.cumsum(each)][:-1], each) + np.arange(int(each.sum()))


def _entries(table: pa.Table, replies: pa.Table, rule: Rule, buckets: int) -> pa.Table:
    if not table.num_rows:
        return _rows([])
    ids = table.column("doc_id")
    sets = list(_sets(textkit.text_column(table.column("text")), rule))
    sizes = np.array([len(s) for s in sets], np.int64)
    known = ids.is_valid().to_numpy()
    docs = ids.fill_null(0).to_numpy().astype(np.int64)
    rows = [(-1, DOCS, docs.tobytes(), sizes.tobytes(), known.tobytes())]
    # Equal sets fold into the smallest doc_id.
    prints = _named(np.array([_sums(s).sum(1, dtype=np.uint64) for s in sets], np.uint64).reshape(-1, 2).T, sizes)
    usable = np.flatnonzero(known & (sizes > 0))
    found, first = _stars([prints[0, usable], prints[1, usable]], docs[usable])
    links, chosen = [found], usable[first]
    same = (prints[0, chosen], prints[1, chosen], sizes[chosen], docs[chosen], sizes[chosen])
    # Which shingles are in other documents, and in how many chunks.
    flat = np.concatenate([sets[i] for i in chosen]) if len(chosen) else np.zeros(0, np.uint64)
    bounds = np.r_[0, np.cumsum(sizes[chosen])]
    chunks_with = np.ones(len(flat), np.int64)
    if replies.num_rows and len(flat):
        keys = np.concatenate([(np.uint64(b) << np.uint64(40)) | packed.widened(x.as_py(), 5) for b, x in zip(replies.column("bucket").to_pylist(), replies.column("c0"))])
        counts = np.concatenate([packed.widened(x.as_py(), 2) for x in replies.column("c1")]).astype(np.int64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        mine = _bucket_key(flat, buckets)
        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        hit = keys[at] == mine
        chunks_with[hit] = counts[at[hit]]
    codes, forms = pd.factorize(flat)
    alone = (chunks_with == 1) & (np.bincount(codes, minlength=len(forms))[codes] == 1) if len(flat) else np.zeros(0, bool)
    gone = np.diff(np.r_[0, np.cumsum(alone)][bounds])
    most_light = rule.boundary()
    least_heavy = -(-rule.percent * (most_light + 1) // 100)
    hopeful = (rule.spare(sizes[chosen]) > 0) & (gone <= rule.spare(sizes[chosen]))
    subsets = [same]
    for k in np.flatnonzero(hopeful & (sizes[chosen] <= most_light)).tolist():
        (one, two), overlaps = _subset_hashes(rule, flat[bounds[k] : bounds[k + 1]], alone[bounds[k] : bounds[k + 1]])
        subsets.append((one, two, np.full(len(one), sizes[chosen[k]]), np.full(len(one), docs[chosen[k]]), overlaps))
    one, two, size, doc, overlap = (np.concatenate(x) for x in zip(*subsets))
    found, stand = _stars([one, two], doc, size, overlap, rule)
    links.append(found)
    dealt = packed.dealt(0, one[stand], [x[stand].view(np.uint64) for x in (one, doc, size, overlap, two)], buckets, (8, 8, 3, 3, 8))
    rows += [(r["bucket"], SUBSETS, r["c0"], r["c1"], r["c2"], r["c3"], r["c4"]) for r in dealt.to_pylist()]
    rows.append((-1, LINKS, np.concatenate([x[0] for x in links]).tobytes(), np.concatenate([x[1] for x in links]).tobytes()))

    heavy = np.flatnonzero(hopeful & (sizes[chosen] >= least_heavy))
    if len(heavy):
        each = sizes[chosen[heavy]]
        at = _ranges(bounds[heavy], each)
        owner = np.repeat(np.arange(len(heavy)), each)
        at, owner = at[~alone[at]], owner[~alone[at]]
        order = np.lexsort((flat[at], chunks_with[at], owner))
        own, cuts = flat[at[order]], np.r_[0, np.cumsum(each - gone[heavy])]
        keys, of = rule.lists(each, own, cuts)
        found, stand = _stars([keys], docs[chosen[heavy[of]]])
        found = _once(*found)
        rows.append((-1, LISTS, found[0].tobytes(), found[1].tobytes()))
        dealt = packed.dealt(0, keys[stand], [keys[stand], docs[chosen[heavy[of[stand]]]].view(np.uint64)], max(1, buckets // LISTS_TO_BUCKET), (6, 8))
        rows += [(r["bucket"], LISTS, r["c0"], r["c1"]) for r in dealt.to_pylist()]
        for k, i in enumerate(chosen[heavy].tolist()):
            rows.append((-1, SETS, own[cuts[k] : cuts[k + 1]].tobytes(), None, None, None, None, int(docs[i]), int(sizes[i])))
    return _rows(rows)


_ENTRIES = "bucket int, kind int, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary, doc_id long, n long"
_EDGES = "kind int, a long, b long"


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.int64())
    names = ("bucket", "kind", "c0", "c1", "c2", "c3", "c4", "doc_id", "n")
    return pa.table({n: pa.array([r[i] if i < len(r) else None for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds))})


def _edges(kind: int, a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"kind": pa.array(np.full(len(a), kind, np.int32)), "a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64))})


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once: sets that share one list share many."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def _met(table: pa.Table, rule: Rule) -> pa.Table:
    """Stars of the keys of one bucket."""
    column = lambda i, width: np.concatenate([packed.widened(x.as_py(), width) for x in table.column(f"c{i}")])
    docs = column(1, 8).view(np.int64)
    if table.column("kind")[0].as_py() == LISTS:
        return _edges(LISTS, *_once(*_stars([column(0, 6)], docs)[0]))
    return _edges(LINKS, *_stars([column(0, 8), column(4, 8)], docs, column(2, 3).view(np.int64), column(3, 3).view(np.int64), rule)[0])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that chunks found by themselves, unpacked."""
    for batch in batches:
        for kind, a, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "c0", "c1"))):
            yield from _edges(kind, np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)).to_batches()


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs, sizes, known in zip(*(batch.column(c).to_pylist() for c in ("c0", "c1", "c2"))):
            valid = np.frombuffer(known, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(docs, np.int64), mask=~valid), pa.array(np.frombuffer(sizes, np.int64))], ["doc_id", "n_shingles"])


class Sets:
    """The sets of one task of the search, with the lists they are in."""

    def __init__(self, table: pa.Table, rule: Rule):
        self.rule = rule
        docs, sizes = table.column("doc_id").to_numpy(), table.column("n").to_numpy()
        self.order = order = np.lexsort((docs, sizes))
        self.docs, self.sizes = docs[order], sizes[order]
        owns = table.column("own").to_pylist()
        flat = np.frombuffer(b"".join(owns[i] for i in order), np.uint64)
        self.held = np.array([len(owns[i]) // 8 for i in order], np.int64)
        self.bounds = np.r_[0, np.cumsum(self.held)]
        self.codes, forms = pd.factorize(flat)
        self.marked = np.zeros(len(forms), bool)
        keys, owner = rule.lists(self.sizes, flat, self.bounds)
        lists, self.keys = pd.factorize(keys)
        # Lists of one set lead nowhere.
        shared = np.bincount(lists, minlength=len(self.keys))[lists] > 1
        lists, owner = lists[shared], owner[shared]
        by_list, by_set = np.argsort(lists, kind="stable"), np.argsort(owner, kind="stable")
        self.members, self.member_bounds = owner[by_list], np.searchsorted(lists[by_list], np.arange(len(self.keys) + 1))
        self.lists, self.list_bounds = lists[by_set], np.searchsorted(owner[by_set], np.arange(len(docs) + 1))

    def lists_of(self, k: int) -> np.ndarray:
        return self.lists[self.list_bounds[k] : self.list_bounds[k + 1]]

    def near(self, k: int, open_: np.ndarray) -> np.ndarray:
        """The open sets that share a list with set k and whose size allows a link."""
        own, n = self.lists_of(k), int(self.sizes[k])
        lo = np.searchsorted(self.sizes, -(-self.rule.percent * n // 100))
        hi = np.searchsorted(self.sizes, n * 100 // self.rule.percent, side="right")
        found = self.members[_ranges(self.member_bounds[own], self.member_bounds[own + 1] - self.member_bounds[own])]
        hit = np.zeros(len(self.docs), bool)
        hit[found] = True
        hit[:lo] = hit[hi:] = False
        found = np.flatnonzero(hit & open_)
        # Shingles that no other set has are in no overlap.
        return found[self.rule.linked(np.minimum(self.held[k], self.held[found]), n, self.sizes[found])]

    def linked(self, k: int, near: np.ndarray) -> np.ndarray:
        """Which of ``near`` link with set k, by their whole overlaps."""
        own = self.codes[self.bounds[k] : self.bounds[k + 1]]
        self.marked[own] = True
        each = self.held[near]
        overlap = np.add.reduceat(self.marked[self.codes[_ranges(self.bounds[near], each)]].astype(np.int64), np.r_[0, np.cumsum(each)][:-1])
        self.marked[own] = False
        return near[self.rule.linked(overlap, self.sizes[k], self.sizes[near])]


def _searched(table: pa.Table, rule: Rule) -> pa.Table:
    """Links inside one task: from each set to those it is the first to reach."""
    sets = Sets(table, rule)
    open_ = np.ones(len(sets.docs), bool)
    a, b = [], []
    for start in range(len(sets.docs)):
        if not open_[start]:
            continue
        open_[start] = False
        queue = [start]
        while queue:
            source = queue.pop()
            near = sets.near(source, open_)
            if len(near):
                reached = sets.linked(source, near)
                open_[reached] = False
                a.append(np.full(len(reached), sets.docs[source]))
                b.append(sets.docs[reached])
                queue += reached.tolist()
    return _edges(LINKS, np.concatenate(a) if a else sets.docs[:0], np.concatenate(b) if b else sets.docs[:0])


def _sought(table: pa.Table, rule: Rule) -> pa.Table:
    """Links of the sets that seek with the others of the task that are of another class, one for each class.

    If the task is one list's, a pair is compared only if that is the first of the lists the two share.
    """
    sets = Sets(table, rule)
    roots, seeks, asked = (table.column(c).to_numpy()[sets.order] for c in ("root", "seeks", "unsettled"))
    by_list, name = table.column("by_list")[0].as_py(), table.column("name")[0].as_py()
    a, b = [], []
    for k in np.flatnonzero(seeks).tolist():
        # Two that seek meet twice, as either; the smaller asks.
        near = sets.near(k, ~seeks & (roots != roots[k]) & (~asked | (sets.docs > sets.docs[k])))
        if by_list and len(near):
            own = np.zeros(len(sets.keys), bool)
            own[sets.lists_of(k)] = True
            near = np.array([x for x in near.tolist() if sets.keys[(c := sets.lists_of(x))[own[c]]].min() == np.int64(name).view(np.uint64)], np.int64)
        if len(near):
            reached = sets.linked(k, near)
            reached = reached[np.unique(roots[reached], return_index=True)[1]]
            a.append(np.full(len(reached), sets.docs[k]))
            b.append(sets.docs[reached])
    return _edges(LINKS, np.concatenate(a) if a else sets.docs[:0], np.concatenate(b) if b else sets.docs[:0])


def _keyed(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """One row for each list that a set is in. A batch may have thousands of sets: so many at once as have ``KEYED_ELEMENTS`` (one larger set is alone)."""
    for batch in batches:
        ends = np.cumsum(batch.column("n").to_numpy())
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + KEYED_ELEMENTS, side="right")))
            part = batch.slice(at, end - at)
            owns = part.column("own").to_pylist()
            bounds = np.r_[0, np.cumsum([len(x) // 8 for x in owns])].astype(np.int64)
            keys, of = rule.lists(part.column("n").to_numpy(), np.frombuffer(b"".join(owns), np.uint64), bounds)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(part.column(c).take(pa.array(of)) for c in ("doc_id", "cluster", "root", "unsettled", "n"))], ["name", "doc_id", "cluster", "root", "unsettled", "n"])
            at = end


def _shapes(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """For each set its size class, the parts that aren't empty under it and under the next, and the shingles that others have."""
    for batch in batches:
        ends = np.cumsum(batch.column("n").to_numpy())
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + KEYED_ELEMENTS, side="right")))
            part = batch.slice(at, end - at)
            owns = part.column("own").to_pylist()
            bounds = np.r_[0, np.cumsum([len(x) // 8 for x in owns])].astype(np.int64)
            found = rule.full(part.column("n").to_numpy(), np.frombuffer(b"".join(owns), np.uint64), bounds)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n"), *(pa.array(x.astype(np.int64)) for x in (*found, np.diff(bounds)))], ["doc_id", "n", "class", "now", "next", "held"])
            at = end


def _counted_pairs(table: pa.Table) -> pa.Table:
    """(a, b, k): two sets of different classes that are together in k of these lists. Classes of a common list meet that of its smallest set, with ``_COMMON``."""
    names, docs, roots = (np.concatenate([packed.widened(x.as_py(), 8) for x in table.column(f"c{i}")]).view(np.int64) for i in range(3))
    order = np.lexsort((docs, names))
    names, docs, roots = names[order], docs[order], roots[order]
    new = np.r_[True, names[1:] != names[:-1]]
    first = np.flatnonzero(new)
    each = np.diff(np.r_[first, len(names)])
    start, size = np.repeat(first, each), np.repeat(each, each)
    common_ = np.flatnonzero(size > COMMON_SETS)
    a, b = _once(roots[start[common_]], roots[common_])
    found = [(a[a != b], b[a != b], np.full(int((a != b).sum()), _COMMON))]
    at = np.flatnonzero((size > 1) & (size <= COMMON_SETS))
    pairs = [docs[:0]], [docs[:0]]
    for step in range(1, COMMON_SETS):
        at = at[at + step < start[at] + size[at]]
        apart = at[(roots[at] != roots[at + step]) & (docs[at] != docs[at + step])]
        pairs[0].append(docs[apart])
        pairs[1].append(docs[apart + step])
    a, b = map(np.concatenate, pairs)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    cuts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else docs[:0].astype(np.int64)
    found.append((a[cuts], b[cuts], np.diff(np.r_[cuts, len(a)])))
    return pa.table({c: pa.array(np.concatenate([x[i] for x in found]).astype(np.int64)) for i, c in enumerate("abk")})


def _apart(known: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """``known`` with its clusters cut into those of the classes that links may join; classes that link with no other are left out.

    Lists join unrelated sets into clusters that grow much faster than the input, each pair by a list or two; linked sets share many. Of a set's parts with shingles,
    each that isn't a list of both holds a shingle that one of the two lacks, of which there are held + held - 2 * overlap at most. So
    linked sets of different classes are together in so many lists less than either has such parts, or in a common list.
    """
    spark = known.sparkSession
    own = sets.join(common.sized(known.select("doc_id", "cluster", "root", F.lit(True).alias("unsettled"))), "doc_id")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _keyed(batches, rule):
            name, *rest = (batch.column(c).to_numpy().view(np.uint64) for c in ("name", "doc_id", "root"))
            yield from packed.dealt(0, name, [name, *rest], buckets, (8, 8, 8)).to_batches()
        textkit.give_back()

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _shapes(batches, rule)
        textkit.give_back()

    def pairs(table: pa.Table) -> pa.Table:
        out = _counted_pairs(table)
        textkit.give_back()
        return out

    held = known.agg(F.sum("n")).first()[0] or 0
    buckets = max(common.shuffle_partitions(spark) // LISTS_TO_BUCKET, -(-held // PAIR_ENTRIES), 1)
    lists = own.select("doc_id", "cluster", "root", "unsettled", "n", "own").mapInArrow(keyed, "bucket int, chunk int, c0 binary, c1 binary, c2 binary")
    counts = lists.groupBy("bucket").applyInArrow(pairs, "a long, b long, k long").groupBy("a", "b").agg(F.sum("k").alias("k"))
    # Rows that share a doc_id may have several sets; nothing is known of what those share.
    shape = own.select("doc_id", "n", "own").mapInArrow(shapes, "doc_id long, n long, class long, now long, next long, held long").groupBy("doc_id").agg(
        *(F.when(F.count(F.lit(1)) == 1, F.first(c)).alias(c) for c in ("n", "class", "now", "next", "held"))
    )
    shape = common.written(shape.join(common.sized(known.select("doc_id", "root")), "doc_id"), "shapes")
    for side in "ab":
        counts = counts.join(common.sized(shape.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("root", "n", "class", "now", "next", "held")))), side, "left")
    larger = F.greatest("a_class", "b_class")
    parts = F.greatest(*(F.when(F.col(f"{x}_class") == larger, F.col(f"{x}_now")).otherwise(F.col(f"{x}_next")) for x in "ab"))
    overlap = F.ceil(F.lit(rule.percent) * (F.col("a_n") + F.col("b_n")) / (100 + rule.percent) - 1e-6)
    may = (F.col("k") >= parts - (F.col("a_held") + F.col("b_held") - 2 * overlap)) & (overlap <= F.least("a_held", "b_held"))
    joined = common.written(counts.where((F.col("k") >= _COMMON) | F.coalesce(may, F.lit(True))).select(*(F.coalesce(f"{x}_root", x).alias(x) for x in "ab")).distinct(), "pairs")
    new = graph.components(joined)
    new = new.select(F.col("root").alias("cluster"), F.col("node").alias("root")).unionByName(new.select(F.col("root").alias("cluster"), "root").distinct())
    return common.written(known.drop("cluster").join(common.sized(common.written(new, "apart")), "root").select(*known.columns), "known-apart")


def _unsettled_links(known: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame | None:
    """Links between the classes of large clusters: each set outside the largest class against the rest of its cluster.

    ``known`` is (doc_id, cluster, root, n, least, held) of all their sets: how many shingles, and how many that others have. A
    set that others have too little of for a link with the cluster's smallest set links with none.
    """
    sizes = known.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("sets"), F.min("least").alias("smallest"))
    top = common.written(sizes.groupBy("cluster").agg(F.max_by("root", F.struct("sets", "root")).alias("top"), F.min("smallest").alias("smallest")), "tops")
    hopeful = F.col("held") * (100 + rule.percent) >= (F.col("least") + F.col("smallest")) * rule.percent
    flagged = common.written(known.join(common.sized(top), "cluster").select("doc_id", "cluster", "root", "n", ((F.col("root") != F.col("top")) & hopeful).alias("unsettled")), "flagged")
    blocks = [F.ceil(F.greatest(F.col(c) / SEEK_SETS, F.col(f"{c}_elements") / CLUSTER_ELEMENTS)).cast("int").alias(f"n{c}") for c in "mu"]
    counts = [F.count(F.lit(1)).alias("m"), F.count_if("unsettled").alias("u"), F.sum("n").alias("m_elements"), F.sum(F.when(F.col("unsettled"), F.col("n")).otherwise(0)).alias("u_elements")]
    top = common.written(flagged.groupBy("cluster").agg(*counts).where("u > 0").select("cluster", "m", "u", *blocks), "unsettled")
    if top.isEmpty():
        return None
    copies = F.col("m") * F.col("nu") + F.col("u") * F.col("nm")
    rows = flagged.join(common.sized(top), "cluster").select("doc_id", "cluster", "root", "unsettled", "nm", "nu", (copies > BLOCK_COPIES * F.col("m")).alias("many"))
    rows = common.written(rows, "unsettled-sets")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _keyed(batches, rule)
        textkit.give_back()

    entries = sets.join(common.sized(rows.where("many").drop("nm", "nu", "many")), "doc_id").select("doc_id", "cluster", "root", "unsettled", "n", "own").mapInArrow(keyed, "name long, doc_id long, cluster long, root long, unsettled boolean, n long")
    lists = entries.groupBy("cluster", "name").agg(*counts, F.min("root").alias("lo"), F.max("root").alias("hi")).where("u > 0 AND lo <> hi").select("cluster", "name", "m", "u", *blocks)
    lists = common.written(lists.withColumn("copies", copies), "lists")
    # The cheaper way for each cluster: its lists one by one, or all its blocks. Those without lists left have nothing to compare.
    cost = lists.groupBy("cluster").agg(F.sum("copies").alias("by_lists"))
    way = common.written(top.where(copies > BLOCK_COPIES * F.col("m")).join(cost, "cluster", "left").select("cluster", F.coalesce(F.col("by_lists") < copies, F.lit(True)).alias("by_list")), "ways")
    entries = entries.drop("n")
    whole = rows.join(common.sized(way), "cluster", "left").where("NOT many OR NOT by_list").withColumns({"name": F.col("cluster"), "by_list": F.lit(False)}).drop("many")
    listed = entries.join(common.sized(way.where("by_list")), "cluster").join(common.sized(lists.select("cluster", "name", "nm", "nu")), ["cluster", "name"])
    dealt = whole.unionByName(listed).withColumns({"block": F.pmod(F.xxhash64("doc_id"), F.col("nm")).cast("int"), "turn": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("nu")).cast("int")})
    columns = ["doc_id", "name", "by_list", "root", "unsettled"]
    still = dealt.select(*columns, F.lit(False).alias("seeks"), "block", F.explode(F.sequence(F.lit(0), F.col("nu") - 1)).alias("turn"))
    ask = dealt.where("unsettled").select(*columns, F.lit(True).alias("seeks"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("block"), "turn")

    def seek(table: pa.Table) -> pa.Table:
        out = _sought(table, rule)
        textkit.give_back()
        return out

    tasks = common.written(still.unionByName(ask), "tasks")
    return sets.join(common.sized(tasks), "doc_id").groupBy("by_list", "name", "block", "turn").applyInArrow(seek, _EDGES)


def classes(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id."""
    common.ship(docs.sparkSession)
    rule = Rule(width, percent)
    by_chunk, buckets = packed.layout(docs, CHUNKS_TO_BUCKET, CHUNK_GROWTH)

    def send(table: pa.Table) -> pa.Table:
        out = _sent(table, rule, buckets)
        textkit.give_back()
        return out

    def enter(table: pa.Table, replies: pa.Table) -> pa.Table:
        out = _entries(table, replies, rule, buckets)
        textkit.give_back()
        return out

    def meet(table: pa.Table) -> pa.Table:
        out = _met(table, rule)
        textkit.give_back()
        return out

    def search(table: pa.Table) -> pa.Table:
        out = _searched(table, rule)
        textkit.give_back()
        return out

    def count(table: pa.Table) -> pa.Table:
        out = _counted(table)
        textkit.give_back()
        return out

    counted = by_chunk.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, c0 binary").groupBy("bucket").applyInArrow(count, "chunk int, c0 binary, c1 binary, bucket int")
    entries = common.written(by_chunk.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(enter, _ENTRIES), "entries")

    met = entries.where("bucket >= 0").groupBy("bucket", "kind").applyInArrow(meet, _EDGES)
    inside = entries.where(f"bucket < 0 AND kind IN ({LISTS}, {LINKS})").mapInArrow(_pairs, _EDGES)
    links = common.written(met.unionByName(inside), "stars")

    # Rows that share a doc_id may each have a set; they are one node.
    sets = entries.where(f"kind = {SETS}").select("doc_id", "n", F.col("c0").alias("own"))
    clusters = graph.components(links.where(f"kind = {LISTS}").select("a", "b"))
    listed = clusters.select(F.col("node").alias("doc_id"), F.col("root").alias("cluster")).unionByName(clusters.select(F.col("root").alias("doc_id"), F.col("root").alias("cluster")).distinct())
    member = common.written(listed.join(sets.groupBy("doc_id").agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.max(F.expr("octet_length(own) DIV 8")).alias("held")), "doc_id"), "members")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / CLUSTER_ELEMENTS)).cast("int")
    large = common.written(member.groupBy("cluster").agg(blocks.alias("blocks")).where("blocks > 1"), "large")
    bins = max(common.shuffle_partitions(docs.sparkSession), -(-(member.agg(F.sum("n")).first()[0] or 0) // CLUSTER_ELEMENTS))
    placed = member.join(common.sized(large), "cluster", "left")
    small = placed.where("blocks IS NULL").select("doc_id", F.lit(None).cast("long").alias("whole"), F.pmod(F.xxhash64("cluster"), F.lit(bins)).cast("int").alias("block"))
    hub = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.ceil(F.col("blocks") * BLOCK_SETS / HUBS)) == 0
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    dealt = placed.where("blocks > 1").select("doc_id", F.col("cluster").alias("whole"), F.explode(F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(mine))).alias("block"))
    tasks = common.written(small.unionByName(dealt), "tasks")
    verified = sets.join(common.sized(tasks), "doc_id").groupBy("whole", "block").applyInArrow(search, _EDGES)
    found = common.written(links.where(f"kind = {LINKS}").select("a", "b").unionByName(verified.select("a", "b")), "found")
    roots = graph.components(found)
    if not large.isEmpty():
        known = member.join(common.sized(large), "cluster").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "cluster", F.coalesce("root", "doc_id").alias("root"), "n", "least", "held")
        more = _unsettled_links(_apart(common.written(known, "known"), sets, rule), sets, rule)
        if more is not None:
            roots = graph.components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more.select("a", "b")))
    rows = entries.where(f"kind = {DOCS}").mapInArrow(_documents, "doc_id long, n_shingles long")
    return rows.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class (or null), all columns as they came."""
    found = classes(docs, width, percent)
    gone = common.written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct(), "near")
    return docs.join(common.sized(gone), docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS x FROM d),
n AS (SELECT d.doc_id, count(x)::BIGINT AS n FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, coalesce(min(r.root), n.doc_id) AS component_id FROM n LEFT JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
