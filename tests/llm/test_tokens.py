import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstore.llm import packing, token_counts
from quillstore.llm.token_counts import tokenizer_path

from . import brute

PARTS = ["a", "B", "c's", "'S", "'", "’", " ", "\n", "\xa0", "é", "É", "́", "Σ", "ß", "1", "²", "-", "!!", "<|endoftext|>", "<|", "|>", "<|EndOfText|>", "李", "😀", "\x85", "re", "'re", "'LL", "ſ", "İ", "word", "Other"]


def texts():
    r = random.Random(5)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(400)] + [None, "", " ", "word, " * 9000, "x" * 30_000, "The THE the. the"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n_tokens", "shard", "counts", "start", "tier")})


def test_counts_are_the_tokenizers(spark, tokenizer):
    rows = [*enumerate(texts()), (None, "word"), (3, "again"), (3, "again")]
    got = sorted(map(tuple, token_counts.count_tokens(frame(spark, rows)).collect()), key=str)
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((i, len((t or "").encode()), n(t), n(t) > 2048) for i, t in rows), key=str)


@pytest.mark.parametrize("letter", ["H\u0331", "J\u030c", "T\u0308", "W\u030a", "Y\u030a", "T\u0308\u0301"])
@pytest.mark.parametrize("around", ["{}", "The {} THE", "A{}B c'{}", "({}) É{}-{}x"])
def test_capitals_that_compose_only_as_small_letters(tokenizer, letter, around):
    texts = [around.replace("{}", x) for x in (letter, letter.lower(), letter[0])] + ["\u030c", "The"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
    words, encoder = token_counts.segments_of(data, offsets), token_counts.SegmentEncoder(tokenizer_path())
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    ids, bounds = packing.encode_block(words, encoder, 1)
    assert [ids[a : b - 1].tolist() for a, b in zip(bounds, bounds[1:])] == want
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint16))
    assert token_counts.count_words(words, none, encoder).tolist() == [len(x) for x in want]


def test_a_small_table_changes_nothing(spark, tokenizer):
    rows = list(enumerate(texts()))
    df = frame(spark, rows)
    hashes, sizes, lengths = token_counts.frequent_lengths(df.select("text"), tokenizer_path(), entries=7, summary=5)
    assert len(hashes) <= 7 and (np.diff(hashes.astype(object)) > 0).all() and len(sizes) == len(lengths)


def test_packing_round_trip(spark, tokenizer):
    rows = [*enumerate(texts()), (None, "word")]
    pieces = packing.pack(frame(spark, rows).repartition(3)).collect()
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == want.keys()
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[i]) and p.ids_crc32 == brute.crc(want[i][at : at + p.length])
            at += p.length
        assert at == len(want[i])
    padding = total = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.r_[0, np.cumsum([p.length for p in own])][:-1].tolist()
        n = sum(p.length for p in own)
        assert n <= 2048
        total += n
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding <= 3 * 2048  # one window a partition
    groups = {}
    for p in pieces:
        groups.setdefault(p.step_group, set()).add(p.tier)
    assert all(len(t) == 1 for t in groups.values())


def test_step_groups_are_even():
    r = np.random.default_rng(1)
    p = packing.Packer()
    for i, n in enumerate(r.integers(1, 6000, 3000)):
        p.add(i, np.zeros(n, np.uint32))
    p.finish()
    costs = {}
    for tier, group in p.groups(last=True):
        costs.setdefault(tier, []).append(sum(len(x[2]) ** 2 for s in group for x in s) / len(group))
    top = costs[2048]
    assert max(top) < 1.1 * min(top)


def test_empty_tables(spark):
    df = frame(spark, [])
    assert token_counts.count_tokens(df).count() == 0 and packing.pack(df).count() == 0
