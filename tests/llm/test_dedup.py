import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstore.llm import exact_dedup, jaccard_join, substring_dedup

from . import brute

#: Columns that clash with names used inside the operators.
EXTRA = ("fp", "row", "norm", "id", "chunk", "bucket", "label", "hash", "component_id", "gone_id", "kept", "c0", "text_hash")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in EXTRA})


def odd_rows():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (3, 12, 14, 22, 24, 40, 90, 150, 151)]
    rows = []
    for i in range(150):
        words = r.choice(base).split(" ")
        for _ in range(r.choice((0, 0, 0, 1, 1, 2, 4))):
            words[r.randrange(len(words))] = r.choice(vocabulary + ["Neu", "É"])
        if r.random() < 0.2:
            words = words[r.randrange(len(words)) :] + r.choice(base).split(" ")
        rows.append((i, r.choice((" ", "\n", " \t")).join(words)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "one"), (204, "One"), (205, "one two"), (206, "a\xa0b c d"), (207, " ".join(f"v{i}" for i in range(30_000)))]
    rows += [(208, rows[-1][1]), (None, base[-1]), (None, None), rows[3], rows[3], (209, "x" * 200_000)]
    return rows


def test_exact(spark):
    rows = odd_rows()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.mark_duplicates(frame(spark, rows)).collect())
    import re

    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    keep = {n: min((i for (i, _), m in zip(rows, norm) if m == n and i is not None), default=None) for n in norm}
    want = sorted((i is None, i or 0, keep[n], norm.count(n), i == keep[n], brute.sha(n)) for (i, _), n in zip(rows, norm))
    assert got == want
    left = exact_dedup.drop_duplicates(frame(spark, rows))
    assert left.columns == frame(spark, rows[:1]).columns
    kept = left.select("doc_id", "text").collect()
    assert len(kept) == len(set(norm)) and {r.doc_id for r in kept} == {keep[n] for n in norm}


def test_filters_merge_losslessly():
    import numpy as np

    r = np.random.default_rng(2)
    parts = [r.integers(0, 1 << 63, 500, dtype=np.uint64) % 400 * np.uint64(0x9E3779B97F4A7C15) for _ in range(3)]
    parts.append(np.zeros(300, np.uint64))
    merged = exact_dedup.CountingQuotientFilter.merged([exact_dedup.CountingQuotientFilter.from_row(*exact_dedup.CountingQuotientFilter.of(p).to_row()) for p in parts])
    forms, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (np.sort(merged.fingerprints()) == forms).all() and merged.counts[np.argsort(merged.fingerprints())].tolist() == counts.tolist()
    split = [f.fingerprints() for _, f in merged.split(5)]
    assert sum(map(len, split)) == len(forms)


def test_substring(spark):
    rows = odd_rows()
    got = sorted(map(tuple, substring_dedup.remove_repeats(frame(spark, rows)).collect()), key=str)
    assert got == sorted(brute.substring(rows), key=str)
    digests = {r.kept_sha256 for r in substring_dedup.remove_repeats(frame(spark, rows), digest=True).collect()}
    assert digests == {brute.sha(x[3]) for x in got}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard(spark, monkeypatch, width, percent):
    monkeypatch.setattr(jaccard_join, "CLUSTER_ELEMENTS", 500)  # so that clusters are dealt into blocks
    rows = odd_rows()
    distinct = [x for n, x in enumerate(rows) if x[0] is None or x[0] not in {i for i, _ in rows[:n]}]
    got = sorted(map(tuple, jaccard_join.classes(frame(spark, distinct), width, percent).collect()), key=str)
    assert got == sorted(brute.classes(distinct, width, percent), key=str)
    left = {r.doc_id for r in jaccard_join.drop_near_duplicates(frame(spark, distinct), width, percent).collect()}
    assert left == {i for i, _, c in got if i == c}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_large_clusters(spark, monkeypatch, width, percent):
    """Near copies, groups that share parts without linking, and a chain of overlapping texts, in clusters of many small blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard_join, "SEEK_SETS", 4)
    monkeypatch.setattr(jaccard_join, "HUBS", 1)
    ways = []
    monkeypatch.setattr(jaccard_join, "_unsettled_links", lambda known, sets, rule, own=jaccard_join._unsettled_links: ways.append(own(known, sets, rule)) or ways[-1])
    r = random.Random(12)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    rows = []
    for most in (2, 9):
        base = words(160)
        for _ in range(70):
            own = list(base)
            for _ in range(r.randint(0, most)):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    long = words(3000)
    rows += [(len(rows) + i, " ".join(long[23 * i : 23 * i + 160])) for i in range(100)]
    rows += [(-5 - i, " ".join(words(40))) for i in range(20)]
    r.shuffle(rows)
    got = sorted(map(tuple, jaccard_join.classes(frame(spark, rows), width, percent).collect()), key=str)
    assert got == sorted(brute.classes(rows, width, percent), key=str)
    assert len(ways) == 1 and ways[0] is not None


def test_either_way_of_settling_finds_every_link(spark, monkeypatch):
    """A chain whose neighbours link, and a group that all link, each set in a class of its own as yet: lists are cheaper for the chain, blocks for the group."""
    import numpy as np

    kept, written = {}, jaccard_join.common.written
    monkeypatch.setattr(jaccard_join.common, "written", lambda df, name: kept.setdefault(name, []).append(written(df, name)) or kept[name][-1])
    monkeypatch.setattr(jaccard_join, "SEEK_SETS", 4)

    r, rule = random.Random(3), jaccard_join.Rule(3, 90)
    for shift, count, by_list in ((3, 300, True), (0, 40, False)):
        long = np.array([r.getrandbits(64) for _ in range(shift * count + 150)], np.uint64)
        own = [long[shift * i : shift * i + 150].copy() for i in range(count)]
        for i, x in enumerate(own):
            x[:3] = [r.getrandbits(64) for _ in range(3)]
        sets = spark.createDataFrame([(i, len(x), bytearray(x.tobytes())) for i, x in enumerate(own)], "doc_id long, n long, own binary")
        known = spark.createDataFrame([(i, 7, i, 150, 150, 150) for i in range(count)], "doc_id long, cluster long, root long, n long, least long, held long")
        found = jaccard_join._unsettled_links(known, sets, rule)
        got = {tuple(sorted((x.a, x.b))) for x in found.collect()}
        held = [set(x.tolist()) for x in own]
        want = {(i, j) for i in range(count) for j in range(i + 1, count) if rule.linked(len(held[i] & held[j]), len(held[i]), len(held[j]))}
        assert got == want and want
        assert [x.by_list for x in kept["ways"][-1].collect()] == [by_list]


def test_large_clusters_fall_apart_where_sets_share_few_lists(spark, monkeypatch):
    """Sets that share a third with their neighbours make one cluster; only those that may link are held against others, and no link is lost."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(jaccard_join, "HUBS", 1)
    monkeypatch.setattr(jaccard_join, "COMMON_SETS", 12)
    given, own = [], jaccard_join._unsettled_links
    monkeypatch.setattr(jaccard_join, "_unsettled_links", lambda known, *a: given.append((known.count(), known.select("cluster").distinct().count())) or own(known, *a))
    r = random.Random(8)
    long = [f"w{r.randrange(10**6)}" for _ in range(12_000)]
    rows = [(i, " ".join(long[70 * i : 70 * i + 160])) for i in range(150)]
    for i in range(0, 150, 10):
        for k in range(2):
            words = rows[i][1].split(" ")
            words[20 + 60 * k] = "other"
            rows.append((1000 + 10 * i + k, " ".join(words)))
    got = sorted(map(tuple, jaccard_join.classes(frame(spark, rows), 5, 80).collect()), key=str)
    assert got == sorted(brute.classes(rows, 5, 80), key=str) and len({c for _, _, c in got}) == 150
    assert len(given) == 1 and given[0][0] < 60 and given[0][1] != 1


def test_pairs_are_counted_by_the_lists_they_share():
    from collections import Counter
    from itertools import combinations

    r = random.Random(1)
    lists = {name: sorted(r.sample(range(300), r.choice((1, 2, 3, 8, 32, 33, 60)))) for name in range(80)}
    root = [i - i % 3 for i in range(300)]
    rows = [(name, d, root[d]) for name, docs in lists.items() for d in docs]
    r.shuffle(rows)
    names, docs, roots = (np.array(x, np.int64) for x in zip(*rows))
    out = jaccard_join._counted_pairs(pa.table({f"c{i}": [x[:700].tobytes(), x[700:].tobytes()] for i, x in enumerate((names, docs, roots))}))
    want = Counter(p for docs in lists.values() if len(docs) <= jaccard_join.COMMON_SETS for p in combinations(docs, 2) if root[p[0]] != root[p[1]])
    stars = {(root[docs[0]], root[d]) for docs in lists.values() if len(docs) > jaccard_join.COMMON_SETS for d in docs if root[d] != root[docs[0]]}
    got = list(zip(*(out.column(c).to_pylist() for c in "abk")))
    assert {(a, b): k for a, b, k in got if k < jaccard_join._COMMON} == want
    assert sorted((a, b) for a, b, k in got if k == jaccard_join._COMMON) == sorted(stars)


def test_parts_hold_every_link_and_few_others():
    """Linked sets share a list; unrelated sets over common shingles don't."""
    import numpy as np

    g = np.random.default_rng(6)
    for percent in (80, 90):
        rule = jaccard_join.Rule(3, percent)
        for n in (jaccard_join.Rule(3, percent).boundary() + 1, 40, 333):
            shared = 0
            for _ in range(60):
                pool = g.permutation(1 << 20).astype(np.uint64) + np.uint64(1)
                b = int(g.integers(n, n * 100 // percent + 1))
                overlap = next(k for k in range(n + 1) if rule.linked(k, n, b))
                if overlap > n:
                    continue
                x, y = pool[:n], np.r_[pool[:overlap], pool[n : n + b - overlap]]
                keys, of = rule.lists(np.array([n, b]), np.concatenate([x, y]), np.array([0, n, n + b]))
                assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())
                z = np.concatenate([pool[: n // 3], pool[2 * n : 3 * n - n // 3]])
                keys, of = rule.lists(np.array([n, n]), np.concatenate([x, z]), np.array([0, n, 2 * n]))
                shared += bool(set(keys[of == 0].tolist()) & set(keys[of == 1].tolist()))
            # At 80 percent parts hold some four shingles, so sets that share a third often meet (and are then counted).
            assert n < 100 or percent < 90 or shared <= 12


def test_unrelated_texts_over_common_shingles_form_no_clusters(spark):
    r = random.Random(2)
    rows = [(i, " ".join(f"w{r.randrange(25)}" for _ in range(200))) for i in range(600)]
    rows += [(1000, rows[5][1] + " more"), (1001, rows[6][1])]
    chunks, buckets = jaccard_join.packed.layout(frame(spark, rows), 3)
    got = {x.doc_id: x.component_id for x in jaccard_join.classes(frame(spark, rows)).collect()}
    assert got == {i: {1000: 5, 1001: 6}.get(i, i) for i, _ in rows}
    import numpy as np

    rule = jaccard_join.Rule(3, 90)
    import pyarrow as pa

    sets = list(jaccard_join._sets(pa.array([t for _, t in rows[:600]], pa.large_string()), rule))
    keys, of = rule.lists(np.array([len(s) for s in sets]), np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])])
    names, times = np.unique(keys, return_counts=True)
    assert times[times > 1].sum() < 0.02 * len(keys)


def test_tasks_hold_no_more_text_at_ten_gigabytes(spark, monkeypatch):
    asked, own = [], jaccard_join.packed.layout
    monkeypatch.setattr(jaccard_join.packed, "layout", lambda docs, *a: asked.append(a) or own(docs, *a))
    jaccard_join.classes(frame(spark, [(1, "one text of a few words")]))
    large = spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100_000_000).alias("text"))
    _, buckets = own(large, *asked[0])
    # Counted over chunks of the smallest size, as at half a gigabyte.
    assert buckets >= 10**10 // (jaccard_join.CHUNKS_TO_BUCKET * jaccard_join.packed.SMALLEST_CHUNK)


def test_lists_are_named_for_a_few_sets_at_once(monkeypatch):
    monkeypatch.setattr(jaccard_join, "KEYED_ELEMENTS", 300)
    r, rule = random.Random(4), jaccard_join.Rule(5, 80)
    sets = [[r.randrange(1 << 63) for _ in range(n)] for n in (90, 120, 20, 1000, 30, 250, 50, 60)]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": list(range(len(sets))), "cluster": [7] * len(sets), "root": list(range(len(sets))), "unsettled": [k % 2 == 0 for k in range(len(sets))],
        "n": [len(x) for x in sets], "own": [np.array(x, np.uint64).tobytes() for x in sets],
    })
    found = list(jaccard_join._keyed([batch], rule))
    assert [sorted(set(b.column("doc_id").to_pylist())) for b in found] == [[0, 1, 2], [3], [4, 5], [6, 7]]
    keys, of = rule.lists(np.array([len(x) for x in sets]), np.concatenate([np.array(x, np.uint64) for x in sets]), np.r_[0, np.cumsum([len(x) for x in sets])])
    got = [(row["name"], row["doc_id"], row["unsettled"], row["n"]) for b in found for row in b.to_pylist()]
    assert sorted(got) == sorted((k, d, d % 2 == 0, len(sets[d])) for k, d in zip(keys.view(np.int64).tolist(), of.tolist()))


def test_boundary_follows_cost():
    assert jaccard_join.Rule(3, 90).boundary() == 19 and jaccard_join.Rule(5, 80).boundary() == 9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")], [(None, "a b c")]])
def test_hardly_any_rows(spark, rows):
    df = frame(spark, rows)
    assert exact_dedup.mark_duplicates(df).count() == len(rows)
    assert exact_dedup.drop_duplicates(df).count() == len(rows)
    assert substring_dedup.remove_repeats(df).count() == len(rows)
    assert jaccard_join.classes(df).count() == len(rows)
