import os

import pytest

import corpus_pipeline
from quillstore.llm import packing, quality

from . import brute
from .test_decontaminate import _shingles

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_against_plain_versions(spark, tmp_path):
    """Each stage on the rows that the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        assert kept.columns == docs.columns
        if k == 0:
            scores = quality.score(docs, quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
            want = [(r.doc_id, r.text) for r in scores if r.score >= quality.ACCEPT]
        elif k == 1:
            first = {}
            for i, t in sorted(rows):
                first.setdefault(" ".join(__import__("re").split(r"[\x20\x09-\x0D]+", t or "")), (i, t))
            want = list(first.values())
        elif k == 2:
            want = [x for x, (i, _, c) in zip(rows, brute.classes(rows, 5, 80)) if i == c]
        else:
            sets = [_shingles(t) for _, t in items]
            want = [(i, t) for i, t in rows if not any(s and 100 * len(s & _shingles(t)) >= 80 * len(s) for s in sets)]
        docs, rows = kept, sorted((r.doc_id, r.text) for r in kept.collect())
        assert rows == sorted(want), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in rows}
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert packing.TIERS[0] >= max(p.offset + p.length for p in pieces)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
