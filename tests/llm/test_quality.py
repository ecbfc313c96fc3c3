import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstore.llm import quality

SF = "/root/testdata/sf0.01"


def test_the_identity_equals_all_pairs():
    r = np.random.default_rng(3)
    model = quality.FactorisationMachine(0.3, r.normal(size=quality.SIZE).astype(np.float32), r.normal(size=(quality.SIZE, quality.RANK)).astype(np.float32))
    index, value, bounds = np.array([5, 9, 65_800, 2, 3]), r.random(5).astype(np.float32), np.array([0, 3, 5])
    got = model.margins(index, value, bounds)[0]
    for k, (a, b) in enumerate(((0, 3), (3, 5))):
        want = 0.3 + sum(model.weights[index[i]] * value[i] for i in range(a, b))
        want += sum(float(model.factors[index[i]] @ model.factors[index[j]]) * value[i] * value[j] for i in range(a, b) for j in range(i + 1, b))
        assert got[k] == pytest.approx(want, rel=1e-4)


def test_features_do_not_depend_on_neighbours():
    texts = ["", "a b a\nc", "é!! WORD", " \n\n", "line\nline\nline", "x"]
    alone = [quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), np.array([len(t)])) for t in texts]
    raw = "".join(texts).encode()
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    index, value, bounds = quality.features(np.frombuffer(raw, np.uint8), offsets, np.array([len(t) for t in texts]))
    for k, (i, v, _) in enumerate(alone):
        a, b = bounds[k], bounds[k + 1]
        assert (index[a:b] == i).all() and np.allclose(value[a:b], v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_quality(spark):
    scored = quality.op1_quality(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(scored) == 1000 and scored.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(scored.doc_id, scored.held_out))
    held = scored[scored.held_out].merge(labels, on="doc_id")
    good = held.quality == 1
    ranks = held.score.rank()
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97 and (held.predicted == held.quality).mean() > 0.93 and held[good].predicted.mean() > 0.95


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", 0), (None, "a b", 3), (3, "long word " * 30_000, None), (4, "x", 1), (4, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({c: F.lit("x") for c in ("score", "label", "i", "id", "chars", "c0")})
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 1), (None, 1), (9, None)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    model = quality.train(docs, labels)
    scored = quality.score(docs, model, "s")
    assert scored.columns == [*docs.columns, "s"] and scored.count() == len(rows)
    assert quality.drop_rejected(docs, labels, accept=0.0).columns == docs.columns
    assert quality.drop_rejected(docs, labels, accept=0.0).count() == len(rows)
    empty = quality.score(docs, quality.train(docs, labels.limit(0)), "s").select("s").collect()
    assert all(abs(r.s - 0.5) < 0.01 for r in empty)
    assert quality.score(docs.limit(0), model).count() == 0


def _small(spark):
    rows = [(i, ("good words in order " if i % 2 else "buy now!!! $$$ click ") * (3 + i % 5), None) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")


def test_repeated_rows_teach_once(spark):
    docs, labels = _small(spark)
    once, often = quality.train(docs, labels), quality.train(docs.unionByName(docs).unionByName(docs.where("doc_id < 20")).repartition(5), labels.unionByName(labels))
    assert once.bias == often.bias and (once.weights == often.weights).all() and (once.factors == often.factors).all()
    # The least text stands for its doc_id.
    other = spark.createDataFrame([(i, "zzz", None) for i in range(60)], "doc_id long, text string, n_chars long")
    assert (quality.train(docs.unionByName(other), labels).weights == once.weights).all()


def test_predicted_follows_the_threshold(spark, tmp_path):
    docs, labels = _small(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = quality.op1_quality(spark, str(tmp_path)).collect()
    assert len(rows) == 60 and all(r.predicted == (r.score >= 0.7) for r in rows)
    assert [r.predicted for r in sorted(rows)] == [i % 2 for i in range(60)]
    kept = quality.drop_rejected(docs, labels)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(1, 60, 2))
