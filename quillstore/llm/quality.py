"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), so all pairwise
interactions cost time linear in a document's features. Features are the document's words (A-Z as a-z,
hashed to ``BUCKETS`` places, log counts scaled to unit length), one bin for each structure statistic of the text
(lengths, shares of character classes, repeated words, runs of words and lines), and bins of the metadata column
n_chars, as it stands and against the text's own length. doc_id, lang, source and labels are never features.

The model is trained on the driver from at most ``SAMPLE`` labelled rows: those of least hash of the
doc_id among rows whose crc32(doc_id as text) mod 4 isn't 2. The sample bounds what the
driver holds; scoring reads every document whole, where it lies, with no shuffle.

Null texts count as empty and are scored from their statistics. Without labels every score is 0.5. Null doc_ids
are never training rows. Several labels of one doc_id count as their least, and of rows with one doc_id the least text is learnt from. Rows come back as they came,
repeated ones too; extra columns are ignored by ``score`` and kept by ``drop_rejected``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textkit

BUCKETS = 1 << 16
RANK = 8
SAMPLE = 8000
EPOCHS = 12
ACCEPT = 0.7
BINS = 20
_CLASSES = tuple(
    np.isin(np.arange(256), list(x))
    for x in (range(65, 91), range(97, 123), range(48, 58), b".,;:!?", b"|#$%&*@<>{}[]()\\/=+-_~^`\"'", b"\n", b" \t", range(128, 256), b"!")
)
STATISTICS = len(_CLASSES) + 9
SIZE = BUCKETS + STATISTICS * BINS


def _shares(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return top / np.maximum(bottom, 1)


def _share_bins(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-2 * np.log2(np.clip(x, 0, 1) + 2.0**-9)), 0, BINS - 1).astype(np.int64)


def _size_bins(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(1.2 * np.log2(1 + np.maximum(x, 0))), 0, BINS - 1).astype(np.int64)


def _per_document(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each of n documents has."""
    codes, forms = pd.factorize(textkit.mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    if not len(codes):
        return np.zeros(n, np.int64)
    seen = np.zeros(len(forms), np.int64)
    seen[codes] = owner
    return np.bincount(seen, minlength=n)


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of a block's documents one after another, and their bounds."""
    n = len(offsets) - 1
    words = textkit.Words(data, offsets, lower=True)
    counts, size = words.counts(), np.diff(offsets)
    owner = np.repeat(np.arange(n), counts)
    keys = owner.astype(np.int64) * BUCKETS + (words.hashes % np.uint64(BUCKETS)).astype(np.int64)
    cells, times = np.unique(keys, return_counts=True)
    values = np.log1p(times)
    doc = cells // BUCKETS
    values /= np.sqrt(np.bincount(doc, values**2, minlength=n))[doc]

    shares = []
    for allowed in _CLASSES:
        total = np.r_[0, np.cumsum(allowed[data])]
        shares.append(_shares(total[offsets[1:]] - total[offsets[:-1]], size))
    top = np.zeros(n)
    np.maximum.at(top, doc, times)
    shares.append(_shares(_per_document(owner, words.hashes, n), counts))
    shares.append(_shares(top, counts))
    runs, at = words.windows(5), np.arange(max(0, len(words.hashes) - 4))
    fits = at + 5 <= words.bounds[1:][owner[: len(at)]] if len(at) else np.zeros(0, bool)
    shares.append(_shares(_per_document(owner[: len(at)][fits], runs[fits], n), np.maximum(counts - 4, 0)))
    breaks = np.r_[np.flatnonzero(data == 10), len(data)]
    starts = np.unique(np.r_[offsets[:-1], breaks[:-1] + 1])
    starts = starts[starts < len(data)]
    ends = np.minimum(breaks[np.searchsorted(breaks, starts)], offsets[np.searchsorted(offsets, starts, side="right")])
    starts, ends = starts[ends > starts], ends[ends > starts]
    line_owner = np.searchsorted(offsets, starts, side="right") - 1
    lines = np.bincount(line_owner, minlength=n)
    shares.append(_shares(_per_document(line_owner, textkit.rolled(textkit._BYTES[data], starts, ends, 0xD1342543DE82EF95), n), lines))
    bins = [_share_bins(x) for x in shares]
    bins += [_size_bins(counts), _size_bins(lines), np.clip(np.rint(2 * _shares(size, counts)), 0, BINS - 1).astype(np.int64)]
    bins += [_size_bins(n_chars), np.clip(np.rint(_shares(n_chars, size) * 8), 0, BINS - 1).astype(np.int64)]
    assert len(bins) == STATISTICS

    number = np.arange(STATISTICS) * BINS + BUCKETS
    each = np.bincount(doc, minlength=n)
    bounds = np.r_[0, np.cumsum(each + STATISTICS)]
    index, value = np.empty(int(bounds[-1]), np.int64), np.ones(int(bounds[-1]), np.float32)
    tail = (bounds[1:, None] - STATISTICS + np.arange(STATISTICS)).ravel()
    index[tail] = (np.stack(bins, 1) + number).ravel()
    value[tail] = 0.5
    head = np.ones(len(index), bool)
    head[tail] = False
    index[head], value[head] = cells % BUCKETS, values
    return index, value, bounds


class FactorisationMachine:
    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    @classmethod
    def untrained(cls, seed: int = 11) -> "FactorisationMachine":
        r = np.random.default_rng(seed)
        return cls(0.0, np.zeros(SIZE, np.float32), r.normal(0, 0.02, (SIZE, RANK)).astype(np.float32))

    def margins(self, index: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Before the sigmoid; and per document the sums of v x."""
        at = bounds[:-1]
        scaled = self.factors[index] * value[:, None]
        sums = np.add.reduceat(scaled, at, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", scaled, scaled), at)
        linear = np.add.reduceat(self.weights[index] * value, at)
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums

    def score(self, index: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(index, value, bounds)[0].astype(float), -40, 40)))

    @classmethod
    def trained(cls, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.08, decay: float = 1e-5, batch: int = 64) -> "FactorisationMachine":
        """Logistic loss by AdaGrad over small batches, in an order fixed by a seed."""
        model = cls.untrained()
        share = np.clip(labels.mean(), 0.02, 0.98) if len(labels) else 0.5
        model.bias = float(np.log(share / (1 - share)))
        g_weights, g_factors, g_bias = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32), 1e-6
        r = np.random.default_rng(5)
        for _ in range(epochs if len(set(labels.tolist())) == 2 else 0):
            order = r.permutation(len(docs))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                index = np.concatenate([docs[i][0] for i in rows])
                value = np.concatenate([docs[i][1] for i in rows])
                bounds = np.r_[0, np.cumsum([len(docs[i][0]) for i in rows])]
                margin, sums = model.margins(index, value, bounds)
                error = ((1 / (1 + np.exp(-np.clip(margin, -40, 40)))) - labels[rows]).astype(np.float32) / len(rows)
                each = np.repeat(error, np.diff(bounds)) * value
                slope = each[:, None] * (np.repeat(sums, np.diff(bounds), axis=0) - model.factors[index] * value[:, None])
                forms, place = np.unique(index, return_inverse=True)
                d_weights = np.bincount(place, each, minlength=len(forms)).astype(np.float32) + decay * model.weights[forms]
                d_factors = np.stack([np.bincount(place, slope[:, f], minlength=len(forms)) for f in range(RANK)], 1).astype(np.float32) + decay * model.factors[forms]
                g_weights[forms] += d_weights**2
                g_factors[forms] += d_factors**2
                g_bias += float(error.sum()) ** 2
                model.weights[forms] -= rate * d_weights / np.sqrt(g_weights[forms])
                model.factors[forms] -= 0.3 * rate * d_factors / np.sqrt(g_factors[forms])
                model.bias -= rate * float(error.sum()) / np.sqrt(g_bias)
        return model


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _metadata(docs: DataFrame):
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return F.coalesce(docs["n_chars"].cast("long"), F.length(text)) if "n_chars" in docs.columns else F.length(text).cast("long")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """A model from at most ``sample`` labelled rows outside the held-out part."""
    common.ship(docs.sparkSession)
    wanted = (
        labels.where(labels["doc_id"].isNotNull() & labels["quality"].isNotNull() & ~_held_out(labels["doc_id"]))
        .groupBy(labels["doc_id"].cast("long").alias("id")).agg(F.min(labels["quality"].cast("int")).alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = batch.column("chars").to_numpy()
            for a, b, data, offsets in textkit.blocks(batch.column("text")):
                index, value, bounds = features(data, offsets, chars[a:b])
                pieces = [(index[x:y].astype("<i4").tobytes(), value[x:y].tobytes()) for x, y in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], batch.column("label")[a:b], pa.array([p[0] for p in pieces], pa.binary()), pa.array([p[1] for p in pieces], pa.binary())], ["id", "label", "i", "v"])

    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"), _metadata(docs).alias("chars"))
    # The sample is bounded by its parameter, so it may be broadcast. Of rows with one doc_id one is taken, before any reaches the driver.
    once = texts.join(F.broadcast(wanted), "id").groupBy("id", "label").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "chars")).alias("row"))
    rows = once.select("id", "label", "row.text", "row.chars").mapInArrow(work, "id long, label int, i binary, v binary").toArrow().to_pylist()
    rows = sorted(rows, key=lambda r: r["id"])
    return FactorisationMachine.trained([(np.frombuffer(r["i"], "<i4"), np.frombuffer(r["v"], np.float32)) for r in rows], np.array([r["label"] for r in rows], np.float32))


def score(docs: DataFrame, model: FactorisationMachine, name: str = "score") -> DataFrame:
    """All rows and columns of ``docs``, and the score of each, in a last column ``name``."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    text, chars = names.index("text"), len(names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_chars = batch.column(chars).to_numpy()
            found = np.zeros(batch.num_rows)
            for a, b, data, offsets in textkit.blocks(batch.column(text)):
                found[a:b] = shared.value.score(*features(data, offsets, n_chars[a:b]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:chars], pa.array(found)], [f"c{i}" for i in range(chars + 1)])
        textkit.give_back()

    plain = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], _metadata(docs).alias(f"c{chars}"))
    schema = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)] + [T.StructField(f"c{chars}", T.DoubleType())])
    return plain.mapInArrow(work, schema).toDF(*names, name)


def drop_rejected(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that score ``accept`` or more, all columns as they came."""
    name = "score_" + "_".join(docs.columns)
    return score(docs, train(docs, labels), name).where(F.col(name) >= accept).drop(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text", "n_chars"), train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
