"""Secret scan: base patterns, and a battery of randomness tests over other strings.

Base kinds are assign, access and hex. Candidates for the battery are the maximal runs of
``A-Za-z0-9+/_-`` of at least ``LEAST`` characters that mix letters and digits and overlap no
base span. A run that fits no encoding, since it mixes + or / with - or _, is replaced by its
maximal parts without + and / and those without - and _, under the same rules. For each candidate
the narrowest encoding that holds it is inferred (hex, base32, base36, base62, base64, base64url), its characters become symbol
numbers, and three tests measure how unevenly they are drawn: chi-squared over the alphabet, runs about the alphabet's middle,
and serial correlation at lag one.

Each statistic is calibrated under the text hypothesis: that the string is one of the table's own kind of text. Which
symbol follows which is counted over all texts of the table, whole (but in runs long enough to be candidates), and where one case
is seldom seen, it is taken to follow the other's habits. Strings drawn from these transitions inside each alphabet, words joined
(in half of the strings with capitals) before or after text that begins with a digit, since candidates have both, give the statistics' means and covariance
at ``LENGTHS`` (between them evidence is interpolated), and even draws give those of randomness. Runs and serial
correlation are taken twice: in the alphabet's own order, with runs of letters and of the rest, which sees text keep to one of them, and
in the order of the symbols' frequency in text, which sees it keep to the frequent ones; chi-squared is taken over single symbols
and over letters against the rest. All combine to one score, the log ratio of the two normal densities. Its p-value under the
text hypothesis is that of the drawn strings down to one in a hundred, and falls on at the same rate beyond (slower than a
normal tail): the longer a string, the smaller it gets for a random one. The procedure of
Benjamini and Hochberg on these p-values holds the false-discovery rate at ``RATE`` in each band of lengths, over all
candidates of the table: they are counted in histograms of fixed size, so the driver sees a few hundred numbers
at any scale. A string that the same tests find no even draw either (Fisher's combination under ``LEVEL``, too even
included) counts with a p-value of 1. Parts of a run may overlap; each counts as a test, and each that is accepted is a span of its own.

Limits: secrets of fewer than ``LEAST`` characters, or without a letter or a digit, are never judged (of random base64 of 20
characters some 3 percent have no digit, of hex none to speak of). Where texts are as random as secrets, nothing is found.

Null texts count as empty. Rows come back as they came in, with null or repeated doc_ids. Extra
columns are ignored; an empty table gives an empty result. Very long texts are scanned whole.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textkit

KINDS = ("assign", "access", "hex", "random")
LEAST = 20
LEVEL = 0.001
#: Lengths at which the tests are calibrated, and strings drawn for it in each encoding. Longer strings count as the last.
LENGTHS = (20, 22, 24, 28, 32, 40, 50, 64, 80, 100, 128, 160, 200, 256)
DRAWN = 4000
#: How often a word ends where words are joined: short words, so that joined ones in capitals look as random as they do anywhere.
JOINED = 0.25
RATE = 0.01
#: Lengths from which the bands of the false-discovery control begin.
BANDS = (20, 28, 40, 64, 128)
#: Histogram bins of -log10(p), a tenth wide.
BINS = 400

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_BYTES = np.isin(np.arange(256), list(b"0123456789abcdef"))
_RUN_BYTES = np.isin(np.arange(256), list((string.ascii_letters + string.digits + "+/_-").encode()))
#: What candidates are made of, in the order of the counted pairs.
SYMBOLS = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/-_"
_FOLDED = np.unique([c.lower() for c in SYMBOLS], return_inverse=True)[1]
_PLACES = np.full(256, -1, np.int16)
_PLACES[list(SYMBOLS.encode())] = np.arange(len(SYMBOLS))
_ENCODINGS = tuple(
    (name, symbols, frozenset(symbols))
    for name, symbols in (
        ("hex", "0123456789abcdef"), ("hex_upper", "0123456789ABCDEF"), ("base32", string.ascii_uppercase + "234567"), ("base36", string.digits + string.ascii_lowercase),
        ("base36_upper", string.digits + string.ascii_uppercase), ("base62", string.digits + string.ascii_letters),
        ("base64", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"), ("base64url", string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_"),
    )
)


def base_spans(text: str, raw: bytes) -> list[tuple[str, int, int]]:
    """Base spans, in code points. ``raw`` is the text in UTF-8."""
    found = []
    lower = raw.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def _long_runs(data: np.ndarray, allowed: np.ndarray, least: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of runs of allowed bytes of at least ``least``, inside documents."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = allowed[data]
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    if len(offsets) > 2 and len(starts):
        cuts = offsets[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        starts, ends = np.sort(np.r_[starts, cuts]), np.sort(np.r_[ends, cuts])
    long = ends - starts >= least
    return starts[long], ends[long]


def infer_encoding(value: str) -> tuple[str, str] | None:
    """Name and symbols of the narrowest encoding; none if the string has no letter or no digit."""
    held = set(value)
    if not held & set(string.digits) or not held & set(string.ascii_letters):
        return None
    return next(((name, symbols) for name, symbols, all_of in _ENCODINGS if held <= all_of), None)


_PARTS = tuple(re.compile(rf"[A-Za-z0-9{more}]{{{LEAST},}}") for more in ("_-", "+/"))


def testable(run: str) -> list[tuple[int, int]]:
    """Bounds of what is tested of a run: all of it if an encoding holds it, else its long parts that one holds."""
    if infer_encoding(run):
        return [(0, len(run))]
    return sorted({m.span() for part in _PARTS for m in part.finditer(run) if infer_encoding(m[0])})


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_score(x, k: float):
    """Chi-squared as a standard normal, by the cube root."""
    return ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))


def numbered(value: str, symbols: str) -> np.ndarray:
    place = {c: i for i, c in enumerate(symbols)}
    return np.array([[place[c] for c in value]])


def statistics(x: np.ndarray, size: int, upper: np.ndarray | None = None) -> np.ndarray:
    """The battery over each row of symbol numbers: normal scores of chi-squared, and the size of those of runs and serial correlation.

    Runs are those of symbols above and below the alphabet's middle, or of ``upper`` ones and the rest.
    """
    rows, n = x.shape
    counts = np.bincount((np.arange(rows)[:, None] * size + x).ravel(), minlength=rows * size).reshape(rows, size)
    chi = ((counts - n / size) ** 2).sum(1) * size / n
    high = x >= size / 2 if upper is None else upper[x]
    ups = high.sum(1)
    mean = 1 + 2 * ups * (n - ups) / n
    var = np.maximum((mean - 1) * (mean - 2) / (n - 1), 0)
    turns = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    # All on one side: as odd as a test of n coins can be.
    runs = np.where(var > 0, np.abs(turns - mean) / np.sqrt(np.where(var > 0, var, 1)), math.sqrt(n))
    centred = x - (size - 1) / 2
    serial = np.abs((centred[:, 1:] * centred[:, :-1]).sum(1)) / (centred**2).sum(1) * math.sqrt(n)
    return np.stack([_chi_score(chi, size - 1), runs, serial], 1)


def randomness(value: str, symbols: str) -> float:
    """Combined p-value of the battery under even draws from ``symbols``, by Fisher's method; chi-squared counts both ways."""
    ps = [_normal_tail(z) for z in statistics(numbered(value, symbols), len(symbols))[0].tolist()]
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(len(ps)))


class TextHypothesis:
    """The battery's distribution over strings that follow one another as the symbols of the table's texts do."""

    def __init__(self, pairs: np.ndarray, seed: int = 7):
        """``pairs``: how often each symbol follows each, in the order of ``SYMBOLS``."""
        self.letters = {name: np.array([c in string.ascii_letters for c in symbols]) for name, symbols, _ in _ENCODINGS}
        self.ranks: dict[str, np.ndarray] = {}
        self.table: dict[str, list] = {}
        for name, symbols, _ in _ENCODINGS:
            r, size = np.random.default_rng(seed), len(symbols)
            self.ranks[name] = np.argsort(np.argsort(-self.follows(pairs, symbols)[0], kind="stable"))
            text, even = self.drawn(pairs, symbols, DRAWN, LENGTHS[-1], r), r.integers(0, size, (DRAWN, LENGTHS[-1]))
            self.table[name] = []
            for n in LENGTHS:
                own, random = self.measured(text[n], name), self.measured(even[:, :n], name)
                shapes = [(x.mean(0), np.linalg.inv(np.cov(x.T) + 1e-3 * np.eye(x.shape[1]))) for x in (own, random)]
                tenth, hundredth = np.quantile(self.score(own, shapes), (0.9, 0.99))
                self.table[name].append((shapes, tenth, max(hundredth - tenth, 1e-9)))

    @staticmethod
    def score(x: np.ndarray, shapes) -> np.ndarray:
        """How much farther each row is from text than from randomness."""
        text, even = (np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean) for mean, inverse in shapes)
        return text - even

    def measured(self, x: np.ndarray, name: str) -> np.ndarray:
        """Chi-squared, runs and serial correlation in two orders, and the letters' share."""
        size, letters = len(self.ranks[name]), self.letters[name]
        n, share = x.shape[1], letters.mean()
        # Chi-squared over two cells, as a score: a run of digits with one letter has no runs to speak of.
        balance = np.abs(letters[x].sum(1) - n * share) / math.sqrt(n * share * (1 - share))
        return np.concatenate([statistics(x, size, letters), statistics(self.ranks[name][x], size)[:, 1:], balance[:, None]], 1)

    @staticmethod
    def follows(pairs: np.ndarray, symbols: str) -> tuple[np.ndarray, np.ndarray]:
        """How often text has each symbol, and how often each follows each. What is rare leans on both cases together, and that on all symbols."""
        at, size = [SYMBOLS.index(c) for c in symbols], len(symbols)
        kind = _FOLDED[at]
        both = np.zeros((_FOLDED.max() + 1,) * 2)
        np.add.at(both, (_FOLDED[:, None], _FOLDED[None, :]), pairs)
        split = 1 / np.bincount(kind)[kind]
        often = (both.sum(0) + both.sum(1) + 1)[kind] * split
        often /= often.sum()
        leaning = both[np.ix_(kind, kind)] * split
        leaning = (leaning + size * often) / (leaning.sum(1, keepdims=True) + size)
        own = pairs[np.ix_(at, at)].astype(float)
        seen = own.sum(0) + own.sum(1) + size * often
        return seen / seen.sum(), (own + size * leaning) / (own.sum(1, keepdims=True) + size)

    @classmethod
    def drawn(cls, pairs: np.ndarray, symbols: str, rows: int, longest: int, r: np.random.Generator) -> dict[int, np.ndarray]:
        """Strings as symbol numbers, for each of ``LENGTHS`` up to ``longest`` and that: joined words, cut anywhere, and text from a digit on, or the other way round."""
        often, steps = cls.follows(pairs, symbols)
        steps = np.cumsum(steps, 1)
        letters, capitals, digits = (often * [c in kind for c in symbols] for kind in (string.ascii_letters, string.ascii_uppercase, string.digits))
        begun = lambda weights: np.searchsorted(c := np.cumsum(weights), r.random(rows) * c[-1] * (1 - 1e-9), side="right")
        joined = r.random(rows) < 0.5 if capitals.any() else np.zeros(rows, bool)
        pieces = [np.empty((rows, longest), np.int64) for _ in range(2)]
        for piece, first in zip(pieces, (letters, digits)):
            piece[:, 0] = begun(first)
            for i in range(1, longest):
                step = np.minimum((steps[piece[:, i - 1]] < r.random((rows, 1)) * (1 - 1e-9)).sum(1), len(symbols) - 1)
                again = r.random(rows) < JOINED if first is letters else np.zeros(rows, bool)
                piece[:, i] = np.where(again, np.where(joined, begun(capitals if capitals.any() else letters), begun(letters)), step)
        turn, place = r.random((rows, 1)) < 0.5, r.random((rows, 1))
        head, tail = np.where(turn, pieces[0], pieces[1]), np.where(turn, pieces[1], pieces[0])
        out = {}
        for n in {*(x for x in LENGTHS if x < longest), longest}:
            cut, at = 1 + (place * (n - 1)).astype(np.int64), np.arange(n)
            out[n] = np.where(at < cut, head[:, :n], np.take_along_axis(tail, np.maximum(at - cut, 0), 1))
        return out

    def evidence(self, value: str, name: str, symbols: str) -> float:
        """-log10 of the p-value under the text hypothesis."""
        own, n = self.measured(numbered(value, symbols), name), min(len(value), LENGTHS[-1])
        above = max(1, int(np.searchsorted(LENGTHS, n)))
        at = math.log(n / LENGTHS[above - 1]) / math.log(LENGTHS[above] / LENGTHS[above - 1])
        low, high = (1 + (float(self.score(own, shapes)[0]) - tenth) / gap for shapes, tenth, gap in self.table[name][above - 1 : above + 1])
        return max(0.0, low + at * (high - low))


def _band(n: int) -> int:
    return max(i for i, least in enumerate(BANDS) if n >= least)


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base spans and candidates; and a row for each task with its counts of pairs of symbols. Not written yet."""
    common.ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(len(SYMBOLS) ** 2, np.int64)
        for batch in batches:
            text = textkit.text_column(batch.column("text"))
            base: list = [[] for _ in range(len(text))]
            candidates: list = [[] for _ in range(len(text))]
            for a, b, data, offsets in textkit.blocks(text):
                raw = data.tobytes()
                hexes = _long_runs(data, _HEX_BYTES, 32, offsets)[0]
                starts, ends = _long_runs(data, _RUN_BYTES, LEAST, offsets)
                place = _PLACES[data]
                follows = (place[:-1] >= 0) & (place[1:] >= 0)
                inner = offsets[1:-1]
                follows[inner[(inner > 0) & (inner < len(data))] - 1] = False
                for s, e in zip(starts.tolist(), ends.tolist()):
                    follows[s : e - 1] = False
                pairs += np.bincount(place[:-1][follows].astype(np.int64) * len(SYMBOLS) + place[1:][follows], minlength=len(pairs))
                hex_docs = set((np.searchsorted(offsets, hexes, side="right") - 1).tolist())
                run_docs: dict[int, list[tuple[int, int]]] = {}
                for d, s, e in zip((np.searchsorted(offsets, starts, side="right") - 1).tolist(), starts.tolist(), ends.tolist()):
                    run_docs.setdefault(d, []).append((s, e))
                lower = raw.lower()
                key_docs: set[int] = set()
                for key in _KEYWORDS:
                    at = lower.find(key)
                    while at >= 0:
                        d = int(np.searchsorted(offsets, at, side="right")) - 1
                        key_docs.add(d)
                        at = lower.find(key, int(offsets[d + 1]) - len(key) + 1 if offsets[d + 1] - len(key) + 1 > at else at + 1)
                at = raw.find(b"AKIA")
                while at >= 0:
                    key_docs.add(int(np.searchsorted(offsets, at, side="right")) - 1)
                    at = raw.find(b"AKIA", at + 1)
                for d in hex_docs | key_docs | run_docs.keys():
                    own = raw[offsets[d] : offsets[d + 1]]
                    found = base_spans(own.decode("utf-8", "replace"), own)
                    base[a + d] = [{"kind": k, "start": s, "end": e} for k, s, e in found]
                    seen, at = 0, 0
                    for s, e in run_docs.get(d, ()):
                        s, e = s - int(offsets[d]), e - int(offsets[d])
                        seen, at = seen + len(own[at:s].decode("utf-8", "replace")), s
                        value = own[s:e].decode("ascii")
                        for begin, end in testable(value):
                            if not any(x < seen + end and seen + begin < y for _, x, y in found):
                                candidates[a + d].append({"start": seen + begin, "end": seen + end, "value": value[begin:end]})
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(text), pa.list_(pa.int64())), batch.column("doc_id"), pa.array(base, _BASE), pa.array(candidates, _CANDIDATES)], ["pairs", "doc_id", "base", "candidates"])
        yield pa.RecordBatch.from_arrays([pa.array([pairs.tolist()], pa.list_(pa.int64())), pa.array([None], pa.int64()), pa.array([None], _BASE), pa.array([None], _CANDIDATES)], ["pairs", "doc_id", "base", "candidates"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(
        work, "pairs array<bigint>, doc_id long, base array<struct<kind:string,start:int,end:int>>, candidates array<struct<start:int,end:int,value:string>>"
    )


_BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_CANDIDATES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def thresholds(histogram: dict[tuple[int, int], int], rate: float = RATE) -> dict[int, float]:
    """For each band the least -log10(p) that Benjamini and Hochberg's step-up accepts; infinity for none."""
    out = {}
    for band in range(len(BANDS)):
        counts = [histogram.get((band, b), 0) for b in range(BINS)]
        total, above, least = sum(counts), 0, math.inf
        for b in range(BINS - 1, -1, -1):
            above += counts[b]
            # The largest p of the bin stands for all of it.
            if above and 10 ** (-b / 10) <= rate * above / total:
                least = b / 10
        out[band] = least
    return out


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_spans and spans as text."""
    spark = docs.sparkSession
    rows = common.written(scan(docs), "secrets")
    # One number for each pair of symbols.
    counted = rows.select(F.posexplode("pairs").alias("pair", "n")).groupBy("pair").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros(len(SYMBOLS) ** 2, np.int64)
    pairs[[r["pair"] for r in counted]] = [r["n"] for r in counted]
    shared = spark.sparkContext.broadcast(TextHypothesis(pairs.reshape(len(SYMBOLS), -1)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for candidates in batch.column("candidates").to_pylist():
                mine = []
                for c in candidates or ():
                    name, symbols = infer_encoding(c["value"])
                    even = randomness(c["value"], symbols) >= LEVEL
                    bin_ = min(BINS - 1, int(10 * shared.value.evidence(c["value"], name, symbols))) if even else 0
                    mine.append({"start": c["start"], "end": c["end"], "band": _band(len(c["value"])), "bin": bin_})
                out.append(mine)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("base"), pa.array(out, _JUDGED)], ["doc_id", "base", "judged"])

    judged = common.written(
        rows.where("pairs IS NULL").select("doc_id", "base", "candidates").mapInArrow(judge, "doc_id long, base array<struct<kind:string,start:int,end:int>>, judged array<struct<start:int,end:int,band:int,bin:int>>"), "judged"
    )
    histogram = {(r["band"], r["bin"]): r["n"] for r in judged.select(F.explode("judged").alias("j")).groupBy("j.band", "j.bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = thresholds(histogram, rate)
    bars = F.array(*[F.lit(float("inf") if math.isinf(least[b]) else least[b] * 10) for b in range(len(BANDS))])
    numbers = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    base = F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), numbers[s["kind"]].alias("no"), s["end"].alias("end"))))
    # Bins hold whole tenths, so the bars are compared in tenths, rounded.
    added = F.transform(F.filter("judged", lambda j: (j["bin"] > 0) & (j["bin"] >= F.round(F.get(bars, j["band"])))), lambda j: F.struct(j["start"].alias("start"), F.lit(KINDS.index("random")).alias("no"), j["end"].alias("end")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return judged.select("doc_id", *[count(k) for k in KINDS[:3]], _named(base).alias("base_spans"), _named(F.array_sort(F.concat(base, added))).alias("spans"))


_JUDGED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("band", pa.int32()), ("bin", pa.int32())]))


def _named(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op2's result, what SQL can say too: all but the spans that the method adds."""
    return op2_secret_scan(spark, sf_dir).drop("spans")


BASE_ORACLE = r"""
WITH k(kind, no, p) AS (VALUES
  ('assign', 0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]+')),
t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, kind, no, regexp_extract_all(text, p) AS m, string_split_regex(text, p) AS g FROM t, k),
i AS (SELECT doc_id, kind, no, m, g, unnest(range(1, len(m) + 1)) AS i FROM m),
s AS (SELECT doc_id, kind, no, m[i] AS v, (list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM i),
b AS (SELECT * FROM s WHERE CASE kind WHEN 'hex' THEN length(v) >= 32 WHEN 'access' THEN length(v) >= 16
  ELSE length(regexp_extract(v, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8 END)
SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || (start + length(v)), ',' ORDER BY start, no), '')) AS base_sha256
FROM t LEFT JOIN b ON b.doc_id = t.doc_id GROUP BY t.doc_id
"""
