import base64
import random

import pytest
from pyspark.sql import functions as F

from quillstore.llm import secrets

from . import brute


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("letters", "base", "candidates", "judged")})


def test_base_spans(spark):
    r = random.Random(6)
    parts = ["password", "PASSWD", "Secret", "toKen", "api_key", "APIKEY", "ſecret", "toKen", "=", ":", " ", "\"", "'", "abcd1234", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "😀", "\n", "F" * 9, "/+.=-_", "x"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    texts += [None, "", "a" * 100_000, "token=" * 5000, "AKIA" * 5000, "token " + " " * 50_000 + "= abcdefgh", "x " * 40_000 + "secret: " + "Z9" * 30]
    rows = [*enumerate(texts), (None, "secret: hunter22"), (3, "token=12345678"), (3, "token=12345678")]
    got = sorted(((x.doc_id, x.base_spans, x.n_assign, x.n_access, x.n_hex) for x in secrets.find_secrets(frame(spark, rows)).collect()), key=str)
    want = []
    for i, t in rows:
        spans = brute.secrets(t)
        want.append((i, brute.named(spans, secrets.KINDS), *[sum(s[0] == k for s in spans) for k in secrets.KINDS[:3]]))
    assert got == sorted(want, key=str)


def test_random_strings_are_found_and_text_is_left_alone(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice(("the", "ing", "er", "on", "tion", "an", "re")) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(60))
    keys = {i: base64.b64encode(r.randbytes(36)).decode() for i in range(40)}
    keys |= {i: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(52)) for i in range(40, 60)}
    rows = [(i, f"é {prose()} {k} {prose()}") for i, k in keys.items()]
    rows += [(100 + i, f"{prose()} {'-'.join(word() for _ in range(8))}-2024 {prose()} aaaaaaaaaaaaaaaaaaaaaa1 chapter_one_of_the_long_story_2 {prose()}") for i in range(60)]
    out = {x.doc_id: x.spans for x in secrets.find_secrets(frame(spark, rows)).collect()}
    found = sum(out[i] == f"random:{rows[i][1].index(k)}:{rows[i][1].index(k) + len(k)}" for i, k in keys.items())
    assert found >= 0.9 * len(keys)
    assert sum(bool(out[100 + i]) for i in range(60)) <= 3


def test_keys_in_runs_that_fit_no_encoding(spark):
    r = random.Random(8)
    key = lambda more="": "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + more) for _ in range(40))
    prose = " ".join(["it was the order in the tale that went on and on"] * 20)
    plain, url, standard = [key() for _ in range(20)], [key("-_-_-_") for _ in range(20)], [key("+/+/+/") for _ in range(20)]
    rows = [(i, f"é {prose} https://host/my_app/{k} {prose}", k) for i, k in enumerate(plain)]
    rows += [(20 + i, f"{prose} https://host/{k}/of+it {prose}", k) for i, k in enumerate(url)]
    rows += [(40 + i, f"{prose} the_{k}-it {prose}", k) for i, k in enumerate(standard)]
    rows += [(60, "https://host/my_app/one-of-the-long-stories-of-the/year-2024-and-the-next", "?")]
    out = {x.doc_id: x.spans for x in secrets.find_secrets(frame(spark, [x[:2] for x in rows])).collect()}
    assert out[60] == ""
    for kind in (rows[:20], rows[20:40], rows[40:60]):
        assert sum(f"random:{t.index(k)}:{t.index(k) + 40}" in out[i].split(",") for i, t, k in kind) >= 17


def test_parts_of_runs():
    a, b = "a1" * 10, "B2" * 10
    cut = lambda run: [run[x:y] for x, y in secrets.testable(run)]
    assert cut(f"{a}/{b}") == [f"{a}/{b}"] and cut(f"x_/{a}") == [a, "/" + a][::-1]
    assert set(cut(f"{a}/{b}-c")) == {a, f"{b}-c", f"{a}/{b}"} and cut("ab/cd-" * 9) == [] and cut("a1/b2-" * 9) == []


def test_the_battery():
    r = random.Random(1)
    hexes = "0123456789abcdef"
    even = [secrets.randomness("".join(r.choice(hexes) for _ in range(64)), hexes) for _ in range(300)]
    assert sum(p < 0.05 for p in even) < 40
    assert secrets.randomness("0123456789abcdef" * 4, hexes) < 0.01 and secrets.randomness("a1" * 32, hexes) < 1e-6
    assert secrets.infer_encoding("deadbeef1")[0] == "hex" and secrets.infer_encoding("ABCZ77")[0] == "base32" and secrets.infer_encoding("letters") is None


@pytest.mark.parametrize(("histogram", "least"), [({}, float("inf")), ({(0, 0): 100}, float("inf")), ({(0, 60): 3, (0, 0): 97}, 3.6)])
def test_step_up(histogram, least):
    assert secrets.thresholds(histogram)[0] == pytest.approx(least)


def test_an_empty_table(spark):
    assert secrets.find_secrets(frame(spark, [])).count() == 0


def _prose(r):
    syllables = ("the", "ing", "er", "on", "tion", "an", "re", "st", "mo", "la", "ci", "pe", "du", "gri", "sho")
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    return word, lambda n: " ".join(str(r.randint(1, 10**6)) if r.random() < 0.04 else word().capitalize() if r.random() < 0.1 else word() for _ in range(n))


def test_recall_and_false_discoveries(spark):
    """Random hex, base36 and base64 of 20 to 128 characters among names and paths of words and numbers."""
    r = random.Random(17)
    word, prose = _prose(r)
    alphabets = {"hex": "0123456789abcdef", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    rows, planted = [], {}
    for kind, symbols in alphabets.items():
        for n in (20, 24, 31, 32, 48, 64, 100, 128):
            for _ in range(20):
                # Hex keys of 32 and more are base spans; capitals make them candidates.
                key = "".join(r.choice(symbols.upper() if kind == "hex" and n > 31 else symbols) for _ in range(n))
                planted[len(rows)] = (kind, key, f"random:{(head := prose(30)).__len__() + 1}:{len(head) + 1 + n}")
                rows.append((len(rows), f"{head} {key} {prose(30)}"))
    shapes = (
        lambda: "_".join(word() for _ in range(6)) + f"_{r.randint(1, 2024)}", lambda: "-".join(word() for _ in range(5)) + f"-v{r.randint(1, 9)}",
        lambda: "/".join([word(), "items", word(), word(), str(r.randint(1, 9999)), word()]), lambda: "".join(word().capitalize() for _ in range(6)) + str(r.randint(0, 99)),
    )
    for _ in range(600):
        rows.append((len(rows), f"{prose(30)} {r.choice(shapes)()} {prose(20)} {r.choice(shapes)()}"))
    out = {x.doc_id: set(filter(None, x.spans.split(","))) for x in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in alphabets:
        own = [out[i] >= {span} for i, (k, key, span) in planted.items() if k == kind and secrets.infer_encoding(key)]
        assert sum(own) >= 0.9 * len(own), (kind, sum(own), len(own))
    found = sum(len(v) for v in out.values())
    false = found - sum(span in out[i] for i, (_, _, span) in planted.items())
    assert false <= secrets.RATE * found, (false, found)


def _plain_statistics(value, symbols):
    """The battery's three statistics, one string at a time."""
    n, k, x = len(value), len(symbols), [symbols.index(c) for c in value]
    chi = sum((x.count(s) - n / k) ** 2 * k / n for s in range(k))
    high = [s >= k / 2 for s in x]
    ups, turns = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 1 + 2 * ups * (n - ups) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    mid = [s - (k - 1) / 2 for s in x]
    return [((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / (2 / (9 * (k - 1))) ** 0.5, abs(turns - mean) / var**0.5 if var > 0 else n**0.5, abs(sum(a * b for a, b in zip(mid, mid[1:]))) / sum(a * a for a in mid) * n**0.5]


def test_the_battery_against_a_plain_version():
    import numpy as np

    r = random.Random(5)
    for symbols in ("0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz"):
        values = ["".join(r.choice(symbols) for _ in range(33)) for _ in range(50)] + ["a1" * 10, "0" * 20 + "a", "f" * 30]
        for v in values:
            assert secrets.statistics(secrets.numbered(v, symbols), len(symbols))[0] == pytest.approx(_plain_statistics(v, symbols))
        assert np.allclose(secrets.statistics(np.concatenate([secrets.numbered(v, symbols) for v in values[:50]]), len(symbols)), [_plain_statistics(v, symbols) for v in values[:50]])


def test_p_values_under_the_text_hypothesis():
    """Fresh strings of text's own transitions reach a p-value about as often as it says, and random ones reach far smaller ones."""
    import numpy as np

    r = random.Random(3)
    text = _prose(r)[1](40_000)
    pairs = np.zeros((len(secrets.SYMBOLS),) * 2, int)
    for a, b in zip(text, text[1:]):
        if a in secrets.SYMBOLS and b in secrets.SYMBOLS:
            pairs[secrets.SYMBOLS.index(a), secrets.SYMBOLS.index(b)] += 1
    hypothesis, g = secrets.TextHypothesis(pairs), np.random.default_rng(77)
    for name, symbols, _ in secrets._ENCODINGS:
        for n in (20, 150):
            written = lambda rows: np.array([hypothesis.evidence("".join(symbols[i] for i in x), name, symbols) for x in rows])
            p = written(secrets.TextHypothesis.drawn(pairs, symbols, 800, n, g)[n])
            assert (p >= 1).mean() < 0.15 and (p >= 2).mean() < 0.025 and (p >= 3).mean() < 0.008, (name, n)
            if name in ("base36", "base62", "base64", "base64url"):
                assert np.quantile(written(g.integers(0, len(symbols), (300, n))), 0.1) > 2, (name, n)


def test_step_up_against_sorting():
    """Benjamini and Hochberg on sorted p-values accept what the histogram does, p-values being rounded up to a tenth of a decade."""
    r = random.Random(9)
    for _ in range(30):
        bins = [min(secrets.BINS - 1, int(r.expovariate(1 / r.choice((4, 30, 90))))) for _ in range(r.randint(1, 300))]
        ps = sorted(10 ** (-b / 10) for b in bins)
        k = max((i for i, p in enumerate(ps, 1) if p <= 0.01 * i / len(ps)), default=0)
        least = secrets.thresholds({(0, b): bins.count(b) for b in set(bins)}, 0.01)[0]
        assert sum(b / 10 >= least for b in bins) == k
