import random

from pyspark.sql import functions as F

from quillstore.llm import pii

from . import brute

SCHEMA = "doc_id long, text string, kind string, base string, row int"


def _texts():
    r = random.Random(7)
    parts = ["a@b.c", "_d@e.f", "@", ".", "1", "23", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (743) 555-3824", "+", " ", "-", "--", "255", "300", "10.0.0.1", "é", "😀", "x", "(", ")", "\n", "00", "%", "5500000000000004"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(1500)] + [None, "", "9" * 50_000, "1 " * 5_000, "a" * 60_000, "4111111111111111 " * 300, "1." * 9_000 + "1", "+1" + "2" * 20_000]


def test_base_spans_are_those_of_the_patterns(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t, "k", "b", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute.pii(t)
        assert got[i].base_spans == brute.named(want, pii.KINDS), t
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        assert set(filter(None, got[i].base_spans.split(","))) <= set(got[i].spans.split(","))


def test_context_discovers_what_the_patterns_miss(spark):
    r = random.Random(3)
    seed = lambda: f"call phone: +1 (743) 555-{r.randint(1000, 9999)} today"
    mail = lambda: f"write mail: user{r.randint(100, 999)}@host{r.randint(10, 99)}.example.com now"
    rows = [(i, seed() if i % 2 else mail()) for i in range(80)]
    rows += [(100 + i, f"write mail: user{i + 100}@host55.example.com now") for i in range(3)] + [(200, "room 123456 is open"), (201, None), (None, "x")]
    # Neither has a form that a base pattern takes; their contexts are those of the seeds.
    rows += [(300, "write mail: user123@host12 now"), (301, "call phone: 743-555-3824 today"), (302, "read mail: user123@host12 later")]
    out = {x.doc_id: x for x in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[200].spans == "" and out[201].spans == "" and out[None].spans == ""
    assert out[100].n_email == 1
    assert out[300].spans == "email:12:26" and out[301].spans == "phone:12:24" and out[302].spans == ""


def test_context_discovers_in_texts_without_digits(spark):
    r = random.Random(4)
    rows = [(i, f"write mail: user{r.randint(100, 999)}@host{r.randint(10, 99)}.example.com now") for i in range(40)]
    rows += [(300, "write mail: alice@intranet now"), (301, "write mail: alice at intranet now")]
    out = {x.doc_id: x.spans for x in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[300] == "email:12:26" and out[301] == ""


def test_context_discovers_short_identifiers(spark):
    r = random.Random(6)
    rows = [(i, f"write mail: user{r.randint(100, 999)}@host{r.randint(10, 99)}.example.com now") for i in range(60)]
    rows += [(300, "write mail: a@b12 now"), (301, "write mail: 12345 now"), (302, "write mail: 1234 now"), (303, "write mail: 123 now"), (304, "read mail: a@b12 later")]
    out = {x.doc_id: x.spans for x in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i] for i in range(300, 305)] == ["email:12:17", "email:12:17", "email:12:16", "", ""]


def test_patterns_take_unseen_identifiers(spark):
    rows = [(i, f"the card: {n} was used") for i, n in enumerate(["4111111111111111", "5500000000000004", "4012888888881881", "5105105105105100", "378282246310005", "371449635398431", "6011111111111117", "3530111333300000", "4222222222222220"] * 2)]
    base = [x for x in rows if brute.pii(x[1])]
    rows.append((99, "the card: 4111111111111112 was used"))
    out = {x.doc_id: x.spans for x in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(base) >= 10
    assert out[99] == "card:10:26"


def test_patterns_with_few_seeds_carry_scores(spark):
    # Pattern 2 has 4 seeds, too few to be accepted, but lifts its 8 candidates that pattern 1 shares.
    kind, free = 0, len(pii.KINDS)
    links = [(1, f"s{i}", kind) for i in range(10)] + [(2, f"t{i}", kind) for i in range(4)] + [(3, f"u{i}", kind) for i in range(400)]
    links += [(p, f"c{i}", free) for p in (1, 2) for i in range(8)] + [(p, f"d{i}", free) for p in (2, 3) for i in range(20)]
    occurrences = spark.createDataFrame(links, "pattern long, instance string, no int")
    got = {r.pattern: (r.kind, round(r.score, 2)) for r in pii.accepted_patterns(occurrences).collect()}
    assert got.keys() == {1, 3} and got[1] == (0, 0.82)


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal_data(df).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("mail a@b.c").alias("text"))
    plan = pii.base_spans(df)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_time_grows_with_the_matches_of_a_text(spark):
    """Some 120 KB of addresses and candidates in one text, and twice that."""
    import time

    text = lambda n: " ".join(f"10.{i % 250}.{i // 250 % 250}.7 id{i:06d}" for i in range(n))
    took = []
    for n in (50, 6000, 12000):
        df = spark.createDataFrame([(1, text(n)), (2, None)], "doc_id long, text string")
        began = time.time()
        row = {x.doc_id: x for x in pii.find_personal_data(df).collect()}
        took.append(time.time() - began)
        assert row[1].n_ip == n and row[2].spans == ""
    # What any run takes, and twice the rest at most and a half for noise.
    assert took[2] - took[0] < 2.5 * max(took[1] - took[0], 1.0), took


def test_words_of_any_length_are_contexts(spark):
    """Long words before an identifier count whole."""
    long = "x" * 5000
    rows = [(i, f"{long} mail: user{i}@host{i}.example.com now") for i in range(60)] + [(300, f"{long} mail: a@b12 now"), (301, f"{long}y mail: a@b12 then")]
    out = {x.doc_id: x.spans for x in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[300] == "email:5007:5012"


def _plain_scores(links, rounds=pii.ROUNDS):
    """Pattern scores by kind: links of (pattern, instance, kind number), as the module's docstring says."""
    kinds = range(len(pii.KINDS))
    edges = {(p, i) for p, i, _ in links}
    seed = {(p, i): [max(float(k == n) for q, j, n in links if (q, j) == (p, i)) for k in kinds] for p, i in edges}
    scores = None
    for _ in range(rounds):
        now = {}
        for p in {p for p, _ in edges}:
            own = [i for q, i in edges if q == p]
            value = lambda i, k: seed[p, i][k] if scores is None or max(seed[p, i]) > 0 else max(scores[q][k] for q, j in edges if j == i)  # noqa: E731, B023
            now[p] = [sum(value(i, k) for i in own) / (len(own) + pii.SHRINK) for k in kinds]
        scores = now
    out = {}
    for p, s in scores.items():
        enough = [k for k in kinds if sum(seed[p, i][k] for q, i in edges if q == p) >= pii.SUPPORT]
        if enough and max(s[k] for k in enough) >= pii.ACCEPT:
            out[p] = max((s[k], k) for k in enough)
    return out


def test_scores_against_a_plain_version(spark):
    r = random.Random(8)
    links = sorted({(p, f"i{r.randrange(60)}" if r.random() < 0.3 else f"{p}-{r.randrange(25)}", r.choice((p % 4, p % 4, p % 4, p % 4, p % 4, len(pii.KINDS), (p + 1) % 4 if p > 9 else p % 4))) for p in range(14) for _ in range(60)})
    got = {x.pattern: (x.score, x.kind) for x in pii.accepted_patterns(spark.createDataFrame(links, "pattern long, instance string, no int")).collect()}
    want = _plain_scores(links)
    assert got.keys() == want.keys() and len(want) >= 3
    assert all(abs(got[p][0] - want[p][0]) < 1e-9 and got[p][1] == want[p][1] for p in want)
