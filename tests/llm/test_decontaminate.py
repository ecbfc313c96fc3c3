import random
import re

from pyspark.sql import functions as F

from quillstore.llm import decontaminate


def _shingles(text):
    w = [x for x in re.split(r"[^\w]|_", (text or "").lower()) if x]
    return {" ".join(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def test_contained_items(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice((3, 5, 6, 9, 20, 40, 70)))) for i in range(30)] + [(90, None), (91, ""), (92, "short one"), (7, "twice the same number of it all")]
    items.append((93, items[4][1]))
    docs = []
    for i in range(120):
        words = text(r.choice((4, 60, 300))).split(" ")
        for _ in range(r.choice((0, 1, 2))):
            own = (r.choice(items)[1] or "x").split(" ")
            for _ in range(r.choice((0, 1, 3))):
                own[r.randrange(len(own))] = "changed"
            at = r.randrange(len(words))
            words[at:at] = own
        docs.append((i, r.choice((" ", ", ", "!!\n")).join(words).upper() if i % 3 else " ".join(words)))
    docs += [(200, None), (201, ""), (202, "Short, one!"), (None, items[4][1]), docs[5], docs[5], (5, "other text of the same number"), (203, text(20_000) + " " + items[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("hash", "w", "item_id", "text_hash", "gone_id", "gone_hash", "n_held", "cutoff", "hits", "n", "id", "print")})
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("hash", "shingle", "doc_id")})
    by_item = {}
    for i, t in items:
        by_item.setdefault(i, set()).update(_shingles(t))
    want = {(i, t, item) for i, t in docs for item, s in by_item.items() if s and 100 * len(s & _shingles(t)) >= 80 * len(s)}
    got = decontaminate.contained(d, b).collect()
    assert len(got) == len(set(got)) == len(want)
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted(((i, item) for i, _, item in want), key=str)
    bad = {(i, t) for i, t, _ in want}
    left = decontaminate.drop_contaminated(d, b)
    assert left.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in left.select("doc_id", "text").collect()), key=str) == sorted((x for x in docs if x not in bad), key=str)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contained(d, b.limit(0)).count() == 0 and decontaminate.contained(d.limit(0), b).count() == 0
    assert decontaminate.drop_contaminated(d, b.limit(0)).count() == 1 and decontaminate.contained(d, b).count() == 1


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string").where("doc_id > 0")
    b = spark.range(1).select(F.col("id").alias("item_id"), F.lit("a b c d e f").alias("text"))
    plan = decontaminate.contained(d, b)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_boilerplate_makes_no_candidates(spark, monkeypatch):
    """A passage of every document that is a part of an item gives hits, but fewer than a candidate needs; cutoffs grow with the documents."""
    r = random.Random(3)
    own = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    passage = own(9)
    items = spark.createDataFrame([(i, f"{own(40)} {passage} {own(30)}") for i in range(20)] + [(90, own(9))], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{own(60)} {passage} {own(60)}") for i in range(300)], "doc_id long, text string")
    kept, written = {}, decontaminate.common.written
    monkeypatch.setattr(decontaminate.common, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    assert decontaminate.contained(docs, items).count() == 0
    assert kept["candidates"].count() <= 10
    cutoffs = [x.cutoff for x in decontaminate._cutoffs(kept["sketches"]).orderBy("size_partition").collect()]
    assert cutoffs == sorted(cutoffs) and 0 < len(cutoffs) < 64
