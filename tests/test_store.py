import random

import pytest

from quillstore.functions import jsontext as J
from quillstore.operators.listing import InvalidRequest
from quillstore.sources.mutation_log import StoreInUse
from quillstore.store import Store

TEXTS = "collection string, pos long, id string, text string"


@pytest.fixture
def store(spark, tmp_path):
    with Store(spark, str(tmp_path / "store")) as s:
        yield s


def test_survives_reopening_and_counts_empty_collections(spark, tmp_path):
    root = str(tmp_path / "store")
    with Store(spark, root) as s:
        s.put("007", "a", '{"v": 1}')
        s.put("007", "a", '{"v":2}')
        s.put("gone", "x", "{}")
        assert s.delete("gone", "x") and not s.delete("gone", "x") and not s.delete("never", "x")
        with pytest.raises(StoreInUse):
            Store(spark, root)
        assert s.collections() == [("007", 1), ("gone", 0)]
    with Store(spark, root) as s:
        assert s.get("007", "a") == '{"v":2}' and s.get("gone", "x") is None and s.get("bad name!", "x") is None
        s.compact()
        assert s.collections() == [("007", 1), ("gone", 0)]
        s.put("007", "b", "{}")
        assert [i for i, _ in s.list("007")[0]] == ["a", "b"]


def test_filters_and_pages(spark, store):
    rows = [("c", 0, f"k{i}", '{"topic":"%s","n":%d,"meta":{"ok":%s}}' % ("even" if i % 2 == 0 else "odd", i, "true" if i == 3 else "false")) for i in range(7)]
    assert store.put_all(spark.createDataFrame(rows, TEXTS)).count() == 0
    ids = lambda page: ([i for i, _ in page[0]], page[1])
    assert ids(store.list("c", [("topic", "even")])) == (["k0", "k2", "k4", "k6"], None)
    assert ids(store.list("c", [("n", "3"), ("meta.ok", "true")])) == (["k3"], None)
    assert ids(store.list("c", [("n", "3"), ("n", "4")])) == ([], None)
    assert ids(store.list("c", limit=3)) == (["k0", "k1", "k2"], "k2")
    assert ids(store.list("c", limit=7)) == ([f"k{i}" for i in range(7)], None)
    assert ids(store.list("c", after="k4x")) == (["k5", "k6"], None)
    assert ids(store.list("c", [("topic", "odd")], after="k1", limit=1)) == (["k3"], "k3")
    assert ids(store.list("absent")) == ([], None)
    for limit in (0, 1001):
        with pytest.raises(InvalidRequest):
            store.list("c", limit=limit)
    with pytest.raises(InvalidRequest):
        store.list("no good")
    pages = {r["id"]: r["page"] for r in store.all_pages("c", 3).collect()}
    assert pages == {f"k{i}": i // 3 for i in range(7)}
    found = {r["id"]: r["doc"] for r in store.get_many("c", spark.createDataFrame([("k1",), ("nope",)], "id string")).collect()}
    assert found["nope"] is None and J.parse(found["k1"]).get("n") == "1"


def test_refused_rows_come_back(spark, store):
    rows = [("c", "ok", "{}"), ("c", "", "{}"), ("c", "x" * 257, "{}"), ("c", "é" * 128, "{}"), ("c", "a\u0085", "{}"), ("c", "sp ace/1", "{}"), ("bad\n", "i", "{}"), ("c", "n", "[1]"), ("c", "m", "{"), ("c", "z", None), ("x" * 65, "i", "{}"), (None, "i", "{}")]
    bad = store.put_all(spark.createDataFrame(rows, "collection string, id string, text string")).collect()
    assert len(bad) == 9
    assert sorted(i for i, _ in store.list("c")[0]) == sorted(["ok", "é" * 128, "sp ace/1"])
    with pytest.raises(InvalidRequest):
        store.put_all(spark.createDataFrame([("c", "i", "{}")] * 2, "collection string, id string, text string"))


def test_long_values_are_matched_in_the_document(store):
    long = "x" * 20_000
    store.put("c", "a", '{"v":"%s"}' % long)
    store.put("c", "b", '{"v":"short"}')
    assert [i for i, _ in store.list("c", [("v", long)])[0]] == ["a"]


def test_against_a_model(spark, store):
    r = random.Random(1)
    model: dict[str, dict[str, str]] = {}
    for _ in range(4):
        rows = [(r.choice(["p", "q-1"]), n, f"id{r.randint(0, 12)}", '{"n":%d,"s":{"t":"%s"}}' % (r.randint(0, 3), r.choice("ab"))) for n in range(25)]
        for c, _, i, t in rows:
            model.setdefault(c, {})[i] = t
        store.put_all(spark.createDataFrame(rows, TEXTS))
        gone = {(r.choice(["p", "q-1", "none"]), f"id{r.randint(0, 15)}") for _ in range(6)}
        flags = {(x["collection"], x["id"]): x["deleted"] for x in store.delete_all(spark.createDataFrame(list(gone), "collection string, id string")).collect()}
        assert flags == {(c, i): i in model.get(c, {}) for c, i in gone}
        for c, i in gone:
            model.get(c, {}).pop(i, None)
    assert store.collections() == sorted((c, len(d)) for c, d in model.items())
    for c, docs in model.items():
        want = sorted((i, t) for i, t in docs.items() if '"n":2' in t and '"t":"a"' in t)
        assert store.list(c, [("n", "2"), ("s.t", "a")])[0] == want
    store.compact()
    assert store.list("p")[0] == sorted(model["p"].items())


def test_ids_sort_by_bytes_and_reach_the_scan(spark, store):
    store.put_all(spark.createDataFrame([("c", 0, i, "{}") for i in ("\U0001f600", "￮", "a", "B")], TEXTS))
    assert [i for i, _ in store.list("c")[0]] == ["B", "a", "￮", "\U0001f600"]
    from quillstore.operators import listing

    plan = listing.page(store.current(("doc",), "c"), after="a", limit=5)._jdf.queryExecution().toString()
    assert "GreaterThan(id,a)" in plan and "TakeOrderedAndProject" in plan


def test_two_writers_without_a_lock(spark, tmp_path, monkeypatch):
    """As on shared storage: the one that commits second fails, and neither its rows nor its files stay."""
    monkeypatch.setattr("quillstore.sources.mutation_log.MutationLog._locked", lambda self: None)
    root = str(tmp_path / "store")
    with Store(spark, root) as first, Store(spark, root) as second:
        first.put("c", "a", '{"by":1}')
        with pytest.raises(StoreInUse):
            second.put("c", "a", '{"by":2}')
        assert len(first.log.files.names("log/batch=0")) == 1
        assert first.get("c", "a") == '{"by":1}'
        # The loser has read the log anew.
        assert second.get("c", "a") == '{"by":1}'
        second.put("c", "b", "{}")
        with pytest.raises(StoreInUse):
            first.compact()
        assert [i for i, _ in first.list("c")[0]] == ["a", "b"]
        first.compact()
        with pytest.raises(StoreInUse):
            second.delete("c", "a")
        assert second.get("c", "a") == '{"by":1}'
    with Store(spark, root) as s:
        assert [i for i, _ in s.list("c")[0]] == ["a", "b"] and not [n for n in s.log.files.names("commits") if n.endswith(".tmp")]


def test_what_was_read_before_a_snapshot_still_works(spark, store):
    store.put("c", "a", '{"v":1}')
    store.put("c", "b", "{}")
    before = store.current(("doc",))
    store.compact()
    assert before.count() == 2 and len(store.log.files.names("log")) == 3
    store.put("c", "d", "{}")
    later = store.current(("doc",))
    store.compact()
    assert later.count() == 3 and store.collections() == [("c", 3)]
    assert len(store.log.files.names("log")) == 3


def test_writes_of_one_place_are_refused(spark, store):
    with pytest.raises(InvalidRequest):
        store.put_all(spark.createDataFrame([("c", 1, "i", '{"v":1}'), ("c", 1, "i", '{"v":2}')], TEXTS))
    assert store.collections() == []


def test_mixed_mutations_against_a_model(spark, store):
    r = random.Random(4)
    texts = ['{"v":1}', '{ "v" : 2 }', "[1]", "{", None, '{"w":{"x":"y"}}']
    model, names = {}, set()
    for step in range(3):
        rows = [(r.choice(["p", "q", "bad name", None]), n, r.choice(["put", "put", "delete", "other", None]), r.choice(["a", "b", "c", "", "d\n"]), r.choice(texts)) for n in range(40)]
        rows.append(rows[3])
        refused = 0
        for c, n, op, i, t in rows[:40]:
            ok = c in ("p", "q") and i in ("a", "b", "c") and (op == "delete" or op == "put" and t in (texts[0], texts[1], texts[5]))
            refused += not ok
            if ok and op == "put":
                model[c, i] = t.replace(" ", "")
                names.add(c)
            elif ok:
                model.pop((c, i), None)
        bad = store.apply(spark.createDataFrame(rows, "collection string, pos long, op string, id string, text string"))
        assert bad.count() == refused and bad.where("error IS NULL").isEmpty()
    assert {(x["collection"], x["id"]): x["doc"] for x in store.current(("doc",)).collect()} == model
    assert store.collections() == sorted((c, sum(k[0] == c for k in model)) for c in names)
    bad = store.apply(spark.createDataFrame([("p", 7, "put", "a", "{}"), ("p", 7, "put", "a", '{"v":1}'), ("p", None, "put", "a", "{}")], "collection string, pos long, op string, id string, text string")).collect()
    assert len(bad) == 2


def test_all_pages_of_many_ranges(spark):
    from quillstore.operators import listing

    r = random.Random(6)
    ids = sorted({f"{r.choice('abc')}{r.randrange(10**6)}" for _ in range(4000)})
    rows = [(i, "{}") for i in ids]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "id string, doc string").repartition(7)
    got = {x["id"]: x["page"] for x in listing.all_pages(docs, 33).collect()}
    assert got == {x: n // 33 for n, x in enumerate(ids)}
    assert listing.all_pages(docs.limit(0), 5).count() == 0
