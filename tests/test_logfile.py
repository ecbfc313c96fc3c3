import pytest

from quillstore.sources import logfile as L

RECORDS = [L.Record(L.PUT, "a", '{"v":1}'), L.Record(L.PUT, "b", '{"v":2}'), L.Record(L.DELETE, "a", ""), L.Record(L.PUT, "d", "{}")]
WHOLE = b"".join(r.to_bytes() for r in RECORDS)


def test_records_come_back():
    assert L.decode(WHOLE) == (RECORDS, len(WHOLE))
    assert L.decode(b"") == ([], 0)


@pytest.mark.parametrize("cut", [1, 3, 8, 12])
def test_a_torn_end_is_cut(cut):
    records, at = L.decode(WHOLE[:-cut])
    assert records == RECORDS[:3] and at == len(WHOLE) - len(RECORDS[3].to_bytes())


def test_zeros_and_a_damaged_end_are_cut():
    assert L.decode(WHOLE + b"\0" * 4096) == (RECORDS, len(WHOLE))
    assert L.decode(WHOLE[:-1] + b"!")[0] == RECORDS[:3]


def test_damage_in_the_middle_is_refused():
    first = len(RECORDS[0].to_bytes())
    flipped = bytearray(WHOLE)
    flipped[first + 12] ^= 1
    huge, long = bytearray(WHOLE), bytearray(WHOLE)
    huge[first : first + 4] = b"\xff\xff\xff\xff"
    long[first : first + 4] = (1000).to_bytes(4, "little")
    for data in (flipped, huge, long):
        with pytest.raises(L.DamagedLog):
            L.decode(bytes(data))


def test_import_and_export(spark, tmp_path):
    from quillstore.store import Store

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c.log").write_bytes(WHOLE)
    (tmp_path / "in" / "bad name.log").write_bytes(b"junk")
    rows = L.read_logs(spark, str(tmp_path / "in"))
    assert [(r["collection"], r["pos"], r["op"], r["id"]) for r in rows.orderBy("pos").collect()] == [("c", 0, "put", "a"), ("c", 1, "put", "b"), ("c", 2, "delete", "a"), ("c", 3, "put", "d")]
    (tmp_path / "in" / "torn.log").write_bytes(WHOLE + b"\0\0\0")
    (tmp_path / "in" / "bad.log").write_bytes(b"\1\0\0\0xxxx!" + WHOLE)
    seen = {r["collection"]: (r["records"], r["bytes"], r["cut_at"], r["damage"] is None) for r in L.report(spark, str(tmp_path / "in")).collect()}
    assert seen == {"c": (4, len(WHOLE), None, True), "torn": (4, len(WHOLE) + 3, len(WHOLE), True), "bad": (None, len(WHOLE) + 9, None, False)}
    (tmp_path / "in" / "torn.log").unlink()
    (tmp_path / "in" / "bad.log").unlink()
    with Store(spark, str(tmp_path / "s")) as store:
        store.put_all(rows.where("op = 'put'").drop("op"))
        store.delete("c", "a")
        L.export(store.current(("doc",)), str(tmp_path / "out"))
    assert L.decode((tmp_path / "out" / "c.log").read_bytes())[0] == [L.Record(L.PUT, "b", '{"v":2}'), L.Record(L.PUT, "d", "{}")]


def test_records_are_found_anywhere(monkeypatch):
    import random

    r = random.Random(2)
    whole = L.Record(L.PUT, "key", '{"v":1}').to_bytes()
    monkeypatch.setattr(L, "_STRIDE", 64)
    for _ in range(60):
        noise = [bytes(r.choice((0, 1, 2, 7, 255)) for _ in range(r.randrange(200))) for _ in range(2)]
        assert L._whole_record_in(memoryview(noise[0] + whole + noise[1]))
        broken = bytearray(whole)
        broken[r.randrange(4, len(whole))] ^= 64
        assert not L._whole_record_in(memoryview(noise[0] + bytes(broken)))
    assert not L._whole_record_in(memoryview(whole[:-1])) and not L._whole_record_in(memoryview(b""))


def test_a_long_damaged_tail_is_looked_through_quickly():
    import time

    data = bytearray(b"\xff\xff\xff\x00" + bytes(range(256)) * 30_000 + WHOLE)
    began = time.time()
    with pytest.raises(L.DamagedLog):
        L.decode(bytes(data))
    assert time.time() - began < 5


def test_an_empty_log(spark, tmp_path):
    (tmp_path / "c.log").write_bytes(b"")
    assert L.read_logs(spark, str(tmp_path)).count() == 0
    assert [tuple(x) for x in L.report(spark, str(tmp_path)).collect()] == [("c", 0, 0, None, None)]


def test_export_counts_what_it_writes(spark, tmp_path):
    rows = [(c, f"{i:03d}", "{}") for c in ("a", "b", "long-name") for i in range(50)]
    counts = L.export(spark.createDataFrame(rows[::-1], "collection string, id string, doc string"), str(tmp_path / "out"))
    assert counts == [("a", 50), ("b", 50), ("long-name", 50)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.log", "b.log", "long-name.log"]
    assert [r.id for r in L.decode((tmp_path / "out" / "b.log").read_bytes())[0]] == [f"{i:03d}" for i in range(50)]
