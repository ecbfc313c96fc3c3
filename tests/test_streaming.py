from quillstore.store import Store
from quillstore.streaming import ingest as S


def test_a_stream_of_mutations(spark, tmp_path):
    source = tmp_path / "in"
    batches = [[("c", 0, "put", "a", '{"v":1}'), ("c", 1, "put", "b", "{}"), ("c", 2, "put", "a", '{"v":2}')], [("c", 0, "delete", "b", None), ("d", 1, "put", "x", "{}"), ("d", 2, "delete", "x", None)]]
    for rows in batches:
        spark.createDataFrame(rows, S.MUTATIONS).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(S.MUTATIONS).option("maxFilesPerTrigger", 1).parquet(str(source))
    with Store(spark, str(tmp_path / "s")) as store:
        query = S.ingest(stream, store).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert store.list("c")[0] in ([("a", '{"v":2}')], [("a", '{"v":2}'), ("b", "{}")])
        assert store.get("c", "a") == '{"v":2}'


def test_running_state(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("c", 0, "put", "a", "1"), ("c", 1, "delete", "a", None), ("c", 0, "put", "b", "2")], S.MUTATIONS).write.parquet(source)
    query = S.running_state(spark.readStream.schema(S.MUTATIONS).parquet(source)).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["id"], r["op"], r["text"]) for r in spark.table("running").collect()} == {("a", "delete", None), ("b", "put", "2")}


def test_refusals_are_kept_and_stop_nothing(spark, tmp_path):
    source = tmp_path / "in"
    batches = [
        # A put stands although a later one is refused; one that a delete follows still creates its collection.
        [("c", 0, "put", "a", '{"v":1}'), ("c", 1, "put", "a", "{oops"), ("e", 0, "put", "x", "{}"), ("e", 1, "delete", "x", None)],
        [("bad name", 0, "delete", "a", None), ("c", 0, "drop", "a", None), ("c", 1, "put", "b", "{}"), ("never", 0, "delete", "z", None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, S.MUTATIONS).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(S.MUTATIONS).option("maxFilesPerTrigger", 1).parquet(str(source))
    with Store(spark, str(tmp_path / "s")) as store:
        assert S.refused(store).count() == 0
        query = S.ingest(stream, store).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        assert store.get("c", "a") == '{"v":1}' and store.get("c", "b") == "{}"
        assert store.collections() == [("c", 2), ("e", 0)]
        assert sorted((x["collection"], x["op"]) for x in S.refused(store).collect()) == [("bad name", "delete"), ("c", "drop"), ("c", "put")]
