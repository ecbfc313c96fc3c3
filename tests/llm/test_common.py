import pytest
from pyspark.sql import functions as F

from quillstore.llm import common


def test_tables_inside_a_scope_are_removed(spark, tmp_path):
    with common.scratch(spark):
        df = common.written(spark.range(5), "some")
        path = df.inputFiles()[0]
        assert df.count() == 5
        kept = common.settled(spark, lambda: common.written(spark.range(7), "inner").where("id > 1"), "outer")
        assert kept.count() == 5
    for gone in (path, kept.inputFiles()[0]):
        with pytest.raises(Exception):
            spark.read.parquet(gone).count()
    free = common.settled(spark, lambda: common.written(spark.range(7), "inner").where("id > 1"), "outer")
    assert free.count() == 5 and not common._scopes


def test_what_is_broadcast_is_bounded(spark, monkeypatch):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    rows = spark.range(20).select("id", F.lit("x" * 100).alias("t"))
    assert hinted(common.sized(rows))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1999)
    assert not hinted(common.sized(rows))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 2000)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 19)
    assert not hinted(common.sized(rows)) and hinted(common.sized(rows.limit(0)))
