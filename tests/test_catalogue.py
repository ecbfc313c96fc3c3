import os
from collections import Counter

import duckdb
import pytest

from quillstore.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    with duckdb.connect() as c:
        for name in os.listdir(SF):
            c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
        yield c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_its_sql(spark, sql, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name not in catalogue.ORACLES:
        return
    want = sql.sql(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda x: Counter(tuple(map(str, r)) for r in x[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_crc_check_value(spark):
    from pyspark.sql import functions as F

    from quillstore.functions import columns as C

    assert spark.range(1).select(C.crc32(F.lit("123456789"))).first()[0] == 0xCBF43926
