import os
from collections import Counter

import duckdb
import pytest

from quillstore.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_its_sql(spark, name):
    with duckdb.connect() as c:
        for table in os.listdir(SF):
            c.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{table}')")
        want = c.sql(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda x: Counter(tuple(map(str, r)) for r in x[columns].itertuples(index=False))
    assert rows(got) == rows(want)
