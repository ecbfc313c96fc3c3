"""Helpers that several operators share: reading tables, shared folders, sizes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import remove, shared_dir
from ..shipping import ship  # noqa: F401  the operators' own name for it

#: Tables written so far, one list for each open ``scratch``.
_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that operators write inside, when it ends: what is to stay must have been saved by then.

    Without it they stay in the shared folder, since an operator's result reads them lazily.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def settled(spark: SparkSession, make, name: str) -> DataFrame:
    """The DataFrame that ``make()`` gives, written; what it wrote on the way is removed."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Of what is broadcast, at most.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 100 << 20
#: Of memory for each column of a row that is broadcast, about (230 bytes for seven columns, measured).
COLUMN_BYTES = 32


def sized(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows, counted, and the bytes of its columns are few enough; joins with it shuffle otherwise. ``df`` is in the shared folder already."""
    texts = [F.sum(F.octet_length(c)) for c, kind in df.dtypes if kind in ("string", "binary")]
    rows, *sizes = df.agg(F.count(F.lit(1)), *texts).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * len(df.columns) * COLUMN_BYTES + sum(s or 0 for s in sizes) <= BROADCAST_BYTES else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
