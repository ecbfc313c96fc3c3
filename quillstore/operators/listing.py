"""Reads over live documents: lookups, filters, pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..shared import shared_dir


class InvalidRequest(ValueError):
    """A name, id, document or limit that the store doesn't take."""


def checked_limit(limit: int) -> int:
    if not 1 <= limit <= C.MAX_LIMIT:
        raise InvalidRequest(f"a page has 1 to {C.MAX_LIMIT} documents")
    return limit


def selected(docs: DataFrame, filters=(), after: str | None = None) -> DataFrame:
    """Documents past ``after`` in which every (path, text) filter holds. ``docs`` has id, doc and fields."""
    if after is not None:
        docs = docs.where(F.col("id") > after)
    return docs.where(C.all_equal(filters)) if filters else docs


def page(docs: DataFrame, filters=(), after: str | None = None, limit: int = 100) -> DataFrame:
    """(id, doc) of one page in id order."""
    return selected(docs, filters, after).select("id", "doc").orderBy("id").limit(checked_limit(limit))


def page_and_next(docs: DataFrame, filters=(), after: str | None = None, limit: int = 100) -> tuple[list[tuple[str, str]], str | None]:
    """The page's rows on the driver (1000 at most), and its last id if another page follows."""
    rows = [(r["id"], r["doc"]) for r in selected(docs, filters, after).select("id", "doc").orderBy("id").limit(checked_limit(limit) + 1).collect()]
    return rows[:limit], rows[limit - 1][0] if len(rows) > limit else None


def get_many(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, doc) for each id of ``wanted``; a null doc where there is none."""
    return wanted.select("id").join(docs.select("id", "doc"), "id", "left")


def all_pages(docs: DataFrame, limit: int, filters=()) -> DataFrame:
    """(page, id, doc) of the whole listing, pages counted from 0.

    Ids are sorted in ranges, as many as the rows need, and written to the shared folder once, numbered inside their range. The
    ranges' sizes, one row each, are summed up and tell where each range begins. The written rows stay there, since the result
    reads them.
    """
    checked_limit(limit)
    spark = docs.sparkSession
    rows = selected(docs, filters).select("id", "doc")
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    # Numbers hold the task from bit 33 on, and below that count its sorted rows.
    rows.repartitionByRange("id").sortWithinPartitions("id").select(F.monotonically_increasing_id().alias("number"), "id", "doc").write.parquet(path)
    ranged = spark.read.schema("number long, id string, doc string").parquet(path)
    sizes = ranged.groupBy(F.shiftright("number", 33).alias("range")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each task that wrote.
    begins = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("begin"))
    placed = ranged.join(F.broadcast(begins), F.shiftright("number", 33) == F.col("range"))
    return placed.select(F.floor((F.col("begin") + F.col("number") % F.lit(1 << 33)) / limit).cast("long").alias("page"), "id", "doc")
