"""What a mutation log amounts to: last write wins, tombstones, counts and delete flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, columns: tuple[str, ...] = ("doc", "fields")) -> DataFrame:
    """The last mutation of each (collection, id), tombstones included. Only ``columns`` are carried through the shuffle.

    ``log`` has collection, id, op, batch and pos; a later batch wins, then a higher pos.
    Filters on ids reach the scan through the aggregate, since ids are grouping keys;
    filters on documents must come after it, or old versions would come back.
    """
    kept = F.struct("op", *columns)
    keys = [c for c in ("part", "collection", "id") if c in log.columns]
    return log.groupBy(*keys).agg(F.max_by(kept, F.struct("batch", "pos")).alias("last")).select(*keys, "last.*")


def current(log: DataFrame, columns: tuple[str, ...] = ("doc", "fields")) -> DataFrame:
    """The live documents."""
    return latest(log, columns).where("op = 'put'").drop("op")


def collection_counts(log: DataFrame, registry: DataFrame) -> DataFrame:
    """(collection, documents) for every collection ever created, those without documents included."""
    live = latest(log, ()).groupBy("collection").agg(F.sum((F.col("op") == "put").cast("long")).alias("documents"))
    return registry.select("collection").distinct().join(live, "collection", "left").select("collection", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))


def delete_flags(log: DataFrame) -> DataFrame:
    """For each delete of a history, whether there was a document to delete."""
    order = Window.partitionBy("collection", "id").orderBy("batch", "pos")
    seen = log.select("collection", "id", "batch", "pos", "op", F.lag("op").over(order).alias("before"))
    return seen.where("op = 'delete'").select("collection", "id", "batch", "pos", F.coalesce(F.col("before") == "put", F.lit(False)).alias("deleted"))
