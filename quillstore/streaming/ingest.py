"""Streams of mutations into a store, and the fold kept up to date as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..store import Store

#: What an ingest stream reads: pos orders the mutations of one id inside a micro-batch.
MUTATIONS = "collection string, pos bigint, op string, id string, text string"
REFUSED = f"{MUTATIONS}, error string, epoch bigint"


def ingest(stream: DataFrame, store: Store, name: str = "ingest") -> DataStreamWriter:
    """Applies each micro-batch to the store as one batch (``Store.apply``); what is refused is kept (``refused``), and never stops the stream.

    A micro-batch that is run again after a failure applies the same mutations again, which changes nothing: the fold
    keeps the last of each id. Its refusals replace those of the first run. ``name`` tells the streams of a store apart.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        bad = store.apply(batch)
        bad.write.mode("overwrite").parquet(f"{store.log.root}/refused/{name}/epoch={epoch}")

    return stream.writeStream.foreachBatch(apply)


def refused(store: Store, name: str = "ingest") -> DataFrame:
    """What a stream's micro-batches refused so far: their rows, what was wrong, and the number of the micro-batch."""
    folder = f"{store.log.root}/refused/{name}"
    if not store.log.files.names(f"refused/{name}"):
        return store.spark.createDataFrame([], REFUSED)
    return store.spark.read.schema(REFUSED).parquet(folder)


def running_state(stream: DataFrame) -> DataFrame:
    """The last mutation of each id so far, for update or complete mode. State is one row for every id ever seen, tombstones included."""
    return stream.groupBy("collection", "id").agg(F.max_by(F.struct("op", "text"), "pos").alias("last")).select("collection", "id", "last.*")
