"""The sample tables as collections: (id, doc, fields), and as mutations of them.

Documents made of typed columns are built with DataFrame functions: their text is canonical as it is built,
and their fields are known. Only ``events.props``, which is JSON text already, goes through the reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _string(value: Column) -> Column:
    """A JSON string of text without control characters."""
    return F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"'))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text), not read yet."""
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("props").alias("text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).select("id", C.canonicalise("text").alias("read")).select("id", "read.doc", "read.fields")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority, customer = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey").cast("string")
    doc = F.concat(F.lit('{"status":'), _string(status), F.lit(',"priority":'), _string(priority), F.lit(',"custkey":'), customer, F.lit("}"))
    fields = F.create_map(F.lit("status"), status, F.lit("priority"), priority, F.lit("custkey"), customer)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), doc.alias("doc"), fields.alias("fields"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    inner = F.concat(F.lit('{"key":'), nation, F.lit("}"))
    doc = F.concat(F.lit('{"segment":'), _string(segment), F.lit(',"nation":'), inner, F.lit("}"))
    fields = F.create_map(F.lit("segment"), segment, F.lit("nation"), inner, F.lit("nation.key"), nation)
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"), doc.alias("doc"), fields.alias("fields"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit('{"brand":'), _string(F.col("p_brand")), F.lit(',"size":'), F.col("p_size").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), doc.alias("doc"))


def mutations(spark: SparkSession, sf_dir: str, collections: int = 4) -> DataFrame:
    """Events as writes of their user's document, in the order of (ts, event_id); "error" events are deletes."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("users-"), (F.col("user_id") % collections).cast("string")).alias("collection"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("batch"), F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.col("user_id").cast("string").alias("id"), F.col("props").alias("doc"),
    )
