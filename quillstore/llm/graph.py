"""Connected components of links that don't fit one machine."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Links that one task finishes (a few megabytes).
FEW = 50_000


def _finished(table: pa.Table) -> pa.Table:
    """(node, root) of few links, in one task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for a, b in zip(table.column("lo").to_pylist(), table.column("hi").to_pylist()):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    nodes = [x for x in parent if root(x) != x]
    return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array([root(x) for x in nodes], pa.int64())})


def _contracted(left: DataFrame) -> DataFrame:
    """(node, root): every node's smallest neighbour, if that is smaller, and on to the end of the chain by pointer jumping."""
    parents = common.written(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "parents")
    while True:
        # The roots that have a root themselves, each once: a hub's many nodes then meet one row, broadcast if all are few.
        above = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moves = common.written(parents.select("root").distinct().join(above, "root"), "moves")
        n = moves.count()
        if not n:
            return parents
        parents = common.written(parents.join(F.broadcast(moves) if n <= common.BROADCAST_ROWS else moves, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "parents")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long) that isn't the smallest of its component.

    Rounds of contraction: nodes take the smallest they reach over smaller neighbours; links between
    those go to the next round. Nodes at least halve in each, and at most ``FEW`` links are finished by
    one task. Rounds are written to the shared folder, so lineage stays short.
    """
    spark = edges.sparkSession
    common.ship(spark)
    left = common.written(
        edges.where("a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links"
    )
    found: DataFrame | None = None
    while n := left.count():
        few = n <= FEW
        parents = common.written(left.withColumn("all", F.lit("few")).groupBy("all").applyInArrow(_finished, "node long, root long"), "parents") if few else _contracted(left)
        known = common.sized(parents)
        if found is None:
            found = parents
        else:
            step = known.select(F.col("node").alias("root"), F.col("root").alias("above"))
            found = common.written(found.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root")).unionByName(parents), "components")
        if few:
            break
        for side in ("lo", "hi"):
            left = left.join(known.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left").withColumn(side, F.coalesce(f"{side}_root", side)).drop(f"{side}_root")
        left = common.written(left.where("lo != hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct(), "links")
    return found if found is not None else spark.createDataFrame([], "node long, root long")
