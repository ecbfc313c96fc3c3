"""A store of JSON document collections."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import listing, state
from .operators.listing import InvalidRequest
from .schema import part_of
from .shipping import ship
from .sources.mutation_log import MutationLog

_MUTATION = "collection string, pos bigint, op string, id string, doc string, fields map<string,string>"


def _checked(collection: str, id: str | None = None) -> None:
    problem = C.naming_problem(collection, id)
    if problem:
        raise InvalidRequest(problem)


class Store:
    """Collections under one root, written by one process at a time.

    Batches (``put_all``, ``delete_all``, ``get_many``) are the intended shape; the single-document methods are
    batches of one; ``apply`` takes puts and deletes mixed. A batch is visible once it is committed; its data files are written by Spark, whose
    commits don't promise an fsync, while the commit file itself is synced.
    """

    def __init__(self, spark: SparkSession, root: str):
        ship(spark)
        self.spark = spark
        self.log = MutationLog(spark, root)

    def __enter__(self) -> "Store":
        return self

    def __exit__(self, *_) -> None:
        self.log.close()

    def close(self) -> None:
        self.log.close()

    # Writing

    def apply(self, mutations: DataFrame) -> DataFrame:
        """Commit the mutations (collection, pos, op, id, text) as one batch; pos orders those of an id.

        Each is checked by itself, so a refused put leaves the one before it standing, and a collection that a put creates
        stays, even if a later delete empties it. Refused rows come back with what was wrong: a bad name, id or text, an op
        other than put and delete, or a place that another mutation of the id has already (the same one twice counts once).
        """
        asked = mutations.select("collection", F.col("pos").cast("long").alias("pos"), "op", "id", "text").dropDuplicates()
        place = Window.partitionBy("collection", "id", "pos").orderBy("op", "text")
        put, delete = F.coalesce(F.col("op") == "put", F.lit(False)), F.coalesce(F.col("op") == "delete", F.lit(False))
        read = asked.withColumn("turn", F.row_number().over(place)).withColumn("read", C.canonicalise(F.when(put, F.col("text"))))
        error = (
            F.when(~put & ~delete, F.lit("an op is put or delete")).when(~C.valid_collection(F.col("collection")), F.lit(C.BAD_NAME)).when(~C.valid_id(F.col("id")), F.lit(C.BAD_ID))
            .when(F.col("pos").isNull(), F.lit("a mutation has a place")).when(F.col("turn") > 1, F.lit("another mutation of the id has this place")).when(put, F.col("read.error"))
        )
        checked = read.select("collection", "pos", "op", "id", "text", "read.doc", "read.fields", error.alias("error")).persist()
        try:
            good = checked.where("error IS NULL")
            names = [r["collection"] for r in good.where("op = 'put'").select("collection").distinct().collect()]
            if names or not good.isEmpty():
                self.log.append(good, names)
            return self._kept(checked.where("error IS NOT NULL").select("collection", "pos", "op", "id", "text", "error"), "refused")
        finally:
            checked.unpersist()

    def put_all(self, texts: DataFrame) -> DataFrame:
        """Write one document per row of ``texts`` (collection, id, text; pos orders rows of one id and may be left out if ids are unique).

        Valid rows are committed as one batch. The rows that were refused come back, with what was wrong.
        """
        rows = texts if "pos" in texts.columns else texts.withColumn("pos", F.lit(0))
        checked = rows.select("collection", "pos", "id", "text", C.canonicalise("text").alias("read")).select(
            "collection", "pos", "id", "text", "read.*",
            F.when(~C.valid_collection(F.col("collection")), F.lit(C.BAD_NAME)).when(~C.valid_id(F.col("id")), F.lit(C.BAD_ID)).alias("named"),
        )
        checked = checked.withColumn("error", F.coalesce("named", "error")).persist()
        try:
            good = checked.where("error IS NULL")
            if not good.groupBy("collection", "id", "pos").count().where("count > 1").isEmpty():
                raise InvalidRequest("writes of one id have the same place, so pos must say which is the last")
            names = [r["collection"] for r in good.select("collection").distinct().collect()]
            if names:
                self.log.append(good.withColumn("op", F.lit("put")), names)
            return self._kept(checked.where("error IS NOT NULL").select("collection", "id", "text", "error"), "refused")
        finally:
            checked.unpersist()

    def delete_all(self, wanted: DataFrame) -> DataFrame:
        """Delete the (collection, id) rows of ``wanted``; (collection, id, deleted) says whether each was there. Absent ones aren't logged."""
        asked = wanted.select("collection", "id").distinct()
        if not asked.where(~C.valid_collection(F.col("collection")) | ~C.valid_id(F.col("id"))).isEmpty():
            raise InvalidRequest("a collection's name or an id isn't valid")
        live = self.current(()).select("collection", "id", F.lit(True).alias("deleted"))
        found = asked.join(live, ["collection", "id"], "left").select("collection", "id", F.coalesce("deleted", F.lit(False)).alias("deleted")).persist()
        try:
            gone = found.where("deleted")
            names = [r["collection"] for r in gone.select("collection").distinct().collect()]
            if names:
                self.log.append(gone.select("collection", F.lit(0).alias("pos"), F.lit("delete").alias("op"), "id", F.lit(None).cast("string").alias("doc"), F.lit(None).cast("map<string,string>").alias("fields")), names)
            return self._kept(found, "answers")
        finally:
            found.unpersist()

    def _kept(self, rows: DataFrame, folder: str) -> DataFrame:
        """What a batch answers, in a folder of its own: it may be as large as the batch."""
        path = f"{self.log.root}/{folder}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def put(self, collection: str, id: str, text: str) -> None:
        _checked(collection, id)
        read = C.canonical(text)
        if read["error"]:
            raise InvalidRequest(read["error"])
        row = (collection, 0, "put", id, read["doc"], dict(read["fields"]))
        self.log.append(self.spark.createDataFrame([row], _MUTATION), [collection])

    def delete(self, collection: str, id: str) -> bool:
        _checked(collection, id)
        if self.get(collection, id) is None:
            return False
        self.log.append(self.spark.createDataFrame([(collection, 0, "delete", id, None, None)], _MUTATION), [collection])
        return True

    def compact(self) -> None:
        """Replace the log by its live documents. Collections without documents stay known."""
        if self.log.batches:
            self.log.compact(self.current())

    # Reading

    def mutations(self, collection: str | None = None) -> DataFrame:
        log = self.log.read()
        return log if collection is None else log.where(F.col("part") == part_of(collection))

    def current(self, columns: tuple[str, ...] = ("doc", "fields"), collection: str | None = None) -> DataFrame:
        return state.current(self.mutations(collection), columns)

    def collections(self) -> list[tuple[str, int]]:
        names = self.spark.createDataFrame([(n,) for n in self.log.collections], "collection string")
        return [(r["collection"], r["documents"]) for r in state.collection_counts(self.log.read(), names).orderBy("collection").collect()]

    def get(self, collection: str, id: str) -> str | None:
        """The document's text. Names aren't checked: what can't be there isn't."""
        found = self.mutations(collection).where(F.col("id") == id)
        row = state.current(found, ("doc",)).first()
        return row["doc"] if row else None

    def get_many(self, collection: str, ids: DataFrame) -> DataFrame:
        return listing.get_many(self.current(("doc",), collection), ids)

    def list(self, collection: str, filters: Iterable[tuple[str, str]] = (), after: str | None = None, limit: int = 100) -> tuple[list[tuple[str, str]], str | None]:
        """One page in id order, and the id to go on after, if there is more."""
        filters = list(filters)
        _checked(collection)
        listing.checked_limit(limit)
        docs = self.current(("doc", "fields") if filters else ("doc",), collection)
        return listing.page_and_next(docs, filters, after, limit)

    def all_pages(self, collection: str, limit: int, filters: Iterable[tuple[str, str]] = ()) -> DataFrame:
        return listing.all_pages(self.current(("doc", "fields") if filters else ("doc",), collection), limit, list(filters))

