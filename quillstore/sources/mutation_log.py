"""The mutation log: batches of puts and deletes in Parquet, made visible by commit files.

    <root>/LOCK                              held by the process that writes, on a local disk
    <root>/log/batch=N/attempt=A/part=c_x/   what one attempt wrote as batch N
    <root>/commits/N.json                    {"attempt": A, "collections": [...], "replaces": true for a snapshot}

A batch without its commit file is invisible, so a crash leaves nothing half-done. Where there is no lock, two
writers may write the same batch: each into a folder of its own, and only one commits. The other fails, removes its folder
and reads the log anew. Inside a batch ``pos`` orders the mutations of an id. A snapshot is a
batch that replaces all before it, and holds live documents only; its commit keeps the names of all collections. Files
that it replaces stay until the next snapshot, so that DataFrames read before it still work.
"""

from __future__ import annotations

import fcntl
import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LOG
from .files import Files


class StoreInUse(RuntimeError):
    """Another process holds the directory's lock, or has committed a batch in between."""


class MutationLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.files = Files(spark, root)
        self.root = self.files.root
        self.files.make("log")
        self.files.make("commits")
        self._lock = self._locked()
        self._load()

    def _locked(self):
        """An exclusive lock, on local file systems; elsewhere commits refuse to overwrite each other."""
        parsed = urlparse(self.root)
        if parsed.scheme not in ("", "file"):
            return None
        lock = open(os.path.join(parsed.path, "LOCK"), "a")  # noqa: SIM115
        try:
            fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            lock.close()
            raise StoreInUse(f"{self.root} is in use") from None
        return lock

    def close(self) -> None:
        if self._lock:
            self._lock.close()
            self._lock = None

    def _load(self) -> None:
        #: Attempts of the visible batches, by number.
        self.batches: dict[int, str] = {}
        self.collections: set[str] = set()
        self.last = -1
        for name in self.files.names("commits"):
            if not name.endswith(".json"):
                continue
            commit = json.loads(self.files.read(f"commits/{name}"))
            self._visible(int(name.removesuffix(".json")), commit["attempt"], commit["collections"], commit["replaces"])

    def _visible(self, batch: int, attempt: str, collections, replaces: bool) -> None:
        self.last = batch
        self.batches = {batch: attempt} if replaces else {**self.batches, batch: attempt}
        self.collections |= set(collections)

    def _commit(self, rows: DataFrame, collections, replaces: bool) -> None:
        """Write ``rows`` as the next batch, visible as a whole or not at all."""
        batch, attempt = self.last + 1, uuid.uuid4().hex
        folder = f"log/batch={batch}/attempt={attempt}"
        try:
            rows.write.mode("errorifexists").partitionBy("part").parquet(f"{self.root}/{folder}")
            self.files.write_new(f"commits/{batch:012d}.json", json.dumps({"attempt": attempt, "collections": collections, "replaces": replaces}))
        except FileExistsError:
            self.files.remove(folder)
            self._load()
            raise StoreInUse(f"another writer has committed batch {batch} of {self.root}") from None
        self._visible(batch, attempt, collections, replaces)

    def append(self, mutations: DataFrame, collections) -> None:
        """Add one batch: collection, pos, op, id, doc, fields. ``collections`` it creates are named, even if none of its rows stays."""
        rows = mutations.select(F.concat(F.lit("c_"), "collection").alias("part"), "collection", F.col("pos").cast("long").alias("pos"), "op", "id", "doc", "fields")
        self._commit(rows, sorted(collections), False)

    def compact(self, live: DataFrame) -> None:
        """Replace all batches by one of the ``live`` documents, sorted by id, so that ids prune files."""
        first = min(self.batches, default=0)
        rows = live.select("part", "collection", F.lit(0).cast("long").alias("pos"), F.lit("put").alias("op"), "id", "doc", "fields")
        self._commit(rows.repartitionByRange("part", "id").sortWithinPartitions("part", "id"), sorted(self.collections), True)
        # What the snapshot before this one replaced.
        for name in self.files.names("log"):
            if name.startswith("batch=") and int(name.removeprefix("batch=")) < first:
                self.files.remove(f"log/{name}")

    def read(self) -> DataFrame:
        """All committed mutations, as one scan: ``batch`` and ``part`` are partition columns. Only committed folders are listed."""
        if not self.batches:
            return self.spark.createDataFrame([], LOG)
        folders = [f"{self.root}/log/batch={b}/attempt={a}" for b, a in self.batches.items()]
        return self.spark.read.schema(f"{LOG}, attempt string").option("basePath", f"{self.root}/log").parquet(*folders).drop("attempt")
