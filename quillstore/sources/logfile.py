"""Import and export of framed collection logs.

A record is ``length u32, crc32 u32`` (little endian) and ``length`` bytes of payload: ``op u8`` (1 put, 2 delete),
``id length u16``, the id, and the document's text. What a crash can leave at a log's end (a record cut short, one
that ends the file and doesn't check out, or zeros) is cut; anything else that doesn't check out is an error. A
record that claims to run past the end counts as cut short only if no whole record follows in the bytes left: a
damaged length in the middle isn't mistaken for the end.
"""

from __future__ import annotations

import itertools
import mmap
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.jsontext import MAX_DOC_BYTES
from ..shipping import ship

# Fixed values of the format.
PUT, DELETE = 1, 2
OPS = {PUT: "put", DELETE: "delete"}
_FRAME = struct.Struct("<II")
_HEAD = struct.Struct("<BH")
LONGEST = MAX_DOC_BYTES + 256 + _HEAD.size
_NAME = re.compile(r"([A-Za-z0-9_-]{1,64})\.log")
SCHEMA = "collection string, pos bigint, op string, id string, text string"


class DamagedLog(ValueError):
    """A record in the middle of a log doesn't check out."""


@dataclass(frozen=True)
class Record:
    op: int
    id: str
    text: str

    def to_bytes(self) -> bytes:
        name = self.id.encode()
        payload = _HEAD.pack(self.op, len(name)) + name + self.text.encode()
        return _FRAME.pack(len(payload), zlib.crc32(payload)) + payload


def _payload(payload: memoryview, crc: int) -> Record | None:
    """The record, if all of it checks out."""
    if len(payload) < _HEAD.size or zlib.crc32(payload) != crc:
        return None
    op, n = _HEAD.unpack_from(payload)
    body = payload[_HEAD.size :]
    if op not in OPS or len(body) < n:
        return None
    try:
        return Record(op, bytes(body[:n]).decode(), bytes(body[n:]).decode())
    except UnicodeDecodeError:
        return None


def _whole_record_in(data: memoryview) -> bool:
    """Whether a record that checks out begins anywhere in ``data``. Only places whose lengths and op are possible are checksummed."""
    first = _FRAME.size + _HEAD.size
    for begin in range(0, max(0, len(data) - first + 1), _STRIDE):
        raw = np.frombuffer(data[begin : begin + _STRIDE + first - 1], np.uint8).astype(np.int64)
        places = len(raw) - first + 1
        number = lambda at, width: sum(raw[at + i : at + i + places] << (8 * i) for i in range(width))  # noqa: E731, B023
        n, op, name = number(0, 4), raw[_FRAME.size : _FRAME.size + places], number(_FRAME.size + 1, 2)
        left = len(data) - begin - np.arange(places) - _FRAME.size
        for at in np.flatnonzero((n >= _HEAD.size + name) & (n <= left) & np.isin(op, list(OPS))).tolist():
            at += begin
            size, crc = _FRAME.unpack_from(data, at)
            if _payload(data[at + _FRAME.size : at + _FRAME.size + size], crc):
                return True
    return False


#: Places that are looked at together.
_STRIDE = 1 << 18


def scan(data) -> Iterator[tuple[Record, int]]:
    """The records of a log's bytes, each with the byte at which it ends; stops at a torn end, and raises at damage before it."""
    at, view = 0, memoryview(data)
    while at < len(view):
        rest = view[at:]
        n, crc = _FRAME.unpack_from(rest) if len(rest) >= _FRAME.size else (None, 0)
        found = _payload(rest[_FRAME.size : _FRAME.size + n], crc) if n is not None and n <= len(rest) - _FRAME.size else None
        if found:
            at += _FRAME.size + n
            yield found, at
            continue
        short = n is None or (n <= LONGEST and n > len(rest) - _FRAME.size)
        ends = n is not None and n <= LONGEST and n == len(rest) - _FRAME.size
        if not (ends or _zeros(rest) or (short and not _whole_record_in(rest[1:]))):
            raise DamagedLog(f"the record at byte {at} is damaged, and the log goes on after it")
        return


def _zeros(data: memoryview) -> bool:
    return all(not bytes(data[i : i + _STRIDE]).strip(b"\0") for i in range(0, len(data), _STRIDE))


def decode(data: bytes) -> tuple[list[Record], int]:
    """The records, and the byte at which the rest was cut (the length if nothing was)."""
    found = list(scan(data))
    return [r for r, _ in found], found[-1][1] if found else 0


@contextmanager
def mapped(path: str | Path) -> Iterator[memoryview]:
    """A log's bytes, read as they are asked for."""
    with open(path, "rb") as f:
        if os.fstat(f.fileno()).st_size == 0:
            yield memoryview(b"")
            return
        # Unmapped when the last view of it goes.
        yield memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def log_files(folder: str) -> dict[str, Path]:
    """Collections by name; files with other names are passed over."""
    return {m[1]: p for p in sorted(Path(folder).iterdir()) if (m := _NAME.fullmatch(p.name))}


class _LogPartition(InputPartition):
    def __init__(self, collection: str, path: str):
        super().__init__(collection)
        self.collection, self.path = collection, path


class _LogReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return [_LogPartition(name, str(path)) for name, path in log_files(self.folder).items()] or [_LogPartition("", "")]

    def read(self, partition):
        if partition.path:
            with mapped(partition.path) as data:
                for pos, (r, _) in enumerate(scan(data)):
                    yield partition.collection, pos, OPS[r.op], r.id, r.text if r.op == PUT else None


class CollectionLogs(DataSource):
    """``spark.read.format("collection_logs").load(folder)``: one partition for each log, read where all machines see the folder."""

    @classmethod
    def name(cls) -> str:
        return "collection_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options["path"])


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(CollectionLogs)
    return spark.read.format("collection_logs").load(folder)


def report(spark: SparkSession, folder: str) -> DataFrame:
    """For each log (collection, records, bytes, cut_at, damage): where its torn end begins, if it has one, or why it is refused. Files stay as they are."""

    def look(item: tuple[str, str]) -> tuple:
        with mapped(item[1]) as data:
            records, at, size = 0, 0, len(data)
            try:
                for _, at in scan(data):
                    records += 1
            except DamagedLog as e:
                return item[0], None, size, None, str(e)
        return item[0], records, size, at if at < size else None, None

    ship(spark)
    logs = [(name, str(path)) for name, path in log_files(folder).items()]
    found = spark.sparkContext.parallelize(logs, max(1, len(logs))).map(look)
    return spark.createDataFrame(found, "collection string, records bigint, bytes bigint, cut_at bigint, damage string")


def export(current: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Write one log of puts for each collection, in id order, and say how many records each has.

    The tasks write, to a folder that all machines see under this path: a collection is one file, so one task, which streams its
    sorted rows. A log appears under its name when it is whole, so a task that runs again does no harm. Only the counts reach the driver.
    """
    Path(folder).mkdir(parents=True, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("collection", "id", "doc"))))
        for name, group in itertools.groupby(rows, key=lambda r: r[0]):
            aside, n = Path(folder) / f"{name}.log.{uuid.uuid4().hex}", 0
            with aside.open("wb") as out:
                for _, id, doc in group:
                    out.write(Record(PUT, id, doc).to_bytes())
                    n += 1
                out.flush()
                os.fsync(out.fileno())
            aside.replace(Path(folder) / f"{name}.log")
            yield pa.RecordBatch.from_pydict({"collection": [name], "records": [n]})

    ship(current.sparkSession)
    sorted_rows = current.select("collection", "id", "doc").repartition("collection").sortWithinPartitions("collection", "id")
    return sorted((r["collection"], r["records"]) for r in sorted_rows.mapInArrow(write, "collection string, records bigint").collect())
