"""What several operators of this package share: reading tables, batches for Python tasks, shared files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from yearloom.scale.workers import ship
from yearloom.scale.written import checkpoint_root

#: Rows of one Arrow batch sent to a Python worker; long rows make batches large, so few are sent at once.
BATCH_ROWS = 256


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with Arrow batches of at most ``BATCH_ROWS`` rows and workers that know this package."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != str(BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared checkpoint folder, for files that tasks write themselves."""
    return "/".join(
        [checkpoint_root(spark).rstrip("/"), "yearloom", spark.sparkContext.applicationId, f"{label}-{uuid.uuid4().hex}"]
    )


def create_file(folder: str, name: str, suffix: str):
    """A new file of a name that no other attempt of the task uses: (path, open stream).

    A file counts only when its path is in the table that the task returns, so
    what a lost or repeated attempt wrote is never read.
    """
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", store.open_output_stream(f"{path}/{name}", compression=None)


def open_file(path: str) -> pa.NativeFile:
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, lengthened until it is no column of ``df`` (in any case of letters) and no other of these."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Remembered(dict):
    """What a worker has found for keys lately: ``find(key)`` is asked for the others.

    Two generations of at most ``most`` keys each: when the young one is full it
    becomes the old one, so what is asked for often stays.
    """

    most = 100_000

    def __init__(self):
        super().__init__()
        self._old: dict = {}

    def find(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        found = self._old.get(key)
        if found is None:
            found = self.find(key)
        if len(self) >= self.most:
            self._old = dict(self)
            self.clear()
        self[key] = found
        return found

    def forget(self) -> None:
        self.clear()
        self._old = {}


_HOLDER = None


def hold(owner) -> None:
    """Lets one operator remember things in this worker: another one's are forgotten when a task of ``owner`` begins.

    Workers serve many tasks and operators; so what they remember helps the
    next task of the same operator and never adds up.
    """
    global _HOLDER
    if _HOLDER is not None and _HOLDER is not owner:
        _HOLDER.forget()
    _HOLDER = owner


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of all batches as tuples of Python values."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def to_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from row tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
