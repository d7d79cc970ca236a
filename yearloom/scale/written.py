"""Cut lineage with tables written to the cluster's shared checkpoint folder.

A written Parquet table keeps column pruning, filter pushdown and row counts in
its footers, and survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import TypeVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_WRITTEN: list[str] = []
# What was found out about tables that are in use, by the table itself.
_FACTS: WeakKeyDictionary[DataFrame, dict] = WeakKeyDictionary()

Fact = TypeVar("Fact")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder; on
    a cluster a machine-local folder would not be readable by other executors.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = context.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="yearloom-")
        root = _LOCAL_ROOTS[app]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and return a DataFrame that scans the written files."""
    spark = df.sparkSession
    path = "/".join(
        [checkpoint_root(spark).rstrip("/"), "yearloom", spark.sparkContext.applicationId, f"{label}-{uuid.uuid4().hex}"]
    )
    df.write.parquet(path)
    _WRITTEN.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    _FACTS[table] = {}
    return table


def remembered(table: DataFrame, name: Hashable, find: Callable[[], Fact]) -> Fact:
    """``find()``, asked once for a table that ``materialise`` returned, since its files never change.

    Any other DataFrame, also one derived from such a table, is asked each time.
    """
    facts = _FACTS.get(table)
    if facts is None:
        return find()
    if name not in facts:
        facts[name] = find()
    return facts[name]


def row_count(table: DataFrame) -> int:
    return remembered(table, "rows", table.count)


def written_so_far() -> int:
    """A mark for ``release``."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0) -> int:
    """Deletes what ``materialise`` wrote after the mark, once its readers are done; returns how many tables.

    Marks count all tables of the application, so runs that release what they
    wrote go one after the other.  What was remembered of any table is
    forgotten, as it may name one of the deleted tables.
    """
    for facts in _FACTS.values():
        facts.clear()
    paths = _WRITTEN[since:]
    del _WRITTEN[since:]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)
