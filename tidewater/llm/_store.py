"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of this session's tables that haven't been removed, oldest first.
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where it is unset a temporary one is made in local mode; on a cluster, whose machines
    don't share one, that is an error.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def stored(rows: DataFrame) -> DataFrame:
    """Write rows as Parquet to the shared folder and read them back.

    Cuts the lineage: later steps survive lost executors without computing the
    rows again, and every reader sees the same rows.
    """
    path = f"{shared_folder(rows.sparkSession)}/tidewater-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    _tables.append(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _tables.remove(path)


def remove_tables(spark: SparkSession) -> None:
    """Remove all tables that operators have stored; call it once their results are written."""
    _remove(spark, list(_tables))


def mark() -> int:
    """A place among the stored tables, for prune."""
    return len(_tables)


def prune(spark: SparkSession, since: int) -> None:
    """Remove what was stored since a mark, but for the last table: it holds the result."""
    _remove(spark, _tables[since:-1])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what is stored inside the block at its end, but for the last table."""
    begin = mark()
    yield
    prune(spark, begin)
