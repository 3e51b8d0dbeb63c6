"""Small helpers over the session's file system and its shared checkpoint folder."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, where: str) -> bool:
    path, fs = _path(spark, where)
    return fs.exists(path)


def make_dirs(spark: SparkSession, where: str) -> None:
    path, fs = _path(spark, where)
    fs.mkdirs(path)


def children(spark: SparkSession, where: str) -> list[str]:
    """Names directly below a folder; none when the folder is missing."""
    path, fs = _path(spark, where)
    if not fs.exists(path):
        return []
    return [s.getPath().getName() for s in fs.listStatus(path)]


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; the user's setting is never changed.

    Executors and driver of a cluster share no local disk, so without that
    setting only a session inside one process gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a shared folder; {master} has no common local disk")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    """One temporary folder for this process, gone when it ends."""
    made = tempfile.mkdtemp(prefix="tidewell-checkpoints-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def _own_tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Remove what ``cut_lineage`` wrote for this application; call it once its results are written."""
    path, fs = _path(spark, _own_tables(spark))
    fs.delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame once to the shared folder and go on from that table.

    Computed once, kept when executors are lost, and readers still take only
    the columns they need.  ``drop_tables`` removes the table at the end.
    """
    where = f"{_own_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(where)
    table = df.sparkSession.read.schema(df.schema).parquet(where)
    table._tidewell_table = where
    return table


def drop_table(table: DataFrame) -> None:
    """Remove what one ``cut_lineage`` wrote, given the frame it returned, once no frame will read it again."""
    path, fs = _path(table.sparkSession, table._tidewell_table)
    fs.delete(path, True)


def resolve_checkpoint(
    keys: Sequence[str],
    default_name: str,
    base_dir: str | None = None,
    settings: Mapping[str, str] | None = None,
    spark: SparkSession | None = None,
) -> str:
    """The first non-blank setting wins, else ``default_name`` below the base folder.

    The base folder is the one given, else the session's shared folder.
    """
    found = os.environ if settings is None else settings
    for key in keys:
        value = (found.get(key) or "").strip()
        if value:
            return value
    if base_dir is None:
        if spark is None:
            raise ValueError("a checkpoint needs a setting, a base folder or a session")
        base_dir = shared_dir(spark)
    return f"{base_dir.rstrip('/')}/{default_name}"
