"""Ending lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress
from functools import partial

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, Callable[[], bool]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. In local mode a folder of the driver's serves where none is named; on
    a cluster that is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandline-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends if it wasn't before."""
    path = f"{shared_folder(spark)}/strandline-{name}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_remove_all)
    _folders[path] = remover(spark, path)
    return path


def remover(spark: SparkSession, path: str) -> Callable[[], bool]:
    """What removes a folder, in any file system."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return partial(where.getFileSystem(context._jsc.hadoopConfiguration()).delete, where, True)


def _remove_all() -> None:
    while _folders:
        with suppress(Exception):  # the store or the JVM may be gone by now
            _folders.popitem()[1]()


def remove(path: str) -> None:
    """Remove a folder made by ``new_folder``."""
    _folders.pop(path)()


def ended(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there, and lost executors cost nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables made by ``ended`` that no later action reads."""
    for table in tables:
        remove(table._stored)
