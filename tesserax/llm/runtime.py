"""What the operators share: the cluster's shared folder, and shipping code to workers."""

from __future__ import annotations

import getpass
import sys
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions of this subpackage travel by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__package__])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the
    cluster sets it. Only a local session, whose tasks run on this machine, gets one here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file:/tmp/checkpoints/{getpass.getuser()}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tesserax/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    A lost executor then costs a re-read of a file and not the work before it.
    """
    path = shared_path(spark, name)
    if _open:
        _open[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The tables written by the calls of ``finished`` that are under way.
_open: list[list[str]] = []


def finished(spark: SparkSession, plan: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """A plan's written result and its path. The tables that were written on the way to it go:
    what follows reads the result alone, which goes in turn if it is on the way to another."""
    _open.append([])
    try:
        result = materialize(spark, plan(), name)
    finally:
        made = _open.pop()
    for path in made[:-1]:
        delete(spark, path)
    if _open:
        _open[-1].append(made[-1])
    return result, made[-1]


def delete(spark: SparkSession, path: str) -> None:
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(home, True)


def sweep(spark: SparkSession) -> None:
    """Delete this application's tables in the shared folder, once their results are written."""
    delete(spark, f"{shared_dir(spark)}/tesserax/{spark.sparkContext.applicationId}")
