"""Sorted runs as Parquet folders with a manifest.

A run is written once, in key order, with unique keys, and never changed. Its manifest has
its counts, bounds and the fingerprint of its schema, and is checked on every read.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs

SCHEMA = "k string, v string, flag int, lsn long"
VERSION = 1


class RunError(ValueError):
    """A run that breaks a rule: repeated keys, no entries, a manifest that doesn't fit."""


@dataclass(frozen=True)
class Manifest:
    entries: int
    min_lsn: int
    max_lsn: int
    first_key: str
    last_key: str
    tombstones: int
    version: int = VERSION
    schema: str = SCHEMA


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Whole or not at all: written beside its place, then renamed into it."""
    tmp, fs = _fs(spark, path + ".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    place, _ = _fs(spark, path)
    if not fs.rename(tmp, place):
        raise RunError(f"{path} exists")


def _read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        raise RunError(f"no {path}")
    size = fs.getFileStatus(p).getLen()
    stream = fs.open(p)
    raw = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)
    stream.close()
    return bytes(raw).decode()


def write_run(spark: SparkSession, entries: DataFrame, path: str) -> Manifest:
    """Write (k, v, flag, lsn); the folder must be new, keys unique and not null, flags 0 or 1."""
    rows = entries.select("k", F.coalesce("v", F.lit("")).alias("v"), F.col("flag").cast("int").alias("flag"), F.col("lsn").cast("long").alias("lsn"))
    if rows.where("k is null or flag is null or flag not in (0, 1) or lsn is null").limit(1).count():
        raise RunError("null keys, flags or lsns, or unknown flags")
    if rows.groupBy("k").count().where("count > 1").limit(1).count():
        raise RunError("repeated keys")
    rows.repartitionByRange("k").sortWithinPartitions("k").write.mode("errorifexists").parquet(f"{path}/data")
    written = spark.read.schema(SCHEMA).parquet(f"{path}/data")
    s = written.agg(F.count(F.lit(1)), F.min("lsn"), F.max("lsn"), F.min("k"), F.max("k"), F.count_if(F.col("flag") == 1)).first()
    if not s[0]:
        raise RunError("no entries")
    made = Manifest(*s)
    _write_text(spark, f"{path}/manifest.json", json.dumps(asdict(made)))
    return made


def manifest(spark: SparkSession, path: str) -> Manifest:
    found = Manifest(**json.loads(_read_text(spark, f"{path}/manifest.json")))
    if found.version != VERSION or found.schema != SCHEMA:
        raise RunError(f"{path} has another version or schema")
    return found


def read_run(spark: SparkSession, path: str) -> DataFrame:
    manifest(spark, path)
    return spark.read.schema(SCHEMA).parquet(f"{path}/data")


def find(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The entry of a key, a tombstone too; bounds of the manifest and of row groups prune."""
    m = manifest(spark, path)
    hit = read_run(spark, path).where(F.col("k") == key)
    return hit if m.first_key <= key <= m.last_key else hit.limit(0)


def validate(spark: SparkSession, path: str) -> None:
    """Recount a run against its manifest."""
    m = manifest(spark, path)
    n = read_run(spark, path).count()
    if n != m.entries:
        raise RunError(f"{path} has {n} entries, its manifest {m.entries}")


def merge_runs(spark: SparkSession, paths: list[str], out: str, drop_tombstones: bool = False) -> Manifest:
    """Merge runs, newest first, into a new one; see ``operators.runs.merge``."""
    if not paths:
        raise RunError("nothing to merge")
    entries = None
    for i, p in enumerate(paths):
        run = read_run(spark, p).withColumn("run", F.lit(i))
        entries = run if entries is None else entries.unionByName(run)
    return write_run(spark, runs.merge(entries, drop_tombstones).select("k", "v", "flag", "lsn"), out)
