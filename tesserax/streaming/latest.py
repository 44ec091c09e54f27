"""A stream of versioned entries folded into the latest state of each key.

The rule of ``operators.runs.merge`` (highest lsn, then lowest run) is commutative and
idempotent, so late and repeated entries need no watermark: each batch is merged with the
state before it, and a replayed batch changes nothing. This extends what the engine's
model asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import runs

COLUMNS = ("k", "v", "flag", "lsn", "run")


def fold(stream: DataFrame, state: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the latest entries under ``state``: version folders, each written before the
    next batch begins; ``latest`` reads the newest."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Within a batch first: at most one row per key meets the state.
        new = runs.merge(batch).select(*COLUMNS)
        old = latest(spark, state, number)
        both = new if old is None else old.unionByName(new)
        runs.merge(both).select(*COLUMNS).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return stream.select(*COLUMNS).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark, state: str, before: int | None = None) -> DataFrame | None:
    """The newest complete state, or the newest before a batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [s.getPath() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbers = sorted(n for n in (int(p.getName().partition("=")[2]) for p in done) if before is None or n < before)
    return spark.read.parquet(f"{state}/batch={numbers[-1]}").select(*COLUMNS) if numbers else None


def counts_by_window(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type, with a bound on lateness."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
