"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir), ``docs`` being what the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserax.llm import jaccard, mixing, packing, secrets, toxicity
from tesserax.llm.runtime import delete, finished

#: Of the words that reach the mixing stage, how many its budget has, and how often a
#: document may be taken.
MIX_SHARE_PERCENT = 90
MIX_EPOCHS = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from ``labels`` (see ``toxicity.train``)."""
    model = toxicity.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(spark, docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (5-word shingles, similarity 0.8 or more)."""
    return jaccard.keep_one(spark, docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text by a mask; every document stays.

    The setting ``spark.tesserax.ledger`` may name a ledger that outlives the run, so that
    blobs of earlier runs are not scanned again; without it, each run begins its own.
    """
    masked = secrets.redact(spark, docs, spark.conf.get("spark.tesserax.ledger", None))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken to the target weights; one that is taken in two epochs has two rows."""
    return mixing.mix(spark, docs, MIX_SHARE_PERCENT, MIX_EPOCHS).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences; copies of a text never share one."""
    return packing.pack(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", dedup),
    ("secret_scans", mask_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]
#: SQL has neither the toxicity model nor the fingerprints: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's written result replaces all tables before it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = finished(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if before is not None:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
