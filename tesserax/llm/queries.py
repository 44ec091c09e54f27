"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html_extract, media, mixing, packing, pii, secrets, simhash, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(spark, _table(spark, sf_dir, "pages"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.train(spark))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _table(spark, sf_dir, "documents")).select("row.doc_id", "domain", "lang", "source", "epoch", "tokens")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_media(media.to_media(_table(spark, sf_dir, "documents")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("phash")).alias("feature"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.entities(spark, _table(spark, sf_dir, "documents")))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_ledger(spark, _table(spark, sf_dir, "documents")))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(spark, docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(spark, docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "margin")


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_url_filters": op2_url_filters,
    "op3_source_mixing": op3_source_mixing,
    "op4_simhash": op4_simhash,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_media": op6_media,
    "op7_personal_data": op7_personal_data,
    "op8_secret_scans": op8_secret_scans,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_toxicity": op10_toxicity,
}
ORACLES = {"op3_source_mixing": mixing.oracle_sql()}
