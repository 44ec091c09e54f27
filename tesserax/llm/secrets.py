"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed. The ledger holds what each blob showed
under each rule version; only pairs of blob and rule version that it lacks are scanned, and
findings are joined back to all paths that hold the blob.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import shared_path

#: Kinds in their order, with the group whose length counts and the least length.
RULES: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 64),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
BASE = ("assign", "access", "hex")
MASK = "[SECRET]"
SPAN = "array<struct<kind: string, s: long, e: long>>"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


class Scanner:
    """All findings of a text, by start, then in the rules' order; offsets in code points.

    A gate skips a rule only where it can't match: without its fixed letters, or for plain
    runs by looking for a run of the least length.
    """

    def __init__(self, rules=RULES):
        self.rules = []
        for order, (kind, pattern, group, least) in enumerate(rules):
            plain = re.fullmatch(r"(\[[^\]]+\])\+", pattern)
            # Of a run of one class, leftmost and longest, only those of the least length stay.
            found = re.compile(f"{plain[1]}{{{least},}}" if plain else pattern, re.ASCII)
            self.rules.append((order, kind, found, group, least))

    @staticmethod
    def _may(kind: str, text: str, low: str) -> bool:
        if kind == "assign":
            return "passw" in low or "secret" in low or "token" in low or "apikey" in low or "api_key" in low
        return {"access": "AKIA", "pem": "-----BEGIN ", "jwt": "eyJ"}.get(kind, "") in text

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        low, out = text.lower(), []
        for order, kind, found, group, least in self.rules:
            if self._may(kind, text, low):
                out += [(m.start(), order, kind, m.end()) for m in found.finditer(text) if len(m[group]) >= least]
        return [(kind, s, e) for s, _, kind, e in sorted(out)]


def _blob(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)


def scan_ledger(spark: SparkSession, docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(doc_id, blob, found), one row per row of ``docs``: the findings of its whole text.

    ``ledger`` is the path of the ledger's table; missing, a new one is begun. Blobs that
    it has under this rule version are not scanned again. A null text is the empty blob; a
    null id is kept; repeated rows repeat; an empty table gives an empty result; other
    columns are not read.
    """
    version, path = rule_version(rules), ledger or shared_path(spark, "ledger")
    paths = docs.select(F.col(id_col).cast("long").alias("doc_id"), _blob(text_col).alias("blob"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    # One path stands for each blob; texts move once, dealt by blob and path.
    chosen = paths.groupBy("blob").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("k"))
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    if home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(home):
        seen = spark.read.schema(f"blob string, found {SPAN}, version string").parquet(path)
        chosen = chosen.join(seen.where(F.col("version") == version).select("blob"), "blob", "left_anti")
    unseen = paths.select("blob", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "t").join(chosen, ["blob", "k"], "left_semi").select("blob", "t")
    span = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64())]))

    def run(batches):
        scanner = Scanner(rules)
        for b in batches:
            found = [[{"kind": k, "s": s, "e": e} for k, s, e in scanner.scan(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, span)], names=["blob", "found"])

    unseen.mapInArrow(run, f"blob string, found {SPAN}").withColumn("version", F.lit(version)).write.mode("append").parquet(path)
    now = spark.read.schema(f"blob string, found {SPAN}, version string").parquet(path)
    # Clean blobs need no row; a path repeated with the same blob may have been scanned twice.
    shown = now.where((F.col("version") == version) & (F.size("found") > 0)).groupBy("blob").agg(F.first("found").alias("found"))
    return paths.select("doc_id", "blob").join(shown, "blob", "left").select("doc_id", "blob", F.coalesce("found", F.array().cast(SPAN)).alias("found"))


def spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The findings as counts, a hash of the base spans and a list of all."""
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *(n(k).alias(f"n_{k}") for k in BASE), F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("found")).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", mask: str = MASK) -> DataFrame:
    """All rows and columns of ``docs``, each finding in the text replaced by ``mask``.

    Overlapping findings are replaced as one. Texts without findings, nulls too, stay as they are.
    """
    found = scan_ledger(spark, docs, ledger, id_col, text_col).where(F.size("found") > 0).select("blob", "found").groupBy("blob").agg(F.first("found").alias("_found"))
    row = docs.select(_blob(text_col).alias("blob"), F.struct(*docs.columns).alias("row")).join(found, "blob", "left")
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        for b in batches:
            columns = list(b.columns)
            texts, founds = columns[at].to_pylist(), columns[-1].to_pylist()
            if any(founds):
                columns[at] = pa.array([masked(t, f, mask) if f else t for t, f in zip(texts, founds, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns[:-1], names=names)

    # Names may clash, so columns go by their places.
    flat = row.select(*(F.col("row").getField(c).alias(f"_{i}") for i, c in enumerate(names)), "_found")
    return flat.mapInArrow(run, docs.schema)


def masked(text: str, found: list[dict], mask: str = MASK) -> str:
    """The text with findings, which come by start, replaced; overlapping ones as one."""
    out, end, open_at = [], 0, None
    for x in found:
        if open_at is not None and x["s"] < end:
            end = max(end, x["e"])
            continue
        out.append(text[end : x["s"]] if open_at is not None else text[: x["s"]])
        open_at, end = x["s"], x["e"]
    return mask.join([*out, text[end:]])
