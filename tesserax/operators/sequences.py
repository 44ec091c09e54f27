"""Byte sequences as chunks (doc, seq, chunk), positions by cumulative weight, and blobs.

Offsets and sizes are bytes; values are binary columns. Text goes in as ``encode(text)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def encode(text: Column) -> Column:
    """The bytes of a text; none for null."""
    return F.coalesce(text.cast("binary"), _bytes(b""))


def _bytes(new: bytes | str) -> Column:
    return F.lit(bytearray(new.encode() if isinstance(new, str) else new))


def joined(parts: Column) -> Column:
    """The concatenation of an array of binary values."""
    return F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x)), ""))


def chunks(docs: DataFrame, doc: str, value: str, size: int) -> DataFrame:
    """Maximal chunks of ``size`` bytes, the last one shorter; an empty value has none."""
    n = F.ceil(F.octet_length(value) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(value), i * size + 1, F.lit(size)))
    return docs.where(F.octet_length(value) > 0).select(F.col(doc).alias("doc"), F.posexplode(parts).alias("seq", "chunk"))


def placed(chunked: DataFrame) -> DataFrame:
    """Add start and end of each chunk in its document; a document's chunks are one window."""
    along = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return chunked.withColumn("end", F.sum(F.octet_length("chunk").cast("long")).over(along)).withColumn("start", F.col("end") - F.octet_length("chunk"))


def locate(chunked: DataFrame, offset: Column) -> DataFrame:
    """The chunk that holds an offset, and where in it; no row at or past the end."""
    at = placed(chunked).where((F.col("start") <= offset) & (offset < F.col("end")))
    return at.withColumn("inner", (offset - F.col("start")).cast("long"))


def read_at(chunked: DataFrame, offset: int, length: int, size: int | None = None) -> DataFrame:
    """(doc, bytes): up to ``length`` bytes from ``offset``. At the end nothing is read; a
    document that ends before the offset is out of bounds and has no row.

    With ``size``, chunks are maximal ones of that size: their numbers are their places, so
    that only those that are read, and the one before the offset, leave the scan.
    """
    if size is None:
        rows = placed(chunked).withColumn("total", F.sum(F.octet_length("chunk")).over(Window.partitionBy("doc"))).where(F.col("total") >= offset)
    else:
        near = chunked.where(F.col("seq").between(max(offset - 1, 0) // size, max(offset + length - 1, 0) // size))
        rows = near.withColumn("start", F.col("seq").cast("long") * size).withColumn("end", F.col("start") + F.octet_length("chunk")).where(F.col("end") >= offset)
    lo = F.greatest(F.lit(offset) - F.col("start"), F.lit(0))
    hi = F.least(F.lit(offset + length) - F.col("start"), F.octet_length("chunk").cast("long"))
    cut = F.when(hi > lo, F.substring(F.col("chunk"), (lo + 1).cast("int"), (hi - lo).cast("int"))).otherwise(_bytes(b""))
    return rows.groupBy("doc").agg(joined(F.transform(F.sort_array(F.collect_list(F.struct("seq", cut.alias("c")))), lambda x: x["c"])).alias("bytes"))


def insert(value: Column, offset: int, new: bytes | str) -> Column:
    return F.overlay(value, _bytes(new), F.lit(offset + 1), F.lit(0))


def erase(value: Column, offset: int, length: int) -> Column:
    return F.overlay(value, _bytes(b""), F.lit(offset + 1), F.lit(length))


def replace(value: Column, offset: int, length: int, new: bytes | str) -> Column:
    return F.overlay(value, _bytes(new), F.lit(offset + 1), F.lit(length))


def insert_split(chunked: DataFrame, offset: int, new: bytes | str) -> DataFrame:
    """Insert at an offset of every document; a chunk that it falls into is split."""
    rows = placed(chunked).withColumn("total", F.sum(F.octet_length("chunk")).over(Window.partitionBy("doc")))
    inner = (F.lit(offset) - F.col("start")).cast("int")
    inside = (F.col("start") <= offset) & (F.lit(offset) < F.col("end"))
    last = (F.col("end") == F.col("total")) & (F.col("total") == offset)
    piece = lambda c, p: F.struct(F.lit(p).alias("part"), c.alias("chunk"))
    split = F.array(piece(F.substring(F.col("chunk"), F.lit(1), inner), 0), piece(_bytes(new), 1), piece(F.substring(F.col("chunk"), inner + 1, F.octet_length("chunk")), 2))
    out = F.when(inside, F.filter(split, lambda x: F.octet_length(x["chunk"]) > 0)).when(last, F.array(piece(F.col("chunk"), 0), piece(_bytes(new), 1))).otherwise(F.array(piece(F.col("chunk"), 0)))
    flat = rows.select("doc", "seq", F.explode(out).alias("x")).select("doc", "seq", "x.part", "x.chunk")
    return flat.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("seq", "part")) - 1).alias("seq"), "chunk")


def whole(chunked: DataFrame) -> DataFrame:
    """(doc, bytes): the documents that chunks make up."""
    return chunked.groupBy("doc").agg(joined(F.transform(F.sort_array(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"])).alias("bytes"))


def remove_entry(chunked: DataFrame, offset: int) -> DataFrame:
    """Drop the chunk that holds an offset; nothing changes past the end."""
    return placed(chunked).where(~((F.col("start") <= offset) & (F.lit(offset) < F.col("end")))).select("doc", "seq", "chunk")


def write_at(value: Column, offset: int, new: bytes | str) -> Column:
    """Overwrite in place and past the end; null where the offset would leave a hole."""
    return F.when(F.octet_length(value) >= offset, F.overlay(value, _bytes(new), F.lit(offset + 1)))


def truncate(value: Column, size: int) -> Column:
    """Shrink to a size; null where that would be growth."""
    return F.when(F.octet_length(value) >= size, F.substring(value, 1, size))


def truncate_by(value: Column, length: int) -> Column:
    """Shrink by a number of bytes; null where there are fewer."""
    return F.when(F.octet_length(value) >= length, F.substring(value, F.lit(1), F.octet_length(value) - length))


def resize(value: Column, size: int, fill: bytes | str = " ") -> Column:
    return F.rpad(value, F.lit(size), _bytes(fill))


def extend(value: Column, by: int, fill: bytes | str = " ") -> Column:
    return F.concat(value, _bytes((fill.encode() if isinstance(fill, str) else fill) * by))


def clear(chunked: DataFrame, doomed: Column) -> DataFrame:
    """The chunks that are left when all of the documents under a condition on ``doc`` go."""
    return chunked.where(~doomed)


def append_chunk(chunked: DataFrame, new: bytes | str) -> DataFrame:
    """Register one more chunk at the end of every document."""
    last = chunked.groupBy("doc").agg((F.max("seq") + 1).alias("seq"))
    return chunked.select("doc", "seq", "chunk").union(last.select("doc", "seq", _bytes(new).alias("chunk")))


def drop_last(chunked: DataFrame, n: int = 1) -> DataFrame:
    """Drop the last ``n`` chunks of every document."""
    last = chunked.groupBy("doc").agg(F.max("seq").alias("_last"))
    return chunked.join(last, "doc").where(F.col("seq") <= F.col("_last") - n).select("doc", "seq", "chunk")


def seek(size: Column, offset: int) -> Column:
    """Where a cursor comes to stand: the offset, or the end if that lies before it."""
    return F.least(size.cast("long"), F.lit(offset).cast("long"))


def read_next(value: Column, cursor: Column, length: int) -> Column:
    """(bytes, cursor): what a cursor reads, and where it stands then."""
    got = F.substring(value, (cursor + 1).cast("int"), F.lit(length))
    return F.struct(got.alias("bytes"), (cursor + F.octet_length(got)).alias("cursor"))


def write_next(value: Column, cursor: Column, new: bytes | str) -> Column:
    """(bytes, cursor): the value overwritten and extended at a cursor, which moves behind it."""
    data = _bytes(new)
    return F.struct(F.overlay(value, data, (cursor + 1).cast("int")).alias("bytes"), (cursor + F.octet_length(data)).alias("cursor"))
