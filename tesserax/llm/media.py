"""Media columns: lossless PNG in a binary column, read back and hashed.

The writer packs bytes as 8-bit grey samples, filters each scanline, and puts the zlib
stream into checksummed chunks. The reader tests the signature, each chunk's CRC and the
stream's Adler sum, and undoes all five scanline filters with numpy. The feature is a
perceptual hash: the low frequencies of a cosine transform of the picture, against
their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
PAD = b"\xff"
IDAT = 1 << 16
#: Lines that are filtered, compressed and read back at a time.
BAND = 2048
LEVEL = 4
SIDE = 32
LOW = 8
#: Fixed by the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def pad(data: bytes, unit: int = UNIT) -> bytes:
    return bytes(data) + _padding(len(data), unit)


def _padding(size: int, unit: int) -> bytes:
    return PAD * (unit - size % unit if size % unit or not size else 0)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(samples: np.ndarray, above: np.ndarray) -> bytes:
    """Scanlines of a band below the line ``above``: each gets the filter (none, left or up)
    with the smallest sum of absolute differences."""
    left, up = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    up[0] -= above
    options = np.stack([samples, left, up])
    best = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0)
    lines = np.empty((len(samples), samples.shape[1] + 1), dtype=np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = options[best, np.arange(len(samples))]
    return lines.tobytes()


def encode_png(data, unit: int = UNIT) -> bytes:
    """A grey 8-bit PNG, ``unit`` samples wide, of the padded bytes. Beside the bytes and the
    picture itself, one band of lines is held at a time."""
    whole, rest = len(data) // unit, bytes(data[len(data) // unit * unit :])
    last = rest + _padding(len(data), unit)
    height = whole + len(last) // unit
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", unit, height, 8, 0, 0, 0, 0))]
    deflate, above, ready = zlib.compressobj(LEVEL), np.zeros(unit, dtype=np.uint8), bytearray()
    lines = np.frombuffer(data, dtype=np.uint8, count=whole * unit).reshape(whole, unit)
    bands = [lines[at : at + BAND] for at in range(0, whole, BAND)] + ([np.frombuffer(last, dtype=np.uint8).reshape(-1, unit)] if last else [])
    for i, band in enumerate(bands):
        ready += deflate.compress(_filtered(band, above))
        above = band[-1]
        if i == len(bands) - 1:
            ready += deflate.flush()
        while len(ready) >= IDAT or (ready and i == len(bands) - 1):
            parts.append(_chunk(b"IDAT", bytes(ready[:IDAT])))
            del ready[:IDAT]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def write_png(samples: np.ndarray) -> bytes:
    """A grey 8-bit PNG of a (height, width) uint8 array."""
    return encode_png(np.ascontiguousarray(samples).tobytes(), samples.shape[1])


def _average(line: np.ndarray, above: np.ndarray) -> None:
    before = np.zeros(line.shape[1], dtype=np.int64)
    for x in range(len(line)):
        before = (line[x] + (before + above[x]) // 2) & 255
        line[x] = before


def _paeth(line: np.ndarray, above: np.ndarray) -> None:
    zero = np.zeros(line.shape[1], dtype=np.int64)
    a, c = zero, zero
    for x in range(len(line)):
        b = above[x]
        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        near = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
        a, c = (line[x] + near) & 255, b
        line[x] = a


def _unfilter(lines: np.ndarray, above: np.ndarray) -> np.ndarray:
    kinds, out = lines[:, 0], lines[:, 1:].reshape(len(lines), *above.shape).copy()
    for line, kind in zip(out, kinds.tolist(), strict=True):
        if kind == 1:
            np.cumsum(line, axis=0, dtype=np.uint8, out=line)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            wide = line.astype(np.int64)
            (_average if kind == 3 else _paeth)(wide, above.astype(np.int64))
            line[:] = wide
        elif kind:
            raise ValueError(f"unknown filter {kind}")
        above = line
    return out


def open_png(data) -> tuple[int, int, int, Iterator[np.ndarray]]:
    """Height, width, channels, and the picture in bands of lines, each (lines, width, channels).

    Raises ValueError, at the latest with the last band, unless every check holds.
    """
    data = memoryview(data)
    if bytes(data[:8]) != SIGNATURE:
        raise ValueError("not a PNG")

    def chunks():
        at = 8
        while at < len(data):
            if len(data) < at + 12:
                raise ValueError("cut short")
            size, kind = struct.unpack_from(">I4s", data, at)
            body = data[at + 8 : at + 8 + size]
            if len(data) < at + 12 + size or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + size)[0]:
                raise ValueError(f"bad checksum in {kind!r}")
            yield kind, body
            if kind == b"IEND":
                return
            if kind not in (b"IHDR", b"IDAT") and not kind[0] & 32:
                raise ValueError(f"unknown critical chunk {kind!r}")
            at += 12 + size
        raise ValueError("unsupported or incomplete PNG")

    every = chunks()
    first, body = next(every)
    head = struct.unpack(">IIBBBBB", body) if first == b"IHDR" and len(body) == 13 else None
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[4:] != (0, 0, 0):
        raise ValueError("unsupported or incomplete PNG")
    width, height, channels = head[0], head[1], CHANNELS[head[3]]
    size = width * channels + 1

    def bands():
        inflate, ready, lines, above = zlib.decompressobj(), bytearray(), 0, np.zeros((width, channels), dtype=np.uint8)
        try:
            for kind, body in every:
                if kind != b"IDAT":
                    continue
                more = inflate.decompress(body, BAND * size)
                while more:
                    ready += more
                    n = len(ready) // size
                    lines += n
                    if lines > height:
                        raise ValueError("wrong number of samples")
                    if n:
                        band = _unfilter(np.frombuffer(bytes(ready[: n * size]), dtype=np.uint8).reshape(n, size), above)
                        del ready[: n * size]
                        above = band[-1]
                        yield band
                    more = inflate.decompress(inflate.unconsumed_tail, BAND * size) if inflate.unconsumed_tail else b""
        except zlib.error as e:
            raise ValueError(str(e)) from e
        if lines != height or ready or not inflate.eof:
            raise ValueError("wrong number of samples")

    return height, width, channels, bands()


def read_png(data) -> np.ndarray:
    """(height, width, channels) uint8; raises ValueError unless every check holds."""
    height, width, channels, bands = open_png(data)
    return np.concatenate([np.zeros((0, width, channels), dtype=np.uint8), *bands])


def _shrink(image: np.ndarray, side: int, axis: int) -> np.ndarray:
    n = image.shape[axis]
    starts = np.arange(side) * n // side
    if n < side:
        return image.take(starts, axis=axis)
    sizes = np.diff(np.append(starts, n))
    return np.add.reduceat(image, starts, axis=axis) / (sizes[:, None] if axis == 0 else sizes[None, :])


_FREQ = np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE))


def perceptual_hash(image: np.ndarray) -> bytes:
    """64 bits: which low frequencies of the cosine transform exceed their median."""
    small = Thumbnail(*image.shape[:2])
    small.add(image)
    return small.hash()


class Thumbnail:
    """Averages of a picture that comes in bands, and its perceptual hash."""

    def __init__(self, height: int, width: int):
        self.starts, self.height, self.at = np.arange(SIDE) * height // SIDE, height, 0
        self.rows = np.zeros((SIDE, width))

    def add(self, band: np.ndarray) -> None:
        grey = band.reshape(*band.shape[:2], -1).mean(axis=2, dtype=np.float64)
        if self.height < SIDE:  # lines repeat
            for i, line in enumerate(self.starts.tolist()):
                if self.at <= line < self.at + len(grey):
                    self.rows[i] = grey[line - self.at]
        else:
            groups = np.searchsorted(self.starts, np.arange(self.at, self.at + len(grey)), side="right") - 1
            first = np.flatnonzero(np.diff(groups, prepend=-1))
            self.rows[groups[first]] += np.add.reduceat(grey, first, axis=0)
        self.at += len(grey)

    def hash(self) -> bytes:
        sizes = np.diff(np.append(self.starts, self.height)) if self.height >= SIDE else np.ones(SIDE)
        small = _shrink(self.rows / sizes[:, None], SIDE, 1)
        low = np.round(_FREQ @ small @ _FREQ.T, 6).ravel()
        return np.packbits(low > np.median(low[1:])).tobytes()


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, padded and stored as a PNG column.

    A null text counts as empty and still has one line of padding; repeated rows repeat; a
    null id is kept; an empty table gives an empty result. Other columns are not read.
    """

    def run(batches):
        for b in batches:
            # One row at a time, from the column's own memory: texts can be very long.
            for i in range(b.num_rows):
                text = b.column(1)[i].as_buffer() or b""
                row = [b.column(0).slice(i, 1), pa.array([len(text)], pa.int64()), pa.array([encode_png(memoryview(text), unit)], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["doc_id", "n_bytes", "media"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame, payload: bool = False) -> DataFrame:
    """What the stored bytes hold: sizes, checksums and the perceptual hash, per row.

    ``phash`` is the hash as a binary column. A row whose bytes are null or fail a check has
    the reason in ``error`` and null features. ``payload=True`` adds the bytes themselves.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "phash", "error"] + ["payload"] * payload
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()] + [pa.binary()] * payload

    def features(data):
        if data is None:
            return (None, None, None, None, None, None, "null") + (None,) * payload
        kept = (len(data), hashlib.sha256(data).hexdigest())
        whole, size, tail, back = hashlib.sha256(), 0, b"", []
        try:
            height, width, _, bands = open_png(data)
            small = Thumbnail(height, width)
            for band in bands:
                piece = band.tobytes()
                whole.update(piece)
                size, tail = size + len(piece), (tail + piece[-32:])[-32:]
                small.add(band)
                if payload:
                    back.append(piece)
        except ValueError as e:
            return (None, None, None, *kept, None, str(e)) + (None,) * payload
        found = (size, whole.hexdigest(), zlib.crc32(tail), *kept, small.hash(), None)
        return found + (b"".join(back),) * payload

    def run(batches):
        for b in batches:
            rows = [features(m.as_buffer()) for m in b.column(2)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds[2:]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds[2:], strict=True))], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, phash binary, error string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema + ", payload binary" * payload)
