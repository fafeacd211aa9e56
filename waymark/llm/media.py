"""Binary media columns: lossless PNG in, checked PNG out, and a perceptual hash.

A payload is stored as the 8-bit grey samples of a 64 pixel wide PNG. Reading
walks the chunks and tests their checksums, inflates the data and undoes the row
filters with numpy. The feature is a hash of the low-frequency cosine transform.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waymark.llm.common import append_from_text

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Compressed bytes in one IDAT chunk at most.
CHUNK = 1 << 16
_SIDE, _LOW = 32, 8
_COSINES = np.cos(np.pi * (2 * np.arange(_SIDE) + 1)[None, :] * np.arange(_LOW)[:, None] / (2 * _SIDE))


class BadPng(ValueError):
    """The bytes aren't a whole, undamaged PNG of the supported kind."""


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    """Zeros up to a positive multiple of ``unit``."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(rows: np.ndarray, level: int = 6) -> bytes:
    """8-bit grey PNG of a two-dimensional uint8 array; each row takes the filter (none, left, up) of least residue."""
    height, width = rows.shape
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    choices = np.stack([rows, left, up])
    residue = np.abs(choices.view(np.int8).astype(np.int16)).sum(axis=2)
    best = residue.argmin(axis=0)
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = choices[best, np.arange(height)]
    data = zlib.compress(lines.tobytes(), level)
    parts = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", header), *(_chunk(b"IDAT", p) for p in parts), _chunk(b"IEND", b"")])


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo the five row filters of one-byte pixels; column 0 holds the filter types."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise BadPng(f"unknown row filter {int(kinds.max())}")
    sideways = kinds == 1
    rows[sideways] = np.cumsum(rows[sideways], axis=1, dtype=np.uint8)
    at, height = 0, len(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    while at < height:
        kind = kinds[at]
        if kind < 2:
            above = rows[at]
            at += 1
        elif kind == 2:  # a run of these is one running sum down the columns
            end = at + 1
            while end < height and kinds[end] == 2:
                end += 1
            rows[at] += above
            rows[at:end] = np.cumsum(rows[at:end], axis=0, dtype=np.uint8)
            above = rows[end - 1]
            at = end
        else:
            a = c = 0
            row, over = rows[at].tolist(), above.tolist()
            for x, b in enumerate(over):
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                a = row[x] = (row[x] + guess) & 255
                c = b
            rows[at] = row
            above = rows[at]
            at += 1
    return rows


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey, non-interlaced PNG; raises BadPng on any damage."""
    if data[:8] != SIGNATURE:
        raise BadPng("no PNG signature")
    at, header, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise BadPng("cut off inside a chunk")
        length, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + length]
        stored = data[at + 8 + length : at + 12 + length]
        if len(stored) < 4 or zlib.crc32(kind + body) != int.from_bytes(stored, "big"):
            raise BadPng(f"checksum of chunk {kind!r} at byte {at}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise BadPng(f"unknown critical chunk {kind!r}")
        at += 12 + length
    if header is None or not ended:
        raise BadPng("IHDR or IEND is missing")
    width, height, depth, colour, *rest = header
    if (depth, colour, *rest) != (8, 0, 0, 0, 0):
        raise BadPng("not 8-bit grey without interlace")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise BadPng(str(e)) from e
    if len(raw) != height * (width + 1):
        raise BadPng("wrong amount of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def _shrunk(length: int) -> np.ndarray:
    """Averages ``length`` cells into _SIDE cells; fewer cells are repeated."""
    edges = np.arange(_SIDE + 1) * length / _SIDE
    cells = np.arange(length)
    part = np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None)
    return part / part.sum(axis=1, keepdims=True)


_WIDE = _shrunk(WIDTH)


def cosine_hash(rows: np.ndarray) -> str:
    """64 bits as 16 hex digits: which of the 8 x 8 lowest cosine coefficients exceed their median."""
    height, width = rows.shape
    across = _WIDE if width == WIDTH else _shrunk(width)
    wide = rows.astype(np.float64) @ across.T
    if height > 4 * _SIDE:  # first sum whole rows, so that tall images need no tall matrix
        edges = np.arange(_SIDE) * height // _SIDE
        small = np.add.reduceat(wide, edges, axis=0) / np.diff([*edges, height])[:, None]
    else:
        small = _shrunk(height) @ wide
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def store_as_png(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append n_bytes (UTF-8) and media (binary PNG of the padded bytes); null is the empty text, 64 zero bytes."""
    fields = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def make():
        def work(texts: list) -> list[pa.Array]:
            raw = [(t or "").encode() for t in texts]
            media = [encode_png(np.frombuffer(pad(b), np.uint8).reshape(-1, WIDTH)) for b in raw]
            return [pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())]

        return work

    return append_from_text(df, text, fields, make, keep)


def read_png(df: DataFrame, media: str = "media", keep: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Append what a PNG column holds: payload_bytes, payload_sha256, tail_crc32 (last 64 bytes), media_bytes, media_sha256, feature.

    A damaged file raises BadPng, or gives nulls for the payload columns and the
    feature with ``strict=False``; a null gives nulls throughout.
    """
    fields = T.StructType(
        [
            T.StructField("payload_bytes", T.LongType()),
            T.StructField("payload_sha256", T.StringType()),
            T.StructField("tail_crc32", T.LongType()),
            T.StructField("media_bytes", T.LongType()),
            T.StructField("media_sha256", T.StringType()),
            T.StructField("feature", T.StringType()),
        ]
    )

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        stored = (len(data), hashlib.sha256(data).hexdigest())
        try:
            rows = decode_png(data)
        except BadPng:
            if strict:
                raise
            return (None, None, None, *stored, None)
        payload = rows.tobytes()
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, cosine_hash(rows))

    def make():
        def work(values: list) -> list[pa.Array]:
            columns = list(zip(*map(one, values), strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]

        return work

    return append_from_text(df, media, fields, make, keep)
