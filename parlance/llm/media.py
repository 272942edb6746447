"""Media columns: bytes as greyscale PNG images, read back, and perceptual hashes.

The encoder writes rows with filter none, sub or up, whichever has the least sum of absolute
differences; the decoder tests the signature, each chunk's length and CRC and the header, and
undoes all five filters.  The hash is the sign pattern of the 8 x 8 lowest frequencies of a
cosine transform over a 32 x 32 reduction of the image, against their median.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import filled, fresh, modest_batches, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a row; payloads are padded to a positive multiple of it.
ROW = 576
SIDE = 32
_k = np.arange(SIDE)
_DCT = np.cos(np.pi * (2 * _k[None, :] + 1) * _k[:, None] / (2 * SIDE))[:8]


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % ROW if data else ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes, width: int = ROW, level: int = 6) -> bytes:
    """A PNG of 8-bit grey samples; payload is a positive multiple of width."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub, up = x.copy(), x.copy()
    sub[:, 1:] -= x[:, :-1]
    up[1:] -= x[:-1]
    forms = np.stack([x, sub, up])
    kind = np.abs(forms.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    rows = np.empty((len(x), width + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = forms[kind, np.arange(len(x))]
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(x), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def read_png(media: bytes) -> np.ndarray:
    """Samples of an 8-bit, non-interlaced PNG, (height, bytes of a row).  Raises ValueError on
    a bad signature, a cut file, a failed checksum, or a form it doesn't read."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, head = 8, [], None
    while True:
        if at + 12 > len(media):
            raise ValueError("cut short")
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if at + 12 + size > len(media) or struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        elif not kind[0] & 32 and kind != b"PLTE":
            raise ValueError(f"unknown critical chunk {kind!r}")
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or any(head[4:]):
        raise ValueError("unsupported header")
    bpp = {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    width = head[0] * bpp
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(head[1], width + 1)
    return unfilter(rows[:, 0], rows[:, 1:], bpp)


def unfilter(kinds: np.ndarray, rows: np.ndarray, bpp: int = 1) -> np.ndarray:
    out = np.array(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for i, kind in enumerate(kinds.tolist()):
        row = out[i]
        if kind == 1:
            np.cumsum(rows[i].reshape(-1, bpp), axis=0, dtype=np.uint8, out=row.reshape(-1, bpp))
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            left, corner = np.zeros(bpp, np.int32), np.zeros(bpp, np.int32)
            for j in range(0, len(row), bpp):
                b = above[j : j + bpp].astype(np.int32)
                if kind == 3:
                    guess = (left + b) >> 1
                else:
                    pa, pb, pc = abs(b - corner), abs(left - corner), abs(left + b - 2 * corner)
                    guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, b, corner))
                left, corner = (row[j : j + bpp] + guess) & 255, b
                row[j : j + bpp] = left
        elif kind:
            raise ValueError(f"filter {kind}")
        above = row
    return out


def _reduced(x: np.ndarray, n: int) -> np.ndarray:
    """Means of n nearly equal bands of rows; with fewer rows than bands the nearest row."""
    if len(x) < n:
        return x[np.arange(n) * len(x) // n].astype(np.float64)
    edges = np.arange(n) * len(x) // n
    sizes = np.diff(np.append(edges, len(x)))
    return np.add.reduceat(x, edges, axis=0, dtype=np.float64) / sizes[:, None]


def dct_hash(image: np.ndarray) -> str:
    """16 hex digits: bit is 1 where a low frequency exceeds the median of the 64.  Rows of a very
    low image are folded into squares first."""
    if len(image) < SIDE and image.shape[1] == ROW:
        image = image.reshape(-1, 24)
    grid = _reduced(_reduced(image, SIDE).T, SIDE).T
    low = (_DCT @ grid @ _DCT.T).ravel()
    bits = np.round(low, 6) > np.round(np.median(low), 6)
    return np.packbits(bits).tobytes().hex()


def to_png():
    """Column function: bytes -> PNG of the padded bytes; null becomes the image of no bytes."""

    @F.pandas_udf("binary")
    def write(data: pd.Series) -> pd.Series:
        return pd.Series([write_png(pad(x or b"")) for x in data], dtype=object)

    return write


def from_png():
    """Column function: PNG -> its samples and hash.  Null stays null; a damaged file raises."""

    @F.pandas_udf("payload binary, hash string")
    def read(media: pd.Series) -> pd.DataFrame:
        images = [None if x is None else read_png(x) for x in media]
        return pd.DataFrame({"payload": [None if x is None else x.tobytes() for x in images], "hash": [None if x is None else dct_hash(x) for x in images]}, dtype=object)

    return read


def media_column(docs: DataFrame, *, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a binary column of PNG images of its texts' UTF-8 bytes (null: no bytes).  Each
    row stands alone: no shuffle, repeated rows give repeated images, an empty table an empty one."""
    modest_batches(docs.sparkSession)
    return docs.withColumn(media, to_png()(filled(F.col(text)).cast("binary")))


def media_features(rows: DataFrame, *, media: str = "media", payload: str = "payload", feature: str = "feature") -> DataFrame:
    """rows with the bytes read back from its images, padding included, and the images' hashes."""
    made = fresh(rows, "read")
    return rows.withColumn(made, from_png()(media)).withColumns({payload: F.col(made)["payload"], feature: F.col(made)["hash"]}).drop(made)


def op10_media(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(filled(F.col("text"))).cast("bigint").alias("n_bytes"))
    rows = media_features(media_column(docs))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
