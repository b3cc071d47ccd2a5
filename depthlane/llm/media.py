"""Media columns: Netpbm and BMP images as numpy arrays, area resizing, NPY tiles and difference hashes.

`decode` reads P1 to P6 Netpbm (8 and 16 bit) and uncompressed BMP with 1, 4, 8, 24 or 32 bits a pixel. `area_resize`
weighs every source sample by the area it covers, through an integral image. Undecodable or null media give a row with an
error text and null features, never a failed task. An empty table gives no rows.

`text_media` stores whole texts as 8-bit samples: UTF-8, padded with bytes 0 to a positive multiple of 64, as a binary
greymap 64 samples wide. The features come from the bytes read back. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .rows import key, source

WIDTH = 64


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[:2], 2, []
    while len(fields) < (2 if kind in (b"P1", b"P4") else 3):
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            else:
                at += 1
        start = at
        while at < len(data) and data[at : at + 1].isdigit():
            at += 1
        fields.append(int(data[start:at]))
    width, height, top = (*fields, 1)[:3]
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * depth
    if kind in (b"P1", b"P2", b"P3"):
        body = data[at:]
        if b"#" in body:
            body = b"\n".join(line.split(b"#")[0] for line in body.split(b"\n"))
        values = np.frombuffer(b"".join(body.split()), np.uint8) - 48 if kind == b"P1" else np.array(body.split(), dtype=np.int64)
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, (width + 7) // 8 * height, at + 1).reshape(height, -1)
        values = np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if len(values) < n or not 0 < top < 65536:
        raise ValueError("short or malformed Netpbm")
    values = values[:n]
    if kind in (b"P1", b"P4"):
        values = (1 - values) * 255
    out = values.astype(np.uint16 if top > 255 else np.uint8)
    return out.reshape((height, width, 3) if depth == 3 else (height, width))


def _bmp(data: bytes) -> np.ndarray:
    at, header, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("unsupported BMP")
    line = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), at).reshape(abs(height), line)
    if height > 0:
        rows = rows[::-1]
    if bits >= 24:
        return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1].copy()
    index = rows if bits == 8 else np.unpackbits(rows, axis=1) if bits == 1 else np.stack([rows >> 4, rows & 15], axis=2).reshape(abs(height), -1)
    index = index[:, :width]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, 4 * used, 14 + header).reshape(-1, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return palette[index][:, :, 0].copy()
    return palette[index]


def decode(data: bytes) -> np.ndarray:
    """Height x width (grey) or height x width x 3 (red, green, blue) samples."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.astype(np.uint8).tobytes()


def _edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(m + 1) * (n / m)
    whole = np.minimum(at.astype(np.int64), n - 1)
    return whole, at - whole


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas: the integral image, interpolated at the fractional edges of each target sample."""
    planes = image[..., None] if image.ndim == 2 else image
    total = np.zeros((planes.shape[0] + 1, planes.shape[1] + 1, planes.shape[2]))
    np.cumsum(np.cumsum(planes, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])
    r, fr = _edges(planes.shape[0], height)
    c, fc = _edges(planes.shape[1], width)
    rows = total[r] * (1 - fr)[:, None, None] + total[r + 1] * fr[:, None, None]
    grid = rows[:, c] * (1 - fc)[None, :, None] + rows[:, c + 1] * fc[None, :, None]
    sums = grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]
    out = sums / (planes.shape[0] / height * planes.shape[1] / width)
    return out[..., 0] if image.ndim == 2 else out


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """side x side bits, 1 where a sample of the resized grey image is brighter than its left neighbour; hex."""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    small = area_resize(grey, side, side + 1)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-6).tobytes().hex()


def npy_tile(image: np.ndarray, side: int) -> bytes:
    """The image area-resized to side x side, as an NPY file."""
    out = io.BytesIO()
    top = np.iinfo(image.dtype).max if np.issubdtype(image.dtype, np.integer) else 255
    np.save(out, np.clip(np.floor(area_resize(image, side, side) + 0.5), 0, top).astype(image.dtype))
    return out.getvalue()


def _tiles(side: int):
    def run(frames):
        for frame in frames:
            rows = []
            for key, data in zip(frame["key"], frame["media"]):
                try:
                    image = decode(bytes(data))
                    rows.append((key, image.shape[1], image.shape[0], 1 if image.ndim == 2 else 3, npy_tile(image, side), difference_hash(image), None))
                except (ValueError, TypeError, IndexError, struct.error) as error:
                    rows.append((key, None, None, None, None, None, str(error)[:200]))
            yield pd.DataFrame(rows, columns=["key", "width", "height", "channels", "tile", "dhash", "error"]).astype({x: "Int64" for x in ("width", "height", "channels")})

    return run


def tiles(media: DataFrame, key: str, column: str, side: int = 32) -> DataFrame:
    """key, width, height, channels, tile (NPY bytes), dhash, error for each row of a binary column."""
    ship(media.sparkSession)
    source = media.select(F.col(key).cast("string").alias("key"), F.col(column).alias("media"))
    return source.mapInPandas(_tiles(side), "key string, width int, height int, channels int, tile binary, dhash string, error string")


def _text_media(frames):
    for frame in frames:
        rows = []
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
            padded = raw + bytes(max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))
            stored = encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH))
            image = decode(stored)
            payload = image.tobytes()
            tile = npy_tile(image, 16)
            rows.append((key(doc_id), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored),
                         hashlib.sha256(stored).hexdigest(), difference_hash(image), len(tile), hashlib.sha256(tile).hexdigest()))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in TEXT_MEDIA.split(", ")]).astype({"doc_id": "Int64"})


TEXT_MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_bytes long, tile_sha256 string"


def text_media(documents: DataFrame) -> DataFrame:
    ship(documents.sparkSession)
    return source(documents).mapInPandas(_text_media, TEXT_MEDIA)
