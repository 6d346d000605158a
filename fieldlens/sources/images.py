"""Images as pixels: PNG, JPEG and BMP are decoded with zlib and numpy where they are read."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.functions.text import content_key

from .jpeg import decode_jpeg

PIXELS = "image_id string, x int, y int, r int, g int, b int"


def unfiltered(lines: np.ndarray, n: int) -> np.ndarray:
    """Rows of bytes from filtered ones, whose first byte names the filter; n bytes are a pixel.

    Rows that look back only along themselves or only upward are done row by row. Others go by diagonals:
    what a pixel's left, upper and upper left neighbours need lies on the diagonals before.
    """
    height, kind = len(lines), lines[:, 0].astype(np.int32)
    px = lines[:, 1:].reshape(height, -1, n).astype(np.int32)
    width = px.shape[1]
    if (kind > 4).any():
        raise ValueError("no such filter")
    out = np.zeros((height + 1, width + 1, n), np.int32)
    if not (kind > 2).any():
        for y in range(height):
            row = np.cumsum(px[y], axis=0) if kind[y] == 1 else px[y] + (out[y, 1:] if kind[y] == 2 else 0)
            out[y + 1, 1:] = row & 255
        return out[1:, 1:].astype(np.uint8)
    for t in range(width + height - 1):
        y = np.arange(max(0, t - width + 1), min(height, t + 1))
        x = t - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        k = kind[y][:, None]
        guess = np.where(k == 1, left, np.where(k == 2, up, np.where(k == 3, (left + up) >> 1, np.where(k == 4, nearest, 0))))
        out[y + 1, x + 1] = px[y, x] + guess & 255
    return out[1:, 1:].astype(np.uint8)


def _samples(data: bytes, at: int, width: int, height: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """(height x width x channels of one pass, where the next one begins). Samples of 16 bits keep the upper byte."""
    stride = (width * channels * depth + 7) // 8
    size = height * (1 + stride)
    lines = np.frombuffer(data, np.uint8, size, at).reshape(height, 1 + stride)
    raw = unfiltered(lines, max(1, channels * depth // 8)).reshape(height, stride)
    if depth == 16:
        raw = raw[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(raw, axis=1).reshape(height, -1, depth)
        raw = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)
    return raw[:, : width * channels].reshape(height, width, channels), at + size


#: First column and row, and steps between columns and rows, of the passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def decode_png(content: bytes) -> np.ndarray:
    """Height x width x 3; alpha is laid on white. Any colour type and depth, interlaced or not."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, data, palette, see = 8, [], None, None
    color = None
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            see = body
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if color not in (0, 2, 3, 4, 6) or not width or not height:
        raise ValueError("no picture")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = zlib.decompress(b"".join(data))
    if interlace:
        px, at = np.zeros((height, width, n), np.uint8), 0
        for x, y, dx, dy in PASSES:
            w, h = -(-(width - x) // dx), -(-(height - y) // dy)
            if w > 0 and h > 0:
                px[y::dy, x::dx], at = _samples(raw, at, w, h, depth, n)
    else:
        px, _ = _samples(raw, 0, width, height, depth, n)
    alpha = np.full((height, width), 255, np.uint8)
    if color == 3:
        known = np.full(256, 255, np.uint8)
        known[: len(see or b"")] = np.frombuffer(see or b"", np.uint8)
        rgb, alpha = palette[px[..., 0]], known[px[..., 0]]
    else:
        if see is not None and color in (0, 2):  # one colour is clear
            clear = np.array(struct.unpack(f">{n}H", see[: 2 * n])) >> max(0, depth - 8)
            alpha = np.where((px == clear).all(axis=2), 0, 255)
        if depth < 8:
            px = (px.astype(np.int32) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        if color in (4, 6):
            alpha = px[..., -1]
        rgb = np.repeat(px[..., :1], 3, axis=2) if color in (0, 4) else px[..., :3]
    w = alpha[..., None].astype(np.float64) / 255
    return np.rint(rgb * w + 255 * (1 - w)).astype(np.uint8)


def decode_bmp(content: bytes) -> np.ndarray:
    """Height x width x 3 of an uncompressed BMP of 24 or 32 bits, bottom-up or top-down."""
    if content[:2] != b"BM":
        raise ValueError("no BMP")
    start, _, width, height, _, bits = struct.unpack("<IIiiHH", content[10:30])
    if bits not in (24, 32):
        raise ValueError(f"{bits} bits a pixel")
    n, rows = bits // 8, abs(height)
    stride = (width * n + 3) // 4 * 4
    px = np.frombuffer(content, np.uint8, stride * rows, start).reshape(rows, stride)[:, : width * n].reshape(rows, width, n)[..., 2::-1]
    return px if height < 0 else px[::-1]


def encode_png(rgb: np.ndarray) -> bytes:
    height, width, _ = rgb.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rgb.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode(content: bytes) -> np.ndarray:
    """Height x width x 3 of a PNG, JPEG or BMP; ValueError where it can't be read."""
    try:
        if content[:2] == b"BM":
            return decode_bmp(content)
        return decode_jpeg(content) if content[:2] == b"\xff\xd8" else decode_png(content)
    except (IndexError, KeyError, TypeError, struct.error, zlib.error) as e:
        raise ValueError(f"a broken image: {e}") from e


def pixels(images: DataFrame) -> DataFrame:
    """A row for each pixel of images (image_id, content). Contents that can't be read, null ones too, have no pixel."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in zip(pdf.image_id, pdf.content, strict=True):
                try:
                    a = decode(content or b"")
                except ValueError:
                    continue
                y, x = np.indices(a.shape[:2]).reshape(2, -1)
                flat = a.reshape(-1, 3).astype(np.int32)
                yield pd.DataFrame({"image_id": name, "x": x.astype(np.int32), "y": y.astype(np.int32), "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]})

    return images.select(F.col("image_id").cast("string").alias("image_id"), "content").mapInPandas(run, PIXELS)


def distinct_images(images: DataFrame) -> DataFrame:
    """(content_key, content): equal images once, by the SHA-1 of their bytes, so that each is prepared and read once."""
    return images.select(content_key(F.col("content")).alias("content_key"), "content").dropDuplicates(["content_key"])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, width, height, channels, mode, data) by Spark's own source, JPEG included; bytes are BGR."""
    i = spark.read.format("image").load(path).select("image.*")
    return i.select(F.col("origin").alias("image_id"), "width", "height", F.col("nChannels").alias("channels"), "mode", "data")
