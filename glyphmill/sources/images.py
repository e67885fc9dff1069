"""Image sequences: scan, decode, scale to the canvas, cut into tiles, and PNG output."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT, CELL = 640, 480, 8
COLUMNS, ROWS = WIDTH // CELL, HEIGHT // CELL
KINDS = ("png", "jpg", "jpeg", "gif", "bmp", "tiff")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(``frame_idx``, ``path``, ``height``, ``width``, ``n_channels``, ``data``) of a folder's images, numbered by path; suffixes in lower or upper case.

    A folder is an animation: its paths, without the images, are numbered in one task, and several
    folders by themselves, in parallel.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    images = images.where(F.lower(F.substring_index("origin", ".", -1)).isin(*KINDS))
    order = Window.partitionBy(F.regexp_replace("origin", "/[^/]*$", "")).orderBy("origin")
    number = images.select("origin").withColumn("frame_idx", (F.row_number().over(order) - 1).cast("int"))
    return images.join(number, "origin").select("frame_idx", F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("n_channels"), "data")


def to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Spark's grey, BGR or BGRA bytes to RGB; alpha is dropped."""
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(px, 3, axis=2) if channels == 1 else px[:, :, 2::-1]


def _weights(size: int, out: int) -> np.ndarray:
    """Lanczos-3 weights (out, size): the window widens when shrinking; rows add up to 1."""
    scale = size / out
    reach = max(scale, 1.0)
    centre = (np.arange(out) + 0.5) * scale
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / reach
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    if img.shape[:2] == (height, width):
        return img
    whole = lambda x: np.clip(np.rint(np.round(x, 9)), 0, 255)  # noqa: E731  ties are exact whatever the order of a sum
    rows = whole(np.einsum("oh,hwc->owc", _weights(img.shape[0], height), img.astype(np.float64)))
    return whole(np.einsum("ow,hwc->hoc", _weights(img.shape[1], width), rows)).astype(np.uint8)


def placement(width: int, height: int, crop: bool = False) -> tuple[int, int, int, int]:
    """Scaled width and height, and the left and top of the image on the canvas (negative when cropped)."""
    ratio = (max if crop else min)(WIDTH / width, HEIGHT / height)
    w, h = max(1, int(width * ratio)), max(1, int(height * ratio))
    if crop:
        w, h = max(w, WIDTH), max(h, HEIGHT)
    return w, h, (WIDTH - w) // 2 if not crop else -((w - WIDTH) // 2), (HEIGHT - h) // 2 if not crop else -((h - HEIGHT) // 2)


def canvas(img: np.ndarray, crop: bool = False) -> np.ndarray:
    """640x480: letterboxed on black, or filled and cropped at the centre."""
    w, h, x, y = placement(img.shape[1], img.shape[0], crop)
    scaled = resize(img, w, h)
    if crop:
        return scaled[-y : -y + HEIGHT, -x : -x + WIDTH]
    out = np.zeros((HEIGHT, WIDTH, 3), np.uint8)
    out[y : y + h, x : x + w] = scaled
    return out


def cut(img: np.ndarray) -> np.ndarray:
    """(4800, 192): the tiles in row-major order."""
    return img.reshape(ROWS, CELL, COLUMNS, CELL, 3).swapaxes(1, 2).reshape(ROWS * COLUMNS, CELL * CELL * 3)


def tiles(frames: DataFrame, crop: bool = False) -> DataFrame:
    """(``frame_idx``, ``tile_idx``, ``px``) from ``scan``'s rows; an image at a time in each task."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            for r in part.itertuples():
                px = cut(canvas(to_rgb(r.data, r.height, r.width, r.n_channels), crop))
                yield pd.DataFrame({"frame_idx": r.frame_idx, "tile_idx": np.arange(len(px), dtype=np.int32), "px": [x.tobytes() for x in px]})

    return frames.select("frame_idx", "height", "width", "n_channels", "data").mapInPandas(run, "frame_idx int, tile_idx int, px binary")


def png(img: np.ndarray) -> bytes:
    """RGB (h, w, 3) as PNG."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = img.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), img.reshape(h, w * 3)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")
