"""Pixel kernels: perceptual hash of decoded images. Arrow batches go to numpy; nothing runs row by row in Python but decoding's results."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samphire.sources.scan import listed_files, literal_paths

SIDE, KEPT = 32, 8


def _basis() -> np.ndarray:
    """Rows 0 to KEPT of the orthonormal DCT-II over SIDE samples."""
    k, x = np.arange(KEPT)[:, None], np.arange(SIDE)[None, :]
    scale = np.where(k == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))
    return scale * np.cos((2 * x + 1) * k * np.pi / (2 * SIDE))


def _cubic(x: np.ndarray) -> np.ndarray:
    """Catmull-Rom kernel."""
    x = np.abs(x)
    return np.where(x <= 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))


def resampler(size: int) -> np.ndarray:
    """SIDE x size weights of a bicubic resize; a shrinking one widens the kernel."""
    scale = size / SIDE
    spread = max(scale, 1.0)
    center = (np.arange(SIDE) + 0.5) * scale - 0.5
    weights = _cubic((np.arange(size)[None, :] - center[:, None]) / spread)
    total = weights.sum(axis=1, keepdims=True)
    return weights / np.where(total == 0, 1, total)


def gray(pixels: np.ndarray) -> np.ndarray:
    """Luma (BT.709) of (height, width, channels) bytes in the order blue, green, red."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0].astype(np.float64)
    return pixels[:, :, :3].astype(np.float64) @ np.array([0.0722, 0.7152, 0.2126])


def hash_bits(luma: np.ndarray, eps: float = 0.0) -> int:
    """64 bits, bit 8v + u for coefficient (v, u): 1 above the median of the other 63; bit 0, the mean, is 0."""
    small = resampler(luma.shape[0]) @ luma @ resampler(luma.shape[1]).T
    small = np.clip(np.rint(small), 0, 255)
    d = _basis()
    c = (d @ small @ d.T).ravel()
    c[np.abs(c) < eps] = 0
    bits = c > np.median(c[1:])
    bits[0] = False
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def perceptual_hash(height: Column, width: Column, channels: Column, data: Column, eps: float = 0.0) -> Column:
    """Hash of images as Spark's image source gives them, as a signed 64-bit number; null for undecodable ones.

    ``eps``: coefficients nearer to 0 count as 0, which makes the hashes of flat images stable; off by default.
    """

    @F.pandas_udf("long")
    def run(h: pd.Series, w: pd.Series, n: pd.Series, raw: pd.Series) -> pd.Series:
        out = [None if b is None or not a or not len(b) else hash_bits(gray(np.frombuffer(b, np.uint8).reshape(a, c, k)), eps) for a, c, k, b in zip(h, w, n, raw, strict=True)]
        return pd.Series(out, dtype="Int64")

    return run(height, width, channels, data)


def fingerprints(files: DataFrame, images: DataFrame, eps: float = 0.0) -> DataFrame:
    """(path, sha256, phash) from binary files (path, content) and decoded images (the image source's struct).

    Files that Spark's image source can't decode (WebP, broken ones) keep a row with a null phash: they take part in
    exact groups and not in near ones. Repeated paths are the caller's to remove (``scan.clean_paths``).
    """
    # the image source gives addresses, the binary one paths
    origin = F.url_decode(F.replace(F.regexp_replace("image.origin", "^file:/+", "file:/"), F.lit("+"), F.lit("%2B")))
    decoded = images.select(origin.alias("path"), perceptual_hash(F.col("image.height"), F.col("image.width"), F.col("image.nChannels"), F.col("image.data"), eps).alias("phash"))
    return files.select("path", F.sha2("content", 256).alias("sha256")).join(decoded, "path", "left")


def listed_fingerprints(spark: SparkSession, paths: Sequence[str | None], eps: float = 0.0) -> DataFrame:
    """``fingerprints`` of a list of files, each once; blank entries are left out, a missing file is an error."""
    files = literal_paths(listed_files(spark, paths))
    if not files:
        return spark.createDataFrame([], "path string, sha256 string, phash long")
    raw = spark.read.format("binaryFile").load(files).select("path", "content")
    return fingerprints(raw, spark.read.format("image").option("dropInvalid", "true").load(files), eps)
