"""A folder that compressed PLY files arrive in, as a stream of Gaussians: an extension of the batch reader."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bounds import unpack
from ..sources.ply import decompress_bytes

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_scenes(spark: SparkSession, folder: str, degree: int = 0, files_per_batch: int = 64) -> DataFrame:
    """(scene, arrived, Gaussians) of every file once, each file a task's work."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)
    named = files.select(F.struct("path", "modificationTime").alias("path"), "content")
    rows = decompress_bytes(named, degree)
    return rows.select(F.col("scene.path").alias("scene"), F.col("scene.modificationTime").alias("arrived"), *[c for c in rows.columns if c != "scene"])


def scene_extents(rows: DataFrame, lateness: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Per scene and window of arrival: rows and the box of their centres; late windows close by the watermark."""
    return rows.withWatermark("arrived", lateness).groupBy(F.window("arrived", window), "scene").agg(
        F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))])


Corner = tuple[float, float, float]


def meets_box(low: Corner, high: Corner) -> Column:
    """Whether the chunk whose bounds stand beside a row meets a box: zone maps for spatial scans."""
    tests = [(F.col(f"min_{a}") <= hi) & (F.col(f"max_{a}") >= lo) for a, lo, hi in zip("xyz", low, high, strict=True)]
    return reduce(and_, tests)


def in_box(low: Corner, high: Corner) -> Column:
    return reduce(and_, [F.col(a).between(lo, hi) for a, lo, hi in zip("xyz", low, high, strict=True)])


def packed_rows_in_box(packed: DataFrame, low: Corner, high: Corner, degree: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Gaussians in a box of packed rows beside their bounds: whole chunks drop out before anything is decoded; no shuffle."""
    return unpack(packed.where(meets_box(low, high)), degree, by).where(in_box(low, high))
