"""Texture bundles: a meta.json and images whose pixel i belongs to row i, as a folder or a zip.

Images become tables (pixel, r, g, b, a), which meet on the pixel; the palette of harmonics is one array per label. A label has 16 bits,
so the palette has at most 65,536 rows and may be broadcast. The image decoder is a parameter: any function from
bytes to an array of height, width and 3 or 4 channels; ``imagecodecs`` is used where it is installed.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textures
from ..operators.frame import SplatFrame
from ..schema import BANDS, CENTRE, COLOUR, ROTATION, SCALE, degree_of_bands
from ..state import FormatState

PALETTE_COLUMNS = 64
Decoder = Callable[[bytes], np.ndarray]


def webp(data: bytes) -> np.ndarray:
    try:
        import imagecodecs
    except ImportError as e:
        raise ImportError("decoding WebP needs imagecodecs, or another decoder passed as decode=") from e
    return imagecodecs.webp_decode(data)


def is_linear(meta: dict) -> bool:
    """Whether values are dequantised between bounds (no count at the top, shapes instead) rather than by codebooks."""
    return "count" not in meta and "shape" in meta.get("means", {})


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The meta.json of a zip or of a folder's file of that name; a zip's images stay in the task."""
    for batch in batches:
        for path, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = value.as_buffer()
            if path.rsplit("/", 1)[-1] == "meta.json":
                yield pa.RecordBatch.from_arrays([pa.array([data.to_pybytes()], pa.binary())], ["head"])
            elif data.slice(0, min(2, data.size)).to_pybytes() == b"PK":
                with zipfile.ZipFile(pa.BufferReader(data)) as z:
                    if "meta.json" in z.namelist():
                        yield pa.RecordBatch.from_arrays([pa.array([z.read("meta.json")], pa.binary())], ["head"])


def _members(zipped: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(zipped)) as z:
        return {n: z.read(n) for n in z.namelist()}


def _pixels(decode: Decoder, names: list[str]):
    """Rows (name, width, height, pixel, r, g, b, a) of the wanted images among files or zips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files = _members(data) if data[:2] == b"PK" else {path.rsplit("/", 1)[-1]: data}
                for name in set(names) & set(files):
                    image = decode(files[name])
                    height, width, channels = image.shape
                    flat = image.reshape(-1, channels).astype(np.int16)
                    alpha = flat[:, 3] if channels > 3 else np.full(len(flat), 255, np.int16)
                    for k in range(0, len(flat), 1 << 16):
                        n = len(flat[k : k + (1 << 16)])
                        columns = [pa.array([name] * n), pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, height, np.int32)), pa.array(np.arange(k, k + n))]
                        columns += [pa.array(np.ascontiguousarray(flat[k : k + n, c])) for c in range(3)] + [pa.array(np.ascontiguousarray(alpha[k : k + n]))]
                        yield pa.RecordBatch.from_arrays(columns, ["name", "width", "height", "pixel", "r", "g", "b", "a"])

    return run


def _textures(pixels: DataFrame, named: list[tuple[str, str]], count: int) -> DataFrame:
    """(pixel, the channels of each image under its prefix): all images meet in one shuffle, a pixel's channels as one number."""
    code = F.col("r") + F.shiftleft(F.col("g").cast("long"), 8) + F.shiftleft(F.col("b").cast("long"), 16) + F.shiftleft(F.col("a").cast("long"), 24)
    wanted = pixels.where(F.col("name").isin([name for _, name in named]) & (F.col("pixel") < count)).select("pixel", "name", code.alias("code"))
    met = wanted.groupBy("pixel").agg(*[F.max(F.when(F.col("name") == name, F.col("code"))).alias(prefix) for prefix, name in named])
    channel = lambda prefix, k: F.shiftright(prefix, 8 * k).bitwiseAND(F.lit(255)).alias(f"{prefix}_{textures.CHANNELS[k]}")
    return met.select("pixel", *[channel(prefix, k) for prefix, _ in named for k in range(4)])


def palette(centroids: DataFrame, bands: int, value: Callable[[Column], Column]) -> DataFrame:
    """(label, coefficients): per label its harmonics in file order (all of red, green, blue), from pixels (pixel, r, g, b)."""
    width = PALETTE_COLUMNS * bands
    x, y = F.col("pixel") % width, F.floor(F.col("pixel") / width)
    label = y * PALETTE_COLUMNS + F.floor(x / bands)
    rows = centroids.select(label.cast("long").alias("label"), (x % bands).cast("int").alias("j"), *[value(F.col(c)).alias(c) for c in "rgb"])
    sorted_ = F.array_sort(F.collect_list(F.struct("j", "r", "g", "b")))
    return rows.groupBy("label").agg(sorted_.alias("s")).select("label", F.concat(*[F.col(f"s.{c}") for c in "rgb"]).alias("coefficients"))


def labelled(rows: DataFrame, labels: Column, known: DataFrame, palette_count: int, bands: int) -> DataFrame:
    """``rows`` with f_rest looked up by label; labels without an entry, or past the palette's count, give zeros."""
    zeros = F.array(*[F.lit(0.0)] * (3 * bands))
    met = rows.withColumn("label", labels.cast("long")).join(F.broadcast(known), "label", "left")
    return met.withColumn("f_rest", F.when(F.col("label") < palette_count, F.coalesce("coefficients", zeros)).otherwise(zeros)).drop("label", "coefficients")


def read_bundle(spark: SparkSession, path: str, decode: Decoder = webp) -> SplatFrame:
    """A bundle: a .sog zip or a folder. ValueError for missing files or images too small; only the text of meta.json comes to the driver."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    heads = files if path.lower().endswith(".sog") else files.where(F.col("path").endswith("/meta.json"))
    row = heads.mapInArrow(_heads, "head binary").first()
    if row is None:
        raise ValueError("the bundle has no meta.json")
    meta = json.loads(bytes(row.head).decode())
    return decode_bundle(files, meta, decode)


def decode_bundle(files: DataFrame, meta: dict, decode: Decoder = webp) -> SplatFrame:
    """Gaussians of (path, content) rows and their meta."""
    linear = is_linear(meta)
    count = meta["means"]["shape"][0] if linear else meta["count"]
    parts = {k: meta[k]["files"] for k in ("means", "quats", "scales", "sh0")}
    bands, rest = 0, meta.get("shN")
    if rest:
        bands = rest["shape"][1] if linear else BANDS[rest["bands"]]
    if bands:
        parts["shN"] = rest["files"]
    names = list(chain.from_iterable(parts.values()))
    pixels = files.mapInArrow(_pixels(decode, names), "name string, width int, height int, pixel long, r short, g short, b short, a short").persist()
    sizes = {r.name: (r.width, r.height) for r in pixels.where("pixel = 0").collect()}
    for kind, wanted in parts.items():
        for name in wanted:
            if name not in sizes:
                raise ValueError(f"the bundle has no {name}")
            if not (kind == "shN" and name == wanted[0]) and sizes[name][0] * sizes[name][1] < count:
                raise ValueError(f"{name} has fewer pixels than the bundle has rows")
    tables = [("lo", parts["means"][0]), ("hi", parts["means"][1]), ("q", parts["quats"][0]), ("s", parts["scales"][0]), ("c", parts["sh0"][0])]
    tables += [("l", parts["shN"][1])] if bands else []
    joined = _textures(pixels, tables, count)
    col = lambda p, channels="rgba": [F.col(f"{p}_{c}") for c in channels]
    means = textures.means(col("lo", "rgb"), col("hi", "rgb"), meta["means"]["mins"], meta["means"]["maxs"])
    if linear:
        scales = [textures.linear(c, *b) for c, *b in zip(col("s", "rgb"), meta["scales"]["mins"], meta["scales"]["maxs"], strict=True)]
        colours = textures.colours_linear(col("c"), meta["sh0"]["mins"], meta["sh0"]["maxs"])
    else:
        scales = [textures.codebook(c, meta["scales"]["codebook"]) for c in col("s", "rgb")]
        colours = textures.colours_codebook(col("c"), meta["sh0"]["codebook"])
    named = dict(zip((*CENTRE, *SCALE, *ROTATION, *COLOUR, "opacity"), [*means, *scales, *textures.rotations(*col("q")), *colours], strict=True))
    rows = joined.select(F.col("pixel").alias("gid"), *[c.alias(n) for n, c in named.items()], *([F.col("l_r"), F.col("l_g")] if bands else []))
    if bands:
        value = (lambda b: textures.linear(b, rest["mins"], rest["maxs"])) if linear else (lambda b: textures.codebook(b, rest["codebook"]))
        entries = sizes[rest["files"][0]][1] * PALETTE_COLUMNS if linear else rest["count"]
        known = palette(pixels.where(F.col("name") == rest["files"][0]), bands, value)
        rows = labelled(rows, F.col("l_r") + F.lit(256) * F.col("l_g"), known, entries, bands)
    degree = degree_of_bands(bands)
    return SplatFrame.from_columns(rows.drop("l_r", "l_g"), "ply", degree)._with(degree=degree)
