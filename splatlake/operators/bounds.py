"""Chunks of 256 rows: bounds, packing and unpacking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.activation import clamp, sh2rgb
from ..schema import BANDS, BOUNDS, CENTRE, COLOUR, PACKED, ROTATION, SCALE


def chunk_id() -> Column:
    return F.shiftright("gid", 8)


def _bounded(over) -> dict[str, Column]:
    """The 18 bounds; ``over`` finishes an aggregate. Scale bounds are clamped to [-20, 20]."""
    values = [F.col(c) for c in (*CENTRE, *SCALE)] + [sh2rgb(F.col(c)) for c in COLOUR]
    names = [n.removeprefix("min_") for n in BOUNDS if n.startswith("min_")]
    out = {}
    for name, v in zip(names, values, strict=True):
        fix = (lambda c: clamp(c, -20.0, 20.0)) if name.startswith("scale") else (lambda c: c)
        out[f"min_{name}"], out[f"max_{name}"] = fix(over(F.min(v))), fix(over(F.max(v)))
    return {n: out[n] for n in BOUNDS}


def chunk_bounds(rows: DataFrame) -> DataFrame:
    """(chunk_id, 18 bounds): partial minima and maxima before one small shuffle."""
    return rows.groupBy(chunk_id().alias("chunk_id")).agg(*[c.alias(n) for n, c in _bounded(lambda c: c).items()])


def with_bounds(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each row beside its chunk's bounds: one shuffle by chunk, no join and no second scan; a group has 256 rows at most."""
    window = Window.partitionBy(*by, "__chunk")
    return rows.withColumn("__chunk", chunk_id()).select(*rows.columns, *[c.alias(n) for n, c in _bounded(lambda c: c.over(window)).items()])


def pack(rows: DataFrame, degree: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """(gid, four packed words, f_rest codes, bounds) of log-domain SH rows; ``by``: scenes with gids of their own."""
    words = dict(zip(PACKED, (codec.pack_position(), codec.pack_rotation(), codec.pack_scale(), codec.pack_colour()), strict=True))
    bounded = with_bounds(rows, by)
    return bounded.select(*by, "gid", *[c.alias(n) for n, c in words.items()], codec.pack_harmonics(F.col("f_rest"), 3 * BANDS[degree]).alias("f_rest"), *BOUNDS)


def unpack(packed: DataFrame, degree: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Gaussians of packed words whose chunk's bounds stand beside them."""
    word = {n: F.col(n) for n in PACKED}
    columns = {
        **dict(zip(CENTRE, codec.unpack_position(word["packed_position"]), strict=True)), **dict(zip(COLOUR, codec.unpack_colour(word["packed_color"]), strict=True)),
        "f_rest": codec.unpack_harmonics(F.col("f_rest"), 3 * BANDS[degree]), "opacity": codec.unpack_opacity(word["packed_color"]),
        **dict(zip(SCALE, codec.unpack_scale(word["packed_scale"]), strict=True)), **dict(zip(ROTATION, codec.unpack_rotation(word["packed_rotation"]), strict=True)),
    }
    return packed.select(*by, "gid", *[c.cast("array<float>" if n == "f_rest" else "float").alias(n) for n, c in columns.items()])
