"""Columns of a table of Gaussians.

A row is one Gaussian: ``gid`` (its position, 0..n-1), centre, colour, opacity, log or linear scales, rotation, and ``f_rest``, the higher
spherical-harmonic coefficients as one array in file order (all of red, then green, then blue).
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values of the file formats.
SH_C0 = 0.28209479177387814
CHUNK_ROWS = 256
BANDS = {0: 0, 1: 3, 2: 8, 3: 15}

CENTRE = ("x", "y", "z")
COLOUR = ("f_dc_0", "f_dc_1", "f_dc_2")
SCALE = ("scale_0", "scale_1", "scale_2")
ROTATION = ("rot_0", "rot_1", "rot_2", "rot_3")
SCALARS = (*CENTRE, *COLOUR, "opacity", *SCALE, *ROTATION)
BOUNDS = (
    "min_x", "min_y", "min_z", "max_x", "max_y", "max_z", "min_scale_x", "min_scale_y", "min_scale_z", "max_scale_x", "max_scale_y", "max_scale_z",
    "min_r", "min_g", "min_b", "max_r", "max_g", "max_b",
)
PACKED = ("packed_position", "packed_rotation", "packed_scale", "packed_color")
MASK_PREFIX = "mask__"

GAUSSIANS = T.StructType(
    [T.StructField("gid", T.LongType(), False)]
    + [T.StructField(c, T.FloatType(), False) for c in (*CENTRE, *COLOUR)]
    + [T.StructField("f_rest", T.ArrayType(T.FloatType(), False), False)]
    + [T.StructField(c, T.FloatType(), False) for c in ("opacity", *SCALE, *ROTATION)]
)


def degree_of_bands(bands: int) -> int:
    """SH degree by number of bands; unknown numbers give 0."""
    return {v: k for k, v in BANDS.items()}.get(bands, 0)


def degree_of_properties(count: int) -> int | None:
    """SH degree of an uncompressed file by its number of properties, or None."""
    return {14 + 3 * bands: degree for degree, bands in BANDS.items()}.get(count)


def property_names(degree: int) -> list[str]:
    """The properties of an uncompressed vertex in order."""
    return [*CENTRE, *COLOUR, *(f"f_rest_{k}" for k in range(3 * BANDS[degree])), "opacity", *SCALE, *ROTATION]
