"""Attributes stored as texture pixels (r, g, b, a columns of bytes) to Gaussians, as Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .activation import logit, signed_log_inverse

CHANNELS = ("r", "g", "b", "a")


def linear(byte: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + byte / F.lit(255.0) * F.lit(float(high) - float(low))


def codebook(byte: Column, values: list[float]) -> Column:
    """A value of a codebook; bytes beyond its end give 0."""
    return F.coalesce(F.get(F.array(*[F.lit(float(v)) for v in values]), byte.cast("int")), F.lit(0.0))


def means(lows: list[Column], highs: list[Column], mins: list[float], maxs: list[float]) -> list[Column]:
    """Centres from a low and a high byte per axis, in signed-log space."""
    out = []
    for lo, hi, low, high in zip(lows, highs, mins, maxs, strict=True):
        span = float(high) - float(low) or 1.0
        code = lo + F.lit(256) * hi
        out.append(signed_log_inverse(F.lit(float(low)) + F.lit(span) * (code / F.lit(65535.0))))
    return out


def rotations(r: Column, g: Column, b: Column, tag: Column) -> list[Column]:
    """The tag (252..255) says which component was dropped; any other gives (0, 0, 0, 1)."""
    x, y, z = ((v / F.lit(255.0) * F.lit(2.0) - F.lit(1.0)) * F.lit(1 / math.sqrt(2.0)) for v in (r, g, b))
    m = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - (x * x + y * y + z * z)))
    orders = [(m, x, y, z), (x, m, y, z), (x, y, m, z), (x, y, z, m)]
    out = []
    for k in range(4):
        value = F.when(tag == 252, orders[0][k])
        for i in (1, 2, 3):
            value = value.when(tag == 252 + i, orders[i][k])
        out.append(value.otherwise(F.lit(float(k == 3))))
    return out


def colours_codebook(rgba: list[Column], values: list[float]) -> list[Column]:
    """Three colours from the codebook and the opacity's logit from the alpha byte."""
    return [codebook(c, values) for c in rgba[:3]] + [logit(rgba[3] / F.lit(255.0))]


def colours_linear(rgba: list[Column], mins: list[float], maxs: list[float]) -> list[Column]:
    return [linear(c, low, high) for c, low, high in zip(rgba, mins, maxs, strict=True)]
