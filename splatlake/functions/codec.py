"""The 256-row chunk codec as Column functions: quantised words in BIGINT, since Spark has no unsigned integers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CENTRE, COLOUR, ROTATION, SCALE
from .activation import clamp, rgb2sh, sh2rgb, sigmoid

LEAST_RANGE = 1e-10
AXES = ("x", "y", "z")
CHANNELS = ("r", "g", "b")


def quantise(unit: Column, bits: int) -> Column:
    """[0, 1] to the nearest of 2**bits codes; values beyond are clamped."""
    return F.floor(clamp(unit, 0.0, 1.0) * F.lit(float(2**bits - 1)) + F.lit(0.5)).cast("long")


def within(v: Column, low: Column, high: Column) -> Column:
    return (v - low) / F.greatest(high - low, F.lit(LEAST_RANGE))


def join_bits(*parts: tuple[Column, int]) -> Column:
    """Codes side by side, the first highest."""
    out, width = None, 0
    for code, bits in reversed(parts):
        code = F.shiftleft(code, width) if width else code
        out, width = code if out is None else out.bitwiseOR(code), width + bits
    return out


def bits_of(word: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(word, shift).bitwiseAND(F.lit(2**bits - 1).cast("long"))


def pack_position() -> Column:
    return join_bits(*((quantise(within(F.col(c), F.col(f"min_{a}"), F.col(f"max_{a}")), b), b) for c, a, b in zip(CENTRE, AXES, (11, 10, 11), strict=True)))


def pack_scale() -> Column:
    return join_bits(*((quantise(within(F.col(c), F.col(f"min_scale_{a}"), F.col(f"max_scale_{a}")), b), b) for c, a, b in zip(SCALE, AXES, (11, 10, 11), strict=True)))


def pack_colour() -> Column:
    rgb = ((quantise(within(sh2rgb(F.col(c)), F.col(f"min_{a}"), F.col(f"max_{a}")), 8), 8) for c, a in zip(COLOUR, CHANNELS, strict=True))
    return join_bits(*rgb, (quantise(sigmoid(F.col("opacity")), 8), 8))


def pack_rotation() -> Column:
    """Which component is largest (the first of equals), then the other three, the largest made positive."""
    q = [F.col(c) for c in ROTATION]
    norm = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    unit = [F.when(norm > 0, c / F.when(norm > 0, norm).otherwise(F.lit(1.0))).otherwise(c) for c in q]
    top = F.greatest(*[F.abs(c) for c in unit])

    def when_largest(pick) -> Column:
        out = F.when(F.abs(unit[0]) == top, pick(0)).when(F.abs(unit[1]) == top, pick(1)).when(F.abs(unit[2]) == top, pick(2))
        return out.otherwise(pick(3))

    def other(k: int) -> Column:
        signed = lambda i: F.when(unit[i] < 0, -unit[[j for j in range(4) if j != i][k]]).otherwise(unit[[j for j in range(4) if j != i][k]])
        return quantise(when_largest(signed) * F.lit(math.sqrt(2.0) * 0.5) + F.lit(0.5), 10)

    return join_bits((when_largest(lambda i: F.lit(i).cast("long")), 2), *((other(k), 10) for k in range(3)))


def pack_harmonics(f_rest: Column, count: int) -> Column:
    """Bytes of the coefficients, truncated; an explicit list keeps the projection inside generated code."""
    return F.array(*[clamp(F.get(f_rest, k) * F.lit(32.0) + F.lit(128.0), 0.0, 255.0).cast("short") for k in range(count)]) if count else F.array().cast("array<smallint>")


def unpack_position(word: Column) -> list[Column]:
    return _dequantise3(word, [(F.col(f"min_{a}"), F.col(f"max_{a}")) for a in AXES])


def unpack_scale(word: Column) -> list[Column]:
    return _dequantise3(word, [(F.col(f"min_scale_{a}"), F.col(f"max_scale_{a}")) for a in AXES])


def _dequantise3(word: Column, bounds: list[tuple[Column, Column]]) -> list[Column]:
    return [low + bits_of(word, s, b) / F.lit(float(2**b - 1)) * (high - low) for (low, high), s, b in zip(bounds, (21, 11, 0), (11, 10, 11), strict=True)]


def unpack_colour(word: Column) -> list[Column]:
    """The three colours as harmonics."""
    return [rgb2sh(F.col(f"min_{a}") + bits_of(word, s, 8) / F.lit(255.0) * (F.col(f"max_{a}") - F.col(f"min_{a}"))) for a, s in zip(CHANNELS, (24, 16, 8), strict=True)]


def unpack_opacity(word: Column) -> Column:
    """As a logit; the extreme codes stand for -10 and 10."""
    code = bits_of(word, 0, 8)
    inner = F.when((code > 0) & (code < 255), code / F.lit(255.0)).otherwise(F.lit(0.5))
    return F.when(code == 0, F.lit(-10.0)).when(code == 255, F.lit(10.0)).otherwise(-F.ln(F.lit(1.0) / inner - F.lit(1.0)))


def unpack_rotation(word: Column) -> list[Column]:
    a, b, c = ((bits_of(word, s, 10) / F.lit(1023.0) - F.lit(0.5)) * F.lit(math.sqrt(2.0)) for s in (20, 10, 0))
    m = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - (a * a + b * b + c * c)))
    which = bits_of(word, 30, 2)
    orders = [(m, a, b, c), (a, m, b, c), (a, b, m, c), (a, b, c, m)]
    return [F.when(which == 0, orders[0][k]).when(which == 1, orders[1][k]).when(which == 2, orders[2][k]).otherwise(orders[3][k]) for k in range(4)]


def harmonic(code: Column) -> Column:
    return (code - F.lit(127.5)) / F.lit(32.0)


def unpack_harmonics(codes: Column, count: int) -> Column:
    return F.array(*[harmonic(F.get(codes, k)) for k in range(count)]) if count else F.array().cast("array<double>")
