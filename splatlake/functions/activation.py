"""Value domains as Column functions: harmonics and colour, logits and opacities, log and linear scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import COLOUR, ROTATION, SCALE, SH_C0


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def sh2rgb(sh: Column) -> Column:
    return sh * F.lit(SH_C0) + F.lit(0.5)


def rgb2sh(rgb: Column) -> Column:
    return (rgb - F.lit(0.5)) / F.lit(SH_C0)


def logit(p: Column, eps: float = 1e-6) -> Column:
    v = clamp(p, eps, 1.0 - eps)
    return F.ln(v / (F.lit(1.0) - v))


def sigmoid(x: Column) -> Column:
    """Stable on both sides: the exponent is never positive."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def signed_log_inverse(v: Column) -> Column:
    """The inverse of sign(x) * ln(|x| + 1)."""
    return F.signum(v) * (F.exp(F.abs(v)) - F.lit(1.0))


def activations(min_scale: float = 1e-4, max_scale: float = 100.0, min_norm: float = 1e-8, clamped: bool = True, unit_rotations: bool = True) -> dict[str, Column]:
    """Log scales, logit opacities and raw rotations to what a rasteriser takes, one column each for a single projection.

    Rotations shorter than ``min_norm`` become (0, 0, 0, 1).
    """
    if clamped and not 0 < min_scale <= max_scale:
        raise ValueError("0 < min_scale <= max_scale is needed")
    if min_norm <= 0:
        raise ValueError("min_norm must be positive")
    scale = lambda c: clamp(F.exp(F.col(c)), min_scale, max_scale) if clamped else F.exp(F.col(c))
    out = {c: scale(c) for c in SCALE} | {"opacity": sigmoid(F.col("opacity"))}
    if unit_rotations:
        norm = F.sqrt(sum((F.col(c) * F.col(c) for c in ROTATION[1:]), F.col(ROTATION[0]) * F.col(ROTATION[0])))
        out |= {c: F.when(norm < min_norm, F.lit(float(k == 3))).otherwise(F.col(c) / F.greatest(norm, F.lit(min_norm))) for k, c in enumerate(ROTATION)}
    return out


def deactivations(min_scale: float = 1e-9, min_opacity: float = 1e-4, max_opacity: float = 1 - 1e-4) -> dict[str, Column]:
    """The way back: log of scales, logit of opacities; rotations stay."""
    if min_scale <= 0 or not 0 < min_opacity <= max_opacity < 1:
        raise ValueError("min_scale > 0 and 0 < min_opacity <= max_opacity < 1 are needed")
    p = clamp(F.col("opacity"), min_opacity, max_opacity)
    return {c: F.ln(F.greatest(F.col(c), F.lit(min_scale))) for c in SCALE} | {"opacity": F.ln(p / (F.lit(1.0) - p))}


def colours_to_rgb() -> dict[str, Column]:
    return {c: sh2rgb(F.col(c)) for c in COLOUR}


def colours_to_sh() -> dict[str, Column]:
    return {c: rgb2sh(F.col(c)) for c in COLOUR}
