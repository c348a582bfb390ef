"""Guesses the value domains of a table from its values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SCALE
from ..state import LINEAR, LOG


def domain_statistics(rows: DataFrame) -> DataFrame:
    """One row: n, share of negative scales, largest absolute scale, share of opacities in [0, 1]."""
    share = lambda test: F.avg(test.cast("int"))
    negative = sum((share(F.col(c) < 0) for c in SCALE[1:]), share(F.col(SCALE[0]) < 0)) / F.lit(3.0)
    return rows.agg(F.count("*").alias("n"), negative.alias("negative"), F.greatest(*[F.max(F.abs(F.col(c))) for c in SCALE]).alias("largest"), share(F.col("opacity").between(0, 1)).alias("in_range"))


def domains(rows: DataFrame) -> DataFrame:
    """One row (scales, opacities): ``log`` or ``linear``. Empty or uncertain tables count as log."""
    s = domain_statistics(rows)
    scales = F.when((F.col("negative") == 0) & (F.col("largest") < 10), F.lit(LINEAR)).otherwise(F.lit(LOG))
    return s.select(scales.alias("scales"), F.when(F.col("in_range") > 0.95, F.lit(LINEAR)).otherwise(F.lit(LOG)).alias("opacities"))
