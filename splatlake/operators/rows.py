"""Base rows (flat arrays of all properties), harmonics as bands, and dense row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BANDS, CENTRE, COLOUR, ROTATION, SCALE, degree_of_properties

MOST_BUCKETS = 100_000


def base_row() -> Column:
    """All properties of a row as one array in file order."""
    one = lambda names: F.array(*[F.col(c) for c in names])
    return F.concat(one((*CENTRE, *COLOUR)), F.col("f_rest"), one(("opacity", *SCALE, *ROTATION)))


def from_base_row(row: Column, count: int) -> dict[str, Column]:
    """The columns of a base row of ``count`` properties; unknown counts are a ValueError."""
    if degree_of_properties(count) is None:
        raise ValueError(f"no degree has {count} properties")
    rest = count - 14
    names = [*CENTRE, *COLOUR, "opacity", *SCALE, *ROTATION]
    places = [k if k < 6 else k + rest for k in range(14)]
    return {n: F.get(row, p) for n, p in zip(names, places, strict=True)} | {"f_rest": F.slice(row, 7, rest)}


def bands(f_rest: Column, degree: int) -> Column:
    """Channel-grouped coefficients as bands of three, listed explicitly so that the plan stays in generated code."""
    k = BANDS[degree]
    return F.array(*[F.array(*[F.get(f_rest, c * k + i) for c in range(3)]) for i in range(k)]) if k else F.array().cast("array<array<float>>")


def from_bands(shn: Column, degree: int) -> Column:
    k = BANDS[degree]
    return F.array(*[F.get(F.get(shn, i), c) for c in range(3) for i in range(k)]) if k else F.array().cast("array<float>")


def dense_gid(rows: DataFrame) -> DataFrame:
    """Numbers rows 0..n-1 in order of ``gid``.

    Rows fall into at most ``MOST_BUCKETS`` ranges of gid, whose counts make offsets; inside a range a row counts its predecessors. No
    task sees more than a range, and only the bounded table of offsets is broadcast.
    """
    top = rows.agg(F.max("gid")).first()[0] or 0
    width = max(1 << 16, top // MOST_BUCKETS + 1)
    bucketed = rows.withColumn("__bucket", F.floor(F.col("gid") / F.lit(width)).cast("long"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = bucketed.groupBy("__bucket").count()
    offsets = counts.select("__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy("gid")) - 1
    placed = bucketed.withColumn("__rank", rank).join(F.broadcast(offsets), "__bucket")
    return placed.withColumn("gid", (F.col("__offset") + F.col("__rank")).cast("long")).select(*rows.columns)
