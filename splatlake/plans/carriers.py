"""Given tables read as Gaussians, and the SQL that reads them alike. Values are DOUBLE, so both engines compute the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SCALARS

#: Elements of an embedding (from 1) by property: centre, colour, 45 harmonics, opacity, scales, rotation.
PLACES = dict(zip(SCALARS, (1, 2, 3, 4, 5, 6, 52, 53, 54, 55, 56, 57, 58, 59), strict=True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _element(k: int) -> Column:
    return F.get("embedding", k - 1).cast("double")


def embeddings(spark: SparkSession, sf_dir: str, kind: str = "plain", harmonics: bool = True) -> DataFrame:
    """``plain``; ``linear``: scales and opacities positive; ``wide``: scales by 60 and opacities by 20, which meets all clamps."""
    columns = {c: _element(k) for c, k in PLACES.items()}
    for c in columns:
        if c.startswith("scale") or c == "opacity":
            columns[c] = F.abs(columns[c]) if kind == "linear" else columns[c] * (60.0 if c != "opacity" else 20.0) if kind == "wide" else columns[c]
    rest = F.array(*[_element(k) for k in range(7, 52)]) if harmonics else F.array().cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gid"), *[c.alias(n) for n, c in columns.items()], rest.alias("f_rest"))


def embeddings_sql(kind: str = "plain") -> str:
    def one(c: str) -> str:
        v = f"embedding[{PLACES[c]}]::DOUBLE"
        if c.startswith("scale") or c == "opacity":
            v = f"abs({v})" if kind == "linear" else f"{v} * {60.0 if c != 'opacity' else 20.0}::DOUBLE" if kind == "wide" else v
        return f"{v} AS {c}"

    rest = "[" + ", ".join(f"embedding[{k}]::DOUBLE" for k in range(7, 52)) + "]"
    return f"SELECT vec_id AS gid, {', '.join(map(one, SCALARS))}, {rest} AS f_rest FROM embeddings"


#: property: (a, b, m, s): ((a * id + b * user) mod m) / s - m / (2 s), plus value / 1000 for x.
_MIX = dict(zip(SCALARS, ((7, 3, 1009, 100), (11, 5, 2003, 100), (13, 7, 3001, 100), (17, 1, 401, 200), (19, 1, 409, 200), (23, 1, 419, 200), (29, 1, 1201, 100), (31, 1, 601, 100),
                          (37, 1, 607, 100), (41, 1, 613, 100), (43, 1, 211, 100), (47, 1, 223, 100), (53, 1, 227, 100), (59, 1, 229, 100)), strict=True))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a Gaussian without higher harmonics: the bulk table."""
    def one(c: str) -> Column:
        a, b, m, s = _MIX[c]
        return ((F.col("event_id") * a + F.coalesce("user_id", F.lit(0)) * b) % m).cast("double") / float(s) - m / (2.0 * s)

    return table(spark, sf_dir, "events").select(F.col("event_id").alias("gid"), *[one(c).alias(c) for c in SCALARS], F.array().cast("array<double>").alias("f_rest"))


def events_sql() -> str:
    one = lambda c, a, b, m, s: f"((event_id * {a} + coalesce(user_id, 0) * {b}) % {m})::DOUBLE / {float(s)}::DOUBLE - {m / (2.0 * s)!r}::DOUBLE AS {c}"
    return f"SELECT event_id AS gid, {', '.join(one(c, *v) for c, v in _MIX.items())} FROM events"


def textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pixel, r, g, b, a): 16 pixels of each embedding."""
    byte = lambda k: F.floor((F.get("e", F.col("p") * 4 + k).cast("double") + 1.0) * 127.5).cast("long")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    return rows.select((F.col("vec_id") * 16 + F.col("p")).alias("pixel"), *[byte(k).alias(c) for k, c in enumerate("rgba")])


def textures_sql() -> str:
    byte = lambda k, c: f"floor((embedding[p * 4 + {k + 1}]::DOUBLE + 1.0::DOUBLE) * 127.5::DOUBLE)::BIGINT AS {c}"
    return f"SELECT vec_id * 16 + p AS pixel, {', '.join(byte(k, c) for k, c in enumerate('rgba'))} FROM embeddings, (SELECT unnest(range(16)) AS p)"
