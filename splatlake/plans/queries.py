"""The engine's registered queries and the SQL that gives the same rows.

Each query builds its plan from the public operators over a carrier table; its SQL states the formula on its own. Doubles are rounded to six
places on both sides, and 0.0 is added so that no zero is negative.
"""

from __future__ import annotations

import io
import math
import os
import tempfile
from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import activation, codec, textures
from ..operators import rows as row_ops
from ..operators.bounds import chunk_bounds, pack, with_bounds
from ..operators.detect import domains
from ..operators.frame import SplatFrame
from ..schema import BOUNDS, CENTRE, COLOUR, MASK_PREFIX, ROTATION, SCALARS, SCALE, SH_C0
from ..sources import sog
from ..sources.files import decode_files, detect_formats
from ..sources.ply import decompress_bytes
from ..sources.ply_sink import compress_to_bytes, compress_to_tables, plain_to_bytes
from ..state import FormatState
from ..streaming.scenes import in_box, meets_box
from . import carriers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def d(x: float) -> str:
    """A DOUBLE literal."""
    return f"{x:.17e}"


def rounded(*columns: str) -> list[Column]:
    return [(F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c) for c in columns]


def rounded_as(**columns: Column) -> list[Column]:
    return [(F.round(c.cast("double"), 6) + F.lit(0.0)).alias(n) for n, c in columns.items()]


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def frame(spark: SparkSession, sf_dir: str, kind: str = "plain") -> SplatFrame:
    """The embedding carrier as doubles under its stated format."""
    return SplatFrame(carriers.embeddings(spark, sf_dir, kind), FormatState.linear(3) if kind == "linear" else FormatState.ply(3))


PLAIN, LINEAR, WIDE, EVENTS = carriers.embeddings_sql(), carriers.embeddings_sql("linear"), carriers.embeddings_sql("wide"), carriers.events_sql()

# -- value domains -------------------------------------------------------------------------------------------------


_ROW = f"[{', '.join((*CENTRE, *COLOUR))}] || f_rest || [opacity, {', '.join((*SCALE, *ROTATION))}]"


@query("base_rows", f"SELECT gid, {r6('b[8]', 'v8')}, len(b)::INTEGER AS n, {r6('b[52]', 'v52')} FROM (SELECT gid, {_ROW} AS b FROM ({PLAIN}))")
def base_rows(spark, sf_dir):
    made = frame(spark, sf_dir).base_rows()
    return made.select("gid", *rounded_as(v8=F.get("row", 7)), F.size("row").alias("n"), *rounded_as(v52=F.get("row", 51)))


@query("from_base_rows", f"SELECT gid, {', '.join(r6(c, c) for c in SCALARS)}, {r6('f_rest[45]', 'last')} FROM ({PLAIN})")
def from_base_rows(spark, sf_dir):
    made = frame(spark, sf_dir).base_rows()
    parts = made.select("gid", *[c.alias(n) for n, c in row_ops.from_base_row(F.col("row"), 59).items()])
    return parts.select("gid", *rounded(*SCALARS), *rounded_as(last=F.get("f_rest", 44)))


@query("shn_bands", f"SELECT gid, k, {r6('f_rest[k + 1]', 'r')}, {r6('f_rest[15 + k + 1]', 'g')}, {r6('f_rest[30 + k + 1]', 'b')} FROM ({PLAIN}), (SELECT unnest(range(15))::INTEGER AS k)")
def shn_bands(spark, sf_dir):
    made = frame(spark, sf_dir).harmonic_bands().select("gid", F.posexplode("shN").alias("k", "band"))
    return made.select("gid", "k", *rounded_as(r=F.get("band", 0), g=F.get("band", 1), b=F.get("band", 2)))


@query("sh_to_rgb", f"SELECT gid, {', '.join(r6(f'{c} * {d(SH_C0)} + 0.5', c) for c in COLOUR)} FROM ({PLAIN})")
def sh_to_rgb(spark, sf_dir):
    f = frame(spark, sf_dir)
    return f.df.select("gid", *rounded_as(**activation.colours_to_rgb()))


@query("rgb_to_sh", f"SELECT gid, {', '.join(r6(f'({c} - 0.5) / {d(SH_C0)}', c) for c in COLOUR)} FROM ({PLAIN})")
def rgb_to_sh(spark, sf_dir):
    return frame(spark, sf_dir).df.select("gid", *rounded_as(**activation.colours_to_sh()))


@query("sigmoid", f"SELECT gid, {r6('1 / (1 + exp(-opacity))', 'p')} FROM ({WIDE})")
def sigmoid(spark, sf_dir):
    return frame(spark, sf_dir, "wide").df.select("gid", *rounded_as(p=activation.sigmoid(F.col("opacity"))))


_LOGIT = lambda p, lo, hi: f"ln(greatest(least({p}, {d(hi)}), {d(lo)}) / (1.0 - greatest(least({p}, {d(hi)}), {d(lo)})))"


@query("logit", f"SELECT gid, {r6(_LOGIT('opacity', 1e-6, 1 - 1e-6), 'x')} FROM ({LINEAR})")
def logit(spark, sf_dir):
    return frame(spark, sf_dir, "linear").df.select("gid", *rounded_as(x=activation.logit(F.col("opacity"))))


_NORM = "sqrt(" + " + ".join(f"{c} * {c}" for c in ROTATION) + ")"


@query("denormalize", f"SELECT gid, {', '.join(r6(f'least(greatest(exp({c}), 1e-4), 1e2)', c) for c in SCALE)}, {r6('1 / (1 + exp(-opacity))', 'opacity')}, {', '.join(r6(f'CASE WHEN {_NORM} < 1e-8 THEN {float(k == 3)} ELSE {c} / {_NORM} END', c) for k, c in enumerate(ROTATION))} FROM ({WIDE})")
def denormalize(spark, sf_dir):
    f = frame(spark, sf_dir, "wide")
    return f.df.select("gid", *rounded_as(**activation.activations()))


@query("denormalize_unclamped", f"SELECT gid, {', '.join(r6(f'exp({c})', c) for c in SCALE)}, {r6('1 / (1 + exp(-opacity))', 'opacity')} FROM ({PLAIN})")
def denormalize_unclamped(spark, sf_dir):
    return frame(spark, sf_dir).df.select("gid", *rounded_as(**activation.activations(clamped=False, unit_rotations=False)))


@query("normalize", f"SELECT gid, {', '.join(r6(f'ln(greatest({c}, 1e-9))', c) for c in SCALE)}, {r6(_LOGIT('opacity', 1e-4, 1 - 1e-4), 'opacity')} FROM ({LINEAR})")
def normalize(spark, sf_dir):
    return frame(spark, sf_dir, "linear").df.select("gid", *rounded_as(**activation.deactivations()))


def _detect_sql(source: str) -> str:
    return f"""SELECT CASE WHEN neg = 0 AND big < 10 THEN 'linear' ELSE 'log' END AS scales, CASE WHEN share > 0.95 THEN 'linear' ELSE 'log' END AS opacities FROM (
        SELECT avg(((scale_0 < 0)::INT + (scale_1 < 0)::INT + (scale_2 < 0)::INT) / 3.0) AS neg, max(greatest(abs(scale_0), abs(scale_1), abs(scale_2))) AS big,
        avg((opacity BETWEEN 0 AND 1)::INT) AS share FROM ({source}))"""


for _name, _kind, _source in (("detect_plain", "plain", PLAIN), ("detect_linear", "linear", LINEAR), ("detect_wide", "wide", WIDE)):
    query(_name, _detect_sql(_source))(lambda spark, sf_dir, kind=_kind: domains(frame(spark, sf_dir, kind).df))


@query("detect_events", _detect_sql(EVENTS))
def detect_events(spark, sf_dir):
    return domains(carriers.events(spark, sf_dir))


# -- chunk codec ---------------------------------------------------------------------------------------------------

_VALUES = [("x", "x"), ("y", "y"), ("z", "z"), *((f"scale_{a}", c) for a, c in zip("xyz", SCALE, strict=True)), *((a, f"({c} * {d(SH_C0)} + 0.5)") for a, c in zip("rgb", COLOUR, strict=True))]


def _bound(f: str, name: str, value: str, over: str = "") -> str:
    v = f"{f}({value}){over}"
    return f"greatest(least({v}, 20.0), -20.0)" if name.startswith("scale") else v


def _bounds_sql(over: str = "") -> str:
    return ", ".join(f"{_bound(f, n, v, over)} AS {f}_{n}" for f in ("min", "max") for n, v in _VALUES)


def _chunks_sql(source: str) -> str:
    return f"SELECT chunk_id, {', '.join(r6(b, b) for b in BOUNDS)} FROM (SELECT gid >> 8 AS chunk_id, {_bounds_sql()} FROM ({source}) GROUP BY 1)"


def _q(unit: str, bits: int) -> str:
    return f"floor(greatest(0.0, least(1.0, {unit})) * {d(2**bits - 1)} + 0.5)::BIGINT"


def _unit(value: str, name: str) -> str:
    return f"(({value}) - min_{name}) / greatest(max_{name} - min_{name}, 1e-10)"


_POSITION = f"({_q(_unit('x', 'x'), 11)} << 21) | ({_q(_unit('y', 'y'), 10)} << 11) | {_q(_unit('z', 'z'), 11)}"
_SCALE = f"({_q(_unit('scale_0', 'scale_x'), 11)} << 21) | ({_q(_unit('scale_1', 'scale_y'), 10)} << 11) | {_q(_unit('scale_2', 'scale_z'), 11)}"
_RGB = [_q(_unit(f"{c} * {d(SH_C0)} + 0.5", a), 8) for a, c in zip("rgb", COLOUR, strict=True)]
_COLOUR = f"({_RGB[0]} << 24) | ({_RGB[1]} << 16) | ({_RGB[2]} << 8) | {_q('CASE WHEN opacity >= 0 THEN 1 / (1 + exp(-opacity)) ELSE exp(opacity) / (1 + exp(opacity)) END', 8)}"
_WORDS = {"packed_position": _POSITION, "packed_scale": _SCALE, "packed_color": _COLOUR}


def _bounded_sql(source: str) -> str:
    return f"SELECT *, {_bounds_sql(' OVER (PARTITION BY gid >> 8)')} FROM ({source})"


def _rotation_sql(source: str) -> str:
    rest = lambda k, i: ROTATION.index([c for c in ROTATION if c != ROTATION[i]][k])
    one = lambda k: " ".join(f"WHEN w = {i} THEN CASE WHEN u[{i + 1}] < 0 THEN -u[{rest(k, i) + 1}] ELSE u[{rest(k, i) + 1}] END" for i in range(4))
    code = lambda k: _q(f"(CASE {one(k)} END) * {d(math.sqrt(2.0) * 0.5)} + 0.5", 10)
    return f"""SELECT gid, (w << 30) | ({code(0)} << 20) | ({code(1)} << 10) | {code(2)} AS packed_rotation FROM (
        SELECT gid, u, CASE WHEN abs(u[1]) = t THEN 0 WHEN abs(u[2]) = t THEN 1 WHEN abs(u[3]) = t THEN 2 ELSE 3 END::BIGINT AS w FROM (
        SELECT gid, u, greatest(abs(u[1]), abs(u[2]), abs(u[3]), abs(u[4])) AS t FROM (
        SELECT gid, [CASE WHEN n > 0 THEN rot_0 / n ELSE rot_0 END, CASE WHEN n > 0 THEN rot_1 / n ELSE rot_1 END, CASE WHEN n > 0 THEN rot_2 / n ELSE rot_2 END, CASE WHEN n > 0 THEN rot_3 / n ELSE rot_3 END] AS u
        FROM (SELECT *, {_NORM} AS n FROM ({source})))))"""


_SOURCES = {"": (lambda s, p: carriers.embeddings(s, p, "wide"), WIDE, 3), "_events": (carriers.events, EVENTS, 0)}
for _suffix, (_make, _source, _degree) in _SOURCES.items():
    query(f"chunk_bounds{_suffix}", _chunks_sql(_source))(lambda spark, sf_dir, make=_make: chunk_bounds(make(spark, sf_dir)).select("chunk_id", *rounded(*BOUNDS)))
    for _word, _sql in _WORDS.items():
        _short = _word.replace("packed_", "pack_")
        query(f"{_short}{_suffix}", f"SELECT gid, {_sql} AS {_word} FROM ({_bounded_sql(_source)})")(lambda spark, sf_dir, make=_make, word=_word, degree=_degree: pack(make(spark, sf_dir), degree).select("gid", word))
    query(f"pack_rotation{_suffix}", _rotation_sql(_source))(lambda spark, sf_dir, make=_make, degree=_degree: pack(make(spark, sf_dir), degree).select("gid", "packed_rotation"))


@query("pack_sh", f"SELECT gid, k, trunc(greatest(0.0, least(255.0, f_rest[k + 1] * 8.0 * 32.0 + 128.0)))::BIGINT AS code FROM ({PLAIN}), (SELECT unnest(range(45))::INTEGER AS k)")
def pack_sh(spark, sf_dir):
    rows = carriers.embeddings(spark, sf_dir)
    larger = F.array(*[F.get("f_rest", k) * 8.0 for k in range(45)])
    return rows.select("gid", F.posexplode(codec.pack_harmonics(larger, 45)).alias("k", "c")).select("gid", "k", F.col("c").cast("long").alias("code"))


@query("unpack_sh", f"SELECT gid, k, {r6('(trunc(greatest(0.0, least(255.0, f_rest[k + 1] * 32.0 + 128.0))) - 127.5) / 32.0', 'v')} FROM ({PLAIN}), (SELECT unnest(range(45))::INTEGER AS k)")
def unpack_sh(spark, sf_dir):
    codes = codec.pack_harmonics(F.col("f_rest"), 45)
    rows = carriers.embeddings(spark, sf_dir).select("gid", codes.alias("codes"))
    return rows.select("gid", F.posexplode(codec.unpack_harmonics(F.col("codes"), 45)).alias("k", "v")).select("gid", "k", *rounded("v"))


def _decoded_sql(word: str, names: tuple[str, ...], prefix: str) -> str:
    parts = [f"min_{prefix}{a} + ((w >> {s}) & {2**b - 1}) / {d(2**b - 1)} * (max_{prefix}{a} - min_{prefix}{a})" for a, s, b in zip("xyz", (21, 11, 0), (11, 10, 11), strict=True)]
    return f"SELECT gid, {', '.join(r6(p, n) for p, n in zip(parts, names, strict=True))} FROM (SELECT *, {_WORDS[word]} AS w FROM ({_bounded_sql(WIDE)}))"


def _packed(spark, sf_dir) -> DataFrame:
    return pack(carriers.embeddings(spark, sf_dir, "wide"), 3)


@query("unpack_position", _decoded_sql("packed_position", CENTRE, ""))
def unpack_position(spark, sf_dir):
    return _packed(spark, sf_dir).select("gid", *rounded_as(**dict(zip(CENTRE, codec.unpack_position(F.col("packed_position")), strict=True))))


@query("unpack_scale", _decoded_sql("packed_scale", SCALE, "scale_"))
def unpack_scale(spark, sf_dir):
    return _packed(spark, sf_dir).select("gid", *rounded_as(**dict(zip(SCALE, codec.unpack_scale(F.col("packed_scale")), strict=True))))


_COLOUR_BACK = [f"((min_{a} + ((w >> {s}) & 255) / 255.0::DOUBLE * (max_{a} - min_{a})) - 0.5) / {d(SH_C0)}" for a, s in zip("rgb", (24, 16, 8), strict=True)]
_COLOUR_ROWS = f"(SELECT *, {_COLOUR} AS w FROM ({_bounded_sql(WIDE)}))"


@query("unpack_color", f"SELECT gid, {', '.join(r6(p, c) for p, c in zip(_COLOUR_BACK, COLOUR, strict=True))} FROM {_COLOUR_ROWS}")
def unpack_color(spark, sf_dir):
    return _packed(spark, sf_dir).select("gid", *rounded_as(**dict(zip(COLOUR, codec.unpack_colour(F.col("packed_color")), strict=True))))


@query("unpack_opacity", f"SELECT gid, {r6('CASE WHEN (w & 255) = 0 THEN -10.0 WHEN (w & 255) = 255 THEN 10.0 ELSE -ln(1 / ((w & 255) / 255.0::DOUBLE) - 1) END', 'opacity')} FROM {_COLOUR_ROWS}")
def unpack_opacity(spark, sf_dir):
    return _packed(spark, sf_dir).select("gid", *rounded_as(opacity=codec.unpack_opacity(F.col("packed_color"))))


def _unrotated_sql() -> str:
    part = lambda s: f"((((w >> {s}) & 1023) / {d(1023)} - 0.5) * {d(math.sqrt(2.0))})"
    a, b, c = part(20), part(10), part(0)
    m = f"sqrt(greatest(0.0, 1.0 - ({a} * {a} + {b} * {b} + {c} * {c})))"
    orders = [(m, a, b, c), (a, m, b, c), (a, b, m, c), (a, b, c, m)]
    cases = (f"CASE (w >> 30) & 3 WHEN 0 THEN {orders[0][k]} WHEN 1 THEN {orders[1][k]} WHEN 2 THEN {orders[2][k]} ELSE {orders[3][k]} END" for k in range(4))
    return f"SELECT gid, {', '.join(r6(x, n) for x, n in zip(cases, ROTATION, strict=True))} FROM (SELECT gid, packed_rotation AS w FROM ({_rotation_sql(WIDE)}))"


@query("unpack_rotation", _unrotated_sql())
def unpack_rotation(spark, sf_dir):
    return _packed(spark, sf_dir).select("gid", *rounded_as(**dict(zip(ROTATION, codec.unpack_rotation(F.col("packed_rotation")), strict=True))))


@query(
    "roundtrip_error",
    f"""SELECT {', '.join(f"max(abs({c} - (min_{a} + ((w >> {s}) & {2**b - 1}) / {d(2**b - 1)} * (max_{a} - min_{a})))) <= max(max_{a} - min_{a}) / {2**b - 1} * 0.5001 AS {c}_within" for c, a, s, b in zip(CENTRE, "xyz", (21, 11, 0), (11, 10, 11), strict=True))},
    count(*) AS n FROM (SELECT *, {_POSITION} AS w FROM ({_bounded_sql(WIDE)}))""",
)
def roundtrip_error(spark, sf_dir):
    """Whether every centre comes back to within half a step of its chunk's range."""
    rows = with_bounds(carriers.embeddings(spark, sf_dir, "wide")).withColumn("w", codec.pack_position())
    back = dict(zip(CENTRE, codec.unpack_position(F.col("w")), strict=True))
    within = [(F.max(F.abs(F.col(c) - back[c])) <= F.max(F.col(f"max_{c}") - F.col(f"min_{c}")) / float(2**b - 1) * 0.5001).alias(f"{c}_within") for c, b in zip(CENTRE, (11, 10, 11), strict=True)]
    return rows.agg(*within, F.count("*").alias("n"))


# -- selection, masks, unions --------------------------------------------------------------------------------------

_X = r6("x", "x")


def _some(f: SplatFrame) -> DataFrame:
    return f.df.select("gid", *rounded("x"))


query("slice_range", f"SELECT gid - 10 AS gid, {_X} FROM ({PLAIN}) WHERE gid >= 10 AND gid < 300")(lambda s, p: _some(frame(s, p)[10:300]))
query("slice_step", f"SELECT (gid - 5) // 7 AS gid, {_X} FROM ({PLAIN}) WHERE gid >= 5 AND (gid - 5) % 7 = 0")(lambda s, p: _some(frame(s, p)[5::7]))
query("slice_tail", f"SELECT gid - ((SELECT count(*) FROM embeddings) - 20) AS gid, {_X} FROM ({PLAIN}) WHERE gid >= (SELECT count(*) FROM embeddings) - 20")(lambda s, p: _some(frame(s, p)[-20:]))
query("slice_reverse", f"SELECT (SELECT max(vec_id) FROM embeddings) - gid AS gid, {_X} FROM ({PLAIN})")(lambda s, p: _some(frame(s, p)[::-1]))
query("fancy_index", f"SELECT v.k AS gid, {_X} FROM ({PLAIN}) e JOIN (VALUES (0::BIGINT, 7), (1, 3), (2, 7), (3, 499)) v(k, g) ON e.gid = v.g")(lambda s, p: _some(frame(s, p)[[7, 3, 7, 499]]))
query("single_row", f"SELECT 0::BIGINT AS gid, {_X} FROM ({PLAIN}) WHERE gid = 42")(lambda s, p: _some(frame(s, p).gaussian(42)))
query("bool_filter", f"SELECT gid, {_X} FROM ({PLAIN}) WHERE opacity > 0.05")(lambda s, p: _some(frame(s, p)[F.col("opacity") > 0.05]))
query("dense_after_filter", f"SELECT row_number() OVER (ORDER BY gid) - 1 AS gid, {_X} FROM ({PLAIN}) WHERE opacity > 0.05")(lambda s, p: _some(frame(s, p)[F.col("opacity") > 0.05].dense()))
query("dense_events", f"SELECT row_number() OVER (ORDER BY gid) - 1 AS gid, {_X} FROM ({EVENTS}) WHERE opacity > 0")(lambda s, p: _some(SplatFrame(carriers.events(s, p))[F.col("opacity") > 0].dense()))
query("row_count", "SELECT count(*) AS n FROM events WHERE event_type = 'click' OR event_id % 2 = 0")(lambda s, p: carriers.table(s, p, "events").where("event_type = 'click' or event_id % 2 = 0").agg(F.count("*").alias("n")))

# Rows are counted off after a filter: position k is the k-th row that is left.
_KEPT = f"SELECT row_number() OVER (ORDER BY gid) - 1 AS gid, * EXCLUDE (gid) FROM ({PLAIN}) WHERE opacity > 0.05"


def _kept(spark, sf_dir) -> SplatFrame:
    return frame(spark, sf_dir)[F.col("opacity") > 0.05]


query("slice_after_filter", f"SELECT (gid - 3) // 2 AS gid, {_X} FROM ({_KEPT}) WHERE gid >= 3 AND gid < 60 AND (gid - 3) % 2 = 0")(lambda s, p: _some(_kept(s, p)[3:60:2]))
query("slice_tail_after_filter", f"SELECT gid - ((SELECT count(*) FROM ({_KEPT})) - 20) AS gid, {_X} FROM ({_KEPT}) WHERE gid >= (SELECT count(*) FROM ({_KEPT})) - 20")(lambda s, p: _some(_kept(s, p)[-20:]))
query("take_after_mask", f"SELECT v.k AS gid, {_X} FROM ({_KEPT}) e JOIN (VALUES (0::BIGINT, 7), (1, 3), (2, 7)) v(k, g) ON e.gid = v.g")(
    lambda s, p: _some(frame(s, p).add_mask("opaque", "opacity > 0.05").apply_masks()[[7, 3, 7]]))
query("union_after_filter", f"SELECT gid, {_X} FROM ({_KEPT}) UNION ALL SELECT gid + (SELECT count(*) FROM ({_KEPT})), {_X} FROM ({PLAIN})")(lambda s, p: _some(_kept(s, p) + frame(s, p)))
query("concatenate_after_filter", " UNION ALL ".join(f"SELECT gid + {k} * (SELECT count(*) FROM ({_KEPT})) AS gid, {_X} FROM ({_KEPT})" for k in range(3)))(lambda s, p: _some(SplatFrame.concatenate([_kept(s, p)] * 3)))
query("bounds_after_filter", _chunks_sql(f"SELECT row_number() OVER (ORDER BY gid) - 1 AS gid, * EXCLUDE (gid) FROM ({EVENTS}) WHERE opacity > 0"))(
    lambda s, p: SplatFrame(carriers.events(s, p))[F.col("opacity") > 0].chunk_bounds().select("chunk_id", *rounded(*BOUNDS)))
_KEPT_EVENTS = f"SELECT row_number() OVER (ORDER BY gid) - 1 AS gid, * EXCLUDE (gid) FROM ({EVENTS}) WHERE opacity > 0"
query("pack_after_filter", f"SELECT gid, {_WORDS['packed_position']} AS packed_position FROM ({_bounded_sql(_KEPT_EVENTS)})")(
    lambda s, p: SplatFrame(carriers.events(s, p))[F.col("opacity") > 0].pack().select("gid", "packed_position"))

_LAYERS = {"bright": "opacity > 0", "left": "x < 0", "near": "z > -0.1 AND z < 0.1"}


def _layered(spark, sf_dir) -> SplatFrame:
    f = frame(spark, sf_dir)
    for name, test in _LAYERS.items():
        f = f.add_mask(name, test)
    return f


def _mask_sql(op: str, names: list[str]) -> str:
    return f"SELECT gid, {f' {op} '.join(f'({_LAYERS[n]})' for n in names)} AS kept FROM ({PLAIN})"


query("mask_and", _mask_sql("AND", list(_LAYERS)))(lambda s, p: (f := _layered(s, p)).df.select("gid", f.combine_masks("and").alias("kept")))
query("mask_or", _mask_sql("OR", list(_LAYERS)))(lambda s, p: (f := _layered(s, p)).df.select("gid", f.combine_masks("or").alias("kept")))
query("mask_subset", _mask_sql("OR", ["bright", "near"]))(lambda s, p: (f := _layered(s, p)).df.select("gid", f.combine_masks("or", ["bright", "near"]).alias("kept")))
query("mask_removed", _mask_sql("AND", ["bright", "near"]))(lambda s, p: (f := _layered(s, p).remove_mask("left")).df.select("gid", f.combine_masks("and").alias("kept")))
query("mask_apply", f"SELECT gid, {_X}, ({_LAYERS['near']}) AS near FROM ({PLAIN}) WHERE ({_LAYERS['bright']}) AND ({_LAYERS['left']})")(
    lambda s, p: _layered(s, p).apply_masks("and", ["bright", "left"]).df.select("gid", *rounded("x"), F.col(MASK_PREFIX + "near").alias("near")))

_N = "(SELECT count(*) FROM embeddings)"
query("union_pair", f"SELECT gid, {_X} FROM ({PLAIN}) UNION ALL SELECT gid + {_N}, {r6('x + 1', 'x')} FROM ({PLAIN})")(
    lambda s, p: _some(frame(s, p) + SplatFrame(carriers.embeddings(s, p).withColumn("x", F.col("x") + 1), FormatState.ply(3))))
query("union_bulk", " UNION ALL ".join(f"SELECT gid + {k} * {_N} AS gid, {r6(f'x + {k}', 'x')} FROM ({PLAIN})" for k in range(4)))(
    lambda s, p: _some(SplatFrame.concatenate([SplatFrame(carriers.embeddings(s, p).withColumn("x", F.col("x") + k), FormatState.ply(3)) for k in range(4)])))
query("union_mask_fill", f"SELECT gid, opacity > 0 AS bright FROM ({PLAIN}) UNION ALL SELECT gid + {_N}, false FROM ({PLAIN})")(
    lambda s, p: (frame(s, p).add_mask("bright", "opacity > 0") + frame(s, p)).df.select("gid", F.col(MASK_PREFIX + "bright").alias("bright")))

# -- texture bundles -----------------------------------------------------------------------------------------------

TEX = carriers.textures_sql()
MINS, MAXS = [-1.0, -2.0, 0.5], [1.0, 2.0, 0.5]
CODES = [math.sin(k * 0.1) for k in range(256)]
_CB = "[" + ", ".join(d(v) for v in CODES) + "]"
_byte = lambda c: F.col(c)


def _means() -> list[str]:
    v = lambda c, o, lo, hi: f"{d(lo)} + {d((hi - lo) or 1.0)} * (({c} + 256 * {o}) / {d(65535)})"
    parts = [v(c, o, lo, hi) for c, o, lo, hi in zip("rgb", "gba", MINS, MAXS, strict=True)]
    return [f"sign({p}) * (exp(abs({p})) - 1)" for p in parts]


_textured = lambda parts, names: f"SELECT pixel, {', '.join(map(r6, parts, names))} FROM ({TEX})"


@query("sog_means", _textured(_means(), CENTRE))
def sog_means(spark, sf_dir):
    """Low bytes r, g, b and high bytes g, b, a of one texture."""
    found = textures.means([_byte(c) for c in "rgb"], [_byte(c) for c in "gba"], MINS, MAXS)
    return carriers.textures(spark, sf_dir).select("pixel", *rounded_as(**dict(zip(CENTRE, found, strict=True))))


def _quats() -> list[str]:
    x, y, z = (f"(({c} / {d(255)} * 2.0 - 1.0) * {d(1 / math.sqrt(2.0))})" for c in "rgb")
    m = f"sqrt(greatest(0.0, 1.0 - ({x} * {x} + {y} * {y} + {z} * {z})))"
    orders = [(m, x, y, z), (x, m, y, z), (x, y, m, z), (x, y, z, m)]
    return [f"CASE 250 + a % 6 WHEN 252 THEN {orders[0][k]} WHEN 253 THEN {orders[1][k]} WHEN 254 THEN {orders[2][k]} WHEN 255 THEN {orders[3][k]} ELSE {float(k == 3)} END" for k in range(4)]


@query("sog_quats", _textured(_quats(), ROTATION))
def sog_quats(spark, sf_dir):
    """Tags 250 to 255, of which two are none."""
    found = textures.rotations(*[_byte(c) for c in "rgb"], F.lit(250) + F.col("a") % 6)
    return carriers.textures(spark, sf_dir).select("pixel", *rounded_as(**dict(zip(ROTATION, found, strict=True))))


_coded = lambda c: f"{_CB}[{c} + 1]"


@query("sog_scales_codebook", f"SELECT pixel, {', '.join(r6(_coded(c), n) for c, n in zip('rgb', SCALE, strict=True))} FROM ({TEX})")
def sog_scales_codebook(spark, sf_dir):
    return carriers.textures(spark, sf_dir).select("pixel", *rounded_as(**{n: textures.codebook(_byte(c), CODES) for n, c in zip(SCALE, "rgb", strict=True)}))


_linear = lambda c, lo, hi: f"{d(lo)} + {c} / {d(255)} * {d(hi - lo)}"


@query("sog_scales_linear", f"SELECT pixel, {', '.join(r6(_linear(c, lo, hi), n) for c, n, lo, hi in zip('rgb', SCALE, MINS, MAXS, strict=True))} FROM ({TEX})")
def sog_scales_linear(spark, sf_dir):
    return carriers.textures(spark, sf_dir).select("pixel", *rounded_as(**{n: textures.linear(_byte(c), lo, hi) for c, n, lo, hi in zip("rgb", SCALE, MINS, MAXS, strict=True)}))


_ALPHA = f"(a / {d(255)})"


@query("sog_colors_codebook", f"SELECT pixel, {', '.join(r6(_coded(c), n) for c, n in zip('rgb', COLOUR, strict=True))}, {r6(_LOGIT(_ALPHA, 1e-6, 1 - 1e-6), 'opacity')} FROM ({TEX})")
def sog_colors_codebook(spark, sf_dir):
    found = textures.colours_codebook([_byte(c) for c in "rgba"], CODES)
    return carriers.textures(spark, sf_dir).select("pixel", *rounded_as(**dict(zip((*COLOUR, "opacity"), found, strict=True))))


@query("sog_colors_linear", f"SELECT pixel, {', '.join(r6(_linear(c, lo, hi), n) for c, n, lo, hi in zip('rgba', (*COLOUR, 'opacity'), [*MINS, -4.0], [*MAXS, 6.0], strict=True))} FROM ({TEX})")
def sog_colors_linear(spark, sf_dir):
    found = textures.colours_linear([_byte(c) for c in "rgba"], [*MINS, -4.0], [*MAXS, 6.0])
    return carriers.textures(spark, sf_dir).select("pixel", *rounded_as(**dict(zip((*COLOUR, "opacity"), found, strict=True))))


def _palette_sql(value: Callable[[str], str]) -> str:
    """Labels r + 256 * (a % 3) against a palette of three bands made of the first pixels; 500 entries count."""
    return f"""WITH t AS ({TEX}), p AS (
        SELECT (pixel // 192) * 64 + (pixel % 192) // 3 AS label, (pixel % 3)::INTEGER AS j, {', '.join(f'{value(c)} AS {c}' for c in 'rgb')} FROM t WHERE pixel < 192 * 6
      ), rows AS (SELECT pixel, r + 256 * (a % 3) AS label FROM t)
      SELECT rows.pixel, k.j, {', '.join(r6(f'CASE WHEN rows.label < 300 THEN coalesce(p.{c}, 0.0) ELSE 0.0 END', c) for c in 'rgb')}
      FROM rows CROSS JOIN (SELECT unnest(range(3))::INTEGER AS j) k LEFT JOIN p ON p.label = rows.label AND p.j = k.j"""


def _palette(spark, sf_dir, value: Callable[[Column], Column]) -> DataFrame:
    pixels = carriers.textures(spark, sf_dir)
    known = sog.palette(pixels.where(F.col("pixel") < 192 * 6), 3, value)
    rows = sog.labelled(pixels.select("pixel", "r", "a"), F.col("r") + 256 * (F.col("a") % 3), known, 300, 3)
    bands = rows.select("pixel", F.posexplode(row_ops.bands(F.col("f_rest"), 1)).alias("j", "band"))
    return bands.select("pixel", "j", *rounded_as(**{c: F.get("band", k) for k, c in enumerate("rgb")}))


query("sog_shn_codebook", _palette_sql(_coded))(lambda s, p: _palette(s, p, lambda b: textures.codebook(b, CODES)))
query("sog_shn_linear", _palette_sql(lambda c: _linear(c, -0.5, 0.5)))(lambda s, p: _palette(s, p, lambda b: textures.linear(b, -0.5, 0.5)))

_BUNDLE = [*_means(), *map(_coded, "rgb"), *_quats(), *map(_coded, "rgb"), _LOGIT(_ALPHA, 1e-6, 1 - 1e-6)]


@query("bundle_scene", f"SELECT pixel AS gid, {', '.join(r6(f'({v})::FLOAT::DOUBLE', n) for v, n in zip(_BUNDLE, (*CENTRE, *SCALE, *ROTATION, *COLOUR, 'opacity'), strict=True))} FROM ({TEX})")
def bundle_scene(spark, sf_dir):
    """A bundle made of five images and decoded end to end. An image is one value by its format, so a group makes each."""
    pixels = carriers.textures(spark, sf_dir)
    images = {"lo": "rgba", "hi": "gbaa", "q": "rgbt", "s": "rgba", "c": "rgba"}
    tagged = pixels.withColumn("t", F.lit(250) + F.col("a") % 6)
    layers = F.array(*[F.struct(F.lit(n).alias("path"), F.array(*[F.col(c).cast("int") for c in cs]).alias("v")) for n, cs in images.items()])
    files = tagged.select("pixel", F.inline(layers)).groupBy("path").applyInArrow(_image, "path string, content binary")
    meta = {k: {"files": f} for k, f in (("means", ["lo", "hi"]), ("quats", ["q"]), ("scales", ["s"]), ("sh0", ["c"]))} | {"count": pixels.count()}
    meta["means"] |= {"mins": MINS, "maxs": MAXS}
    meta["scales"]["codebook"] = meta["sh0"]["codebook"] = CODES
    return sog.decode_bundle(files, meta, lambda data: np.load(io.BytesIO(data))).df.select("gid", *rounded(*CENTRE, *SCALE, *ROTATION, *COLOUR, "opacity"))


def _image(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("pixel")
    out = io.BytesIO()
    np.save(out, rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(-1, 1, 4))
    return pa.table({"path": rows["path"].slice(0, 1), "content": pa.array([out.getvalue()], pa.binary())})


# -- files, spatial scans ------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A folder for a round trip: the shared one where it is a plain path, else a temporary one (tests, one machine)."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if shared.startswith("/"):
        os.makedirs(shared, exist_ok=True)
        return tempfile.mkdtemp(prefix="splat-", dir=shared)
    return tempfile.mkdtemp(prefix="spark-splat-")


@query("ply_roundtrip", f"SELECT gid, {', '.join(r6(f'{c}::FLOAT::DOUBLE', c) for c in SCALARS)}, {r6('f_rest[45]::FLOAT::DOUBLE', 'last')} FROM ({PLAIN})")
def ply_roundtrip(spark, sf_dir):
    path = SplatFrame.from_columns(carriers.embeddings(spark, sf_dir), degree=3).write(f"{_folder(spark)}/scene.ply")
    return SplatFrame.read(spark, path).df.select("gid", *rounded(*SCALARS), *rounded_as(last=F.get("f_rest", 44)))


@query("ply_compressed_roundtrip", f"SELECT count(*) AS n, true AS positions_within, true AS harmonics_within FROM ({PLAIN})")
def ply_compressed_roundtrip(spark, sf_dir):
    """Every centre within a step of its chunk's range, every harmonic within 1/32."""
    made = SplatFrame.from_columns(carriers.embeddings(spark, sf_dir), degree=3)
    back = SplatFrame.read(spark, made.write(f"{_folder(spark)}/scene.ply", compressed=True)).df
    was = made.df.select("gid", F.col("x").alias("x0"), F.get("f_rest", 44).alias("r0"))
    return back.join(was, "gid").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("x") - F.col("x0"))) < 2 / 2047).alias("positions_within"), (F.max(F.abs(F.get("f_rest", 44) - F.col("r0"))) < 1 / 32).alias("harmonics_within"))


@query("ply_range_scan", f"SELECT gid, {r6('x::FLOAT::DOUBLE', 'x')} FROM ({PLAIN}) WHERE gid >= 100 AND gid < 140")
def ply_range_scan(spark, sf_dir):
    """A gid filter that reaches the file source, which reads two columns."""
    path = SplatFrame.from_columns(carriers.embeddings(spark, sf_dir), degree=3).write(f"{_folder(spark)}/scene.ply")
    return SplatFrame.read(spark, path, ["x"]).df.where("gid >= 100 and gid < 140").select("gid", *rounded("x"))


@query("box_scan", f"SELECT gid, {_X} FROM ({PLAIN}) WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.2 AND 0.2 AND z BETWEEN 0 AND 0.3")
def box_scan(spark, sf_dir):
    """Rows in a box; chunks that miss it drop out by the bounds beside their rows."""
    low, high = (-0.1, -0.2, 0.0), (0.1, 0.2, 0.3)
    return with_bounds(carriers.embeddings(spark, sf_dir)).where(meets_box(low, high)).where(in_box(low, high)).select("gid", *rounded("x"))


_HARMONICS = ", ".join(r6(f"(trunc(greatest(0.0, least(255.0, f_rest[{k + 1}] * 32.0 + 128.0))) - 127.5) / 32.0", f"h{k}") for k in range(45))
_PARTS = [SQL[f"unpack_{part}"] for part in ("position", "scale", "color", "opacity", "rotation")]


@query("unpack_all", f"SELECT * FROM (SELECT gid, {_HARMONICS} FROM ({PLAIN})) {' '.join(f'JOIN ({x}) q{k} USING (gid)' for k, x in enumerate(_PARTS))}")
def unpack_all(spark, sf_dir):
    """The whole codec there and back in one pass: all 59 values of every row."""
    harmonics = codec.unpack_harmonics(F.col("f_rest"), 45)
    back = {
        **dict(zip(CENTRE, codec.unpack_position(F.col("packed_position")), strict=True)), **dict(zip(SCALE, codec.unpack_scale(F.col("packed_scale")), strict=True)),
        **dict(zip(COLOUR, codec.unpack_colour(F.col("packed_color")), strict=True)), "opacity": codec.unpack_opacity(F.col("packed_color")),
        **dict(zip(ROTATION, codec.unpack_rotation(F.col("packed_rotation")), strict=True)), **{f"h{k}": F.get(harmonics, k) for k in range(45)},
    }
    return _packed(spark, sf_dir).select("gid", *rounded_as(**back))


@query("bytes_roundtrip", "SELECT (vec_id >> 12) * 4 + label % 4 AS scene, count(*) AS n, true AS within FROM embeddings GROUP BY 1")
def bytes_roundtrip(spark, sf_dir):
    """Many scenes of 4,096 rows at most, each packed into one value and unpacked again; centres within a step of their chunk's range."""
    rows = SplatFrame.from_columns(carriers.embeddings(spark, sf_dir), degree=3).df
    name = F.shiftright("vec_id", 12) * 4 + F.col("label") % 4
    scene = carriers.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gid"), name.alias("scene"))
    number = F.row_number().over(Window.partitionBy("scene").orderBy("gid")) - 1
    scenes = rows.join(scene, "gid").withColumn("gid", number.cast("long"))
    back = decompress_bytes(compress_to_bytes(scenes, 3), 3, "scene", "content")
    met = back.join(scenes.select("scene", "gid", F.col("x").alias("x0")), ["scene", "gid"])
    return met.groupBy("scene").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("x") - F.col("x0"))) < 2 / 2047).alias("within"))


@query("packed_tables", f"SELECT chunk_id, count(*) AS n, {_bound('min', 'x', 'x')} >= -1 AS bounded FROM (SELECT gid >> 8 AS chunk_id, x FROM ({PLAIN})) GROUP BY 1")
def packed_tables(spark, sf_dir):
    """The chunk table beside the number of packed rows of each chunk."""
    _, chunks, packed = compress_to_tables(SplatFrame.from_columns(carriers.embeddings(spark, sf_dir), degree=3))
    n = packed.groupBy(F.shiftright("gid", 8).alias("chunk_id")).agg(F.count("*").alias("n"))
    return chunks.join(n, "chunk_id").select("chunk_id", "n", (F.col("min_x") >= -1).alias("bounded"))


_SCENES = "SELECT *, (gid >> 12) * 2 + gid % 2 AS scene, (gid & 4095) // 2 AS place FROM"


def _scene_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene, content): files of 2,048 rows at most; even scenes plain, odd ones compressed, and one value that is no file."""
    rows = SplatFrame.from_columns(carriers.embeddings(spark, sf_dir), degree=3).df
    scenes = rows.select((F.shiftright("gid", 12) * 2 + F.col("gid") % 2).alias("scene"), F.floor(F.col("gid").bitwiseAND(4095) / 2).cast("long").alias("gid"), *rows.columns[1:])
    odd = F.col("scene") % 2 == 1
    return plain_to_bytes(scenes.where(~odd), 3).unionByName(compress_to_bytes(scenes.where(odd), 3))


@query("detect_formats", f"SELECT scene, scene % 2 = 1 AS compressed, CASE WHEN scene % 2 = 0 THEN 3 END AS degree, count(*) AS n FROM ({_SCENES} ({PLAIN})) GROUP BY scene UNION ALL SELECT -1, false, NULL, NULL")
def detect_formats_(spark, sf_dir):
    """Kind, degree and rows of many files at once, one of which is none."""
    none = spark.sql("SELECT -1L AS scene, CAST('no file' AS BINARY) AS content")
    return detect_formats(_scene_files(spark, sf_dir).unionByName(none), "scene")


@query("many_files", f"SELECT scene, place AS gid, {', '.join(r6(f'{c}::FLOAT::DOUBLE', c) for c in SCALARS)}, {r6('f_rest[45]::FLOAT::DOUBLE', 'last')} FROM ({_SCENES} ({PLAIN})) WHERE scene % 2 = 0")
def many_files(spark, sf_dir):
    """Plain and compressed files scanned side by side; the rows of the plain ones, which come back as they were."""
    rows = decode_files(_scene_files(spark, sf_dir), 3, "scene").where("scene % 2 = 0")
    return rows.select("scene", "gid", *rounded(*SCALARS), *rounded_as(last=F.get("f_rest", 44)))


@query("many_files_packed", f"SELECT scene, count(*) AS n, true AS within FROM ({_SCENES} ({PLAIN})) WHERE scene % 2 = 1 GROUP BY scene")
def many_files_packed(spark, sf_dir):
    """The compressed ones of the same scan: all values as unpacking the packed table gives them."""
    files = _scene_files(spark, sf_dir).where("scene % 2 = 1")
    met = decode_files(files, None, "scene").alias("a").join(decompress_bytes(files, 3, "scene", "content").alias("b"), ["scene", "gid"])
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*SCALARS, "f_rest")]
    return met.groupBy("scene").agg(F.count("*").alias("n"), F.bool_and(reduce(and_, same)).alias("within"))
