"""SplatFrame: a lazy, immutable table of Gaussians with its value domains and named mask layers.

Every method returns a new frame over a longer plan; nothing runs until an action. Masks are boolean columns ``mask__<name>``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import activation
from ..schema import BANDS, CENTRE, COLOUR, GAUSSIANS, MASK_PREFIX, ROTATION, SCALARS, SCALE, degree_of_bands
from ..state import LINEAR, LOG, RGB, SH, FormatState
from .bounds import chunk_bounds, pack, unpack
from .detect import domains
from .rows import bands, base_row, dense_gid, from_base_row, from_bands


class SplatFrame:
    """A DataFrame of Gaussians, its FormatState, and its mask layers in order.

    ``gaps``: whether gids may have gaps since rows were filtered away; None where only the caller says that they run from 0 to n-1. Positional
    operations, unions and packing number such rows anew first, which nothing else does.
    """

    def __init__(self, df: DataFrame, state: FormatState | None = None, masks: Sequence[str] = (), gaps: bool | None = None) -> None:
        self.df, self.state, self.masks, self.gaps = df, state or FormatState(), tuple(masks), gaps

    # -- making ----------------------------------------------------------------------------------------------------

    @classmethod
    def from_columns(cls, df: DataFrame, format: str = "ply", degree: int = 0) -> SplatFrame:  # noqa: A002
        """From a DataFrame with the engine's columns. ``format``: ply, linear or rasterizer (the same), or auto, which runs one job.

        A row whose f_rest hasn't the number of values of ``degree`` fails the query that reads it.
        """
        if format not in ("auto", "ply", "linear", "rasterizer"):
            raise ValueError(f"unknown format {format!r}")
        if missing := {"gid", *SCALARS} - set(df.columns):
            raise KeyError(", ".join(sorted(missing)))
        if "f_rest" not in df.columns:
            df, degree = df.withColumn("f_rest", F.array().cast("array<float>")), 0
        whole = F.size("f_rest") == 3 * BANDS[degree]
        df = df.withColumn("f_rest", F.when(whole, F.col("f_rest")).otherwise(F.raise_error(F.lit(f"f_rest must have {3 * BANDS[degree]} values at degree {degree}"))))
        kinds = {"gid": "long", "f_rest": "array<float>"}
        df = df.select(*[F.col(c).cast(kinds.get(c, "float")).alias(c) for c in GAUSSIANS.names], *[c for c in df.columns if c.startswith(MASK_PREFIX)])
        names = [c.removeprefix(MASK_PREFIX) for c in df.columns if c.startswith(MASK_PREFIX)]
        state = FormatState.linear(degree) if format in ("linear", "rasterizer") else FormatState.ply(degree)
        out = cls(df, state, names)
        return out.detect() if format == "auto" else out

    @classmethod
    def from_dict(cls, spark: SparkSession, arrays: Mapping[str, object], format: str = "ply") -> SplatFrame:  # noqa: A002
        """From NumPy arrays means, scales, quats, opacities, sh0 and maybe shN; a missing one is a KeyError, others are ignored."""
        import numpy as np
        import pyarrow as pa

        parts = {k: np.asarray(arrays[k], np.float32) for k in ("means", "scales", "quats", "opacities", "sh0")}
        n = len(parts["means"])
        shn = arrays.get("shN")
        shn = np.zeros((n, 0, 3), np.float32) if shn is None else np.asarray(shn, np.float32)
        shn = shn.reshape(n, shn.size // (3 * n) if n else 0, 3)
        columns: dict[str, object] = {"gid": np.arange(n)}
        for names, key in ((CENTRE, "means"), (COLOUR, "sh0"), (SCALE, "scales"), (ROTATION, "quats")):
            if parts[key].shape != (n, len(names)):
                raise ValueError(f"{key} must have shape ({n}, {len(names)})")
            columns |= {c: parts[key][:, i] for i, c in enumerate(names)}
        columns["opacity"] = parts["opacities"].reshape(n)
        columns["f_rest"] = pa.array(list(shn.transpose(0, 2, 1).reshape(n, 3 * shn.shape[1])), pa.list_(pa.float32()))
        return cls.from_columns(spark.createDataFrame(pa.table(columns)), format, degree_of_bands(shn.shape[1]))

    @classmethod
    def from_base_rows(cls, df: DataFrame, count: int, column: str = "row") -> SplatFrame:
        """From (gid, array of ``count`` properties)."""
        parts = df.select("gid", *[c.alias(n) for n, c in from_base_row(F.col(column), count).items()])
        return cls.from_columns(parts, degree=degree_of_bands((count - 14) // 3))

    @classmethod
    def read(cls, spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> SplatFrame:
        """From a PLY file, compressed or not, by its header. ``columns`` narrows what an uncompressed scan reads."""
        from ..sources.ply import read_ply

        return read_ply(spark, path, columns)

    @classmethod
    def from_tagged(cls, df: DataFrame) -> SplatFrame:
        """From a table that ``tagged`` made, for instance read back from Parquet."""
        found = df.schema["gid"].metadata.get("splat")
        if found is None:
            raise ValueError("the gid column carries no format; use from_columns")
        return cls(df, FormatState.from_metadata(found), [c.removeprefix(MASK_PREFIX) for c in df.columns if c.startswith(MASK_PREFIX)])

    def tagged(self) -> DataFrame:
        """The rows with the format in the gid column's metadata, which Parquet keeps."""
        return self.df.withMetadata("gid", {"splat": self.state.to_metadata()})

    # -- format ----------------------------------------------------------------------------------------------------

    def _with(self, df: DataFrame | None = None, **changes: object) -> SplatFrame:
        return SplatFrame(self.df if df is None else df, self.state.with_format(**changes), self.masks, self.gaps)

    def _replace(self, columns: Mapping[str, Column]) -> DataFrame:
        return self.df.select(*[columns[c].cast("float").alias(c) if c in columns else c for c in self.df.columns])

    def with_format(self, **changes: object) -> SplatFrame:
        """States another format without touching values."""
        return self._with(**changes)

    def copy_format_from(self, other: SplatFrame) -> SplatFrame:
        return SplatFrame(self.df, other.state, self.masks, self.gaps)

    def detect(self) -> SplatFrame:
        """Guesses the domains from the values: one aggregate job."""
        found = domains(self.df).first()
        return self._with(scales=found.scales, opacities=found.opacities)

    def normalize(self, force: bool = False, **limits: float) -> SplatFrame:
        """To log scales and logit opacities. What is there already stays, unless forced."""
        return self._convert(activation.deactivations(**limits), LOG, force)

    def denormalize(self, force: bool = False, clamped: bool = True, unit_rotations: bool = True, **limits: float) -> SplatFrame:
        """To linear scales and opacities; with neither flag, plain exp and sigmoid."""
        return self._convert(activation.activations(clamped=clamped, unit_rotations=unit_rotations, **limits), LINEAR, force)

    def _convert(self, columns: dict[str, Column], to: str, force: bool) -> SplatFrame:
        if not force and self.state.scales == to:
            columns = {c: v for c, v in columns.items() if c not in SCALE}
        if not force and self.state.opacities == to:
            columns = {c: v for c, v in columns.items() if c != "opacity"}
        if not force and self.state.scales == to == self.state.opacities:
            return self
        return self._with(self._replace(columns), scales=to, opacities=to)

    def to_rgb(self, force: bool = False) -> SplatFrame:
        return self if self.state.colours == RGB and not force else self._with(self._replace(activation.colours_to_rgb()), colours=RGB)

    def to_sh(self, force: bool = False) -> SplatFrame:
        return self if self.state.colours == SH and not force else self._with(self._replace(activation.colours_to_sh()), colours=SH)

    def to_dtype(self, kind: str) -> SplatFrame:
        """All values as ``float`` or ``double``; Spark has no half."""
        if kind not in ("float", "double"):
            raise ValueError("float or double")
        cast = lambda c: F.col(c).cast(f"array<{kind}>") if c == "f_rest" else F.col(c).cast(kind) if c in SCALARS else F.col(c)
        return SplatFrame(self.df.select(*[cast(c).alias(c) for c in self.df.columns]), self.state, self.masks, self.gaps)

    @property
    def degree(self) -> int:
        return self.state.degree

    @property
    def has_high_order_sh(self) -> bool:
        return self.state.degree > 0

    # -- rows ------------------------------------------------------------------------------------------------------

    def _rows(self, df: DataFrame, gaps: bool | None = False) -> SplatFrame:
        return SplatFrame(df, self.state, self.masks, gaps)

    def where(self, predicate: Column | str) -> SplatFrame:
        """Rows that hold; gids keep their old values until rows are counted off or ``dense`` is called."""
        return self._rows(self.df.where(predicate), True)

    def dense(self) -> SplatFrame:
        """Numbers the rows 0..n-1 in their order; nothing to do where they are known to run so."""
        return self if self.gaps is False else self._rows(dense_gid(self.df))

    def _numbered(self) -> SplatFrame:
        return self.dense() if self.gaps else self

    def __len__(self) -> int:
        return self.df.count()

    def __getitem__(self, key: object):
        """A Column filters, a slice or list of positions selects (in its order, repeats kept), an integer gives a Row."""
        if isinstance(key, Column):
            return self.where(key)
        if isinstance(key, slice):
            return self.slice(key.start, key.stop, key.step)
        if isinstance(key, int):
            return self.row(key)
        if isinstance(key, Sequence) and not isinstance(key, str):
            return self.take(key)
        raise TypeError(f"cannot select by {type(key).__name__}")

    def slice(self, start: int | None = None, stop: int | None = None, step: int | None = None) -> SplatFrame:
        """Python's slice of the rows in their order, renumbered. Only negative bounds or steps need a count."""
        if self.gaps:
            return self.dense().slice(start, stop, step)
        step = 1 if step is None else step
        if step > 0 and (start or 0) >= 0 and (stop is None or stop >= 0):
            start, test = start or 0, F.col("gid") >= (start or 0)
            test = test if stop is None else test & (F.col("gid") < stop)
        else:
            start, end, step = slice(start, stop, step).indices(len(self))
            test = (F.col("gid") >= start) & (F.col("gid") < end) if step > 0 else (F.col("gid") <= start) & (F.col("gid") > end)
        away = F.col("gid") - start if step > 0 else start - F.col("gid")
        test = test if abs(step) == 1 else test & (away % abs(step) == 0)
        return self._rows(self.df.where(test).withColumn("gid", F.floor(away / abs(step)).cast("long")))

    def take(self, positions: Sequence[int]) -> SplatFrame:
        """Rows at positions, in that order; the list comes from the caller, so its size is the broadcast's."""
        if self.gaps:
            return self.dense().take(positions)
        n = len(self)
        wrapped = [p + n if p < 0 else p for p in positions]
        if any(not 0 <= p < n for p in wrapped):
            raise IndexError("position out of range")
        wanted = self.df.sparkSession.createDataFrame([(k, p) for k, p in enumerate(wrapped)], "__to long, gid long")
        return self._rows(self.df.join(F.broadcast(wanted), "gid").withColumn("gid", F.col("__to")).select(*self.df.columns))

    def gaussian(self, position: int) -> SplatFrame:
        """One row as a frame."""
        if self.gaps:
            return self.dense().gaussian(position)
        position += len(self) if position < 0 else 0
        return self._rows(self.df.where(F.col("gid") == position).withColumn("gid", F.lit(0).cast("long")))

    def row(self, position: int) -> Row:
        if self.gaps:
            return self.dense().row(position)
        found = self.df.where(F.col("gid") == (position + len(self) if position < 0 else position)).first()
        if found is None:
            raise IndexError(position)
        return found

    def __iter__(self) -> Iterator[Row]:
        return self.df.orderBy("gid").toLocalIterator()

    # -- masks -----------------------------------------------------------------------------------------------------

    def add_mask(self, name: str, test: Column | str) -> SplatFrame:
        if name in self.masks:
            raise ValueError(f"mask {name!r} exists")
        test = F.expr(test) if isinstance(test, str) else test
        return SplatFrame(self.df.withColumn(MASK_PREFIX + name, F.coalesce(test.cast("boolean"), F.lit(False))), self.state, (*self.masks, name), self.gaps)

    def mask(self, name: str) -> Column:
        if name not in self.masks:
            raise ValueError(f"no mask {name!r}")
        return F.col(MASK_PREFIX + name)

    def remove_mask(self, name: str) -> SplatFrame:
        self.mask(name)
        return SplatFrame(self.df.drop(MASK_PREFIX + name), self.state, tuple(m for m in self.masks if m != name), self.gaps)

    def combine_masks(self, mode: str = "and", layers: Sequence[str] | None = None) -> Column:
        """One boolean of several layers. No layers named: and gives true, or gives false."""
        if not self.masks:
            raise ValueError("there are no masks")
        if mode not in ("and", "or"):
            raise ValueError(f"mode must be and or or, not {mode!r}")
        columns = [self.mask(m) for m in (self.masks if layers is None else layers)]
        return reduce(and_ if mode == "and" else or_, columns) if columns else F.lit(mode == "and")

    def apply_masks(self, mode: str = "and", layers: Sequence[str] | None = None) -> SplatFrame:
        return self.where(self.combine_masks(mode, layers))

    # -- union -----------------------------------------------------------------------------------------------------

    def add(self, other: SplatFrame) -> SplatFrame:
        """Rows of ``other`` after these. Masks join where both have as many layers (this one's names win), are filled with false
        where one side has none, and are dropped where the numbers differ."""
        if self.gaps or other.gaps:
            return self._numbered().add(other._numbered())
        left, right, names = self.df, other.df, ()
        if len(self.masks) == len(other.masks) or not self.masks or not other.masks:
            names = self.masks or other.masks
            left, right = (_masked(f, names) for f in (self, other))
        else:
            left, right = (f.df.select(*GAUSSIANS.names) for f in (self, other))
        _same_format([self, other])
        shifted = right.withColumn("gid", F.col("gid") + F.lit(len(self)))
        return SplatFrame(left.unionByName(shifted), self.state, names, _known([self, other]))

    __add__ = add

    def __radd__(self, other: object) -> SplatFrame:
        if other == 0:
            return self
        return NotImplemented

    @staticmethod
    def concatenate(frames: Sequence[SplatFrame]) -> SplatFrame:
        """All frames one after the other, without masks; of one frame, itself."""
        if not frames:
            raise ValueError("nothing to concatenate")
        if len(frames) == 1:
            return frames[0]
        _same_format(frames)
        parts, start = [], 0
        frames = [f._numbered() for f in frames]
        for k, f in enumerate(frames, 1):
            parts.append(f.df.select(*GAUSSIANS.names).withColumn("gid", F.col("gid") + F.lit(start)))
            start += len(f) if k < len(frames) else 0
        return SplatFrame(reduce(DataFrame.unionByName, parts), frames[0].state, (), _known(frames))

    # -- codec, export ---------------------------------------------------------------------------------------------

    def to_ply(self) -> SplatFrame:
        """What files hold: log scales, logit opacities, SH colours."""
        return self.normalize().to_sh()

    def chunk_bounds(self) -> DataFrame:
        return chunk_bounds(self._numbered().to_ply().df)

    def pack(self) -> DataFrame:
        """(gid, packed words, f_rest codes, bounds)."""
        return pack(self._numbered().to_ply().df, self.degree)

    @staticmethod
    def unpack(packed: DataFrame, degree: int = 0) -> SplatFrame:
        return SplatFrame(unpack(packed, degree), FormatState.ply(degree))

    def write(self, path: str, compressed: bool = False) -> str:
        """One PLY file on a file system that all executors share; returns its path, which may get another ending."""
        from ..sources.ply_sink import write_ply

        return write_ply(self, path, compressed)

    def base_rows(self) -> DataFrame:
        return self.df.select("gid", base_row().alias("row"))

    def harmonic_bands(self) -> DataFrame:
        return self.df.select("gid", bands(F.col("f_rest"), self.degree).alias("shN"))

    @staticmethod
    def flat_bands(shn: Column, degree: int) -> Column:
        return from_bands(shn, degree)

    def to_dict(self) -> dict[str, object]:
        """NumPy arrays in row order, for handing a small frame to other libraries."""
        import numpy as np

        table = self.df.orderBy("gid").toArrow()
        stack = lambda names: np.stack([table[c].to_numpy() for c in names], axis=1)
        k = BANDS[self.degree]
        rest = np.array(table["f_rest"].to_pylist(), np.float32).reshape(table.num_rows, 3, k).transpose(0, 2, 1)
        return {"means": stack(CENTRE), "scales": stack(SCALE), "quats": stack(ROTATION), "opacities": table["opacity"].to_numpy(), "sh0": stack(COLOUR), "shN": rest}

    def unpacked(self, include_shn: bool = True) -> tuple:
        found = self.to_dict()
        return tuple(found[k] for k in ("means", "scales", "quats", "opacities", "sh0", *(["shN"] if include_shn else [])))

    def __repr__(self) -> str:
        return f"SplatFrame({self.state}, masks={list(self.masks)})"


def _masked(frame: SplatFrame, names: Sequence[str]) -> DataFrame:
    mine = [F.col(MASK_PREFIX + m) for m in frame.masks] or [F.lit(False)] * len(names)
    return frame.df.select(*GAUSSIANS.names, *[c.alias(MASK_PREFIX + n) for c, n in zip(mine, names, strict=True)])


def _known(frames: Sequence[SplatFrame]) -> bool | None:
    return False if all(f.gaps is False for f in frames) else None


def _same_format(frames: Sequence[SplatFrame]) -> None:
    if len({f.state for f in frames}) > 1:
        raise ValueError(f"formats differ: {[f.state for f in frames]}; convert with normalize, denormalize, to_rgb or to_sh")
