"""Many PLY files at once, from any store that Spark reads: plain and compressed ones side by side, one scene a file.

``binaryFile`` gives each file as one value, so a file is decoded by one task and may have 2 GB at most; small files share a task up to
``spark.sql.files.maxPartitionBytes``. Spark leaves out files of no bytes. A larger file is cut into vertex ranges by ``SplatFrame.read``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec
from ..operators.bounds import unpack
from ..schema import BANDS, BOUNDS, GAUSSIANS, PACKED, SCALARS
from .ply import BATCH, LONGEST_HEADER, PACKED_SCHEMA, columns_of, sh_codes, packed_parts, degree_of, header_of, is_compressed

Batches = Iterator[pa.RecordBatch]


def load_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, content) of files, folders or patterns such as ``/scenes/*.ply``."""
    return spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths)).select("path", "content")


def _kinds(batches: Batches) -> Batches:
    for batch in batches:
        found = []
        for value in batch.column(1):
            try:
                header = header_of(value.as_buffer())
                compressed = is_compressed(header)
                degree = None if compressed else degree_of(header)
                found.append((compressed, degree, header.element("vertex")[0] if compressed or degree is not None else None))
            except ValueError:
                found.append((False, None, None))
        columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.bool_(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["scene", "compressed", "degree", "n"])


def detect_formats(files: DataFrame, scene_col: str = "path", bytes_col: str = "content") -> DataFrame:
    """(scene, compressed, degree, n) of each file, as ``detect_format`` tells it: (false, null, null) for whatever is no file of Gaussians,
    empty and null values too. Only the start of a file goes to Python."""
    start = F.substring(bytes_col, 1, 1 << 13)
    whole = F.instr(F.decode(start, "ISO-8859-1"), "end_header\n") > 0
    heads = files.select(F.col(scene_col).alias("scene"), F.when(whole, start).otherwise(F.substring(bytes_col, 1, LONGEST_HEADER)).alias("start"))
    found = [T.StructField("compressed", T.BooleanType()), T.StructField("degree", T.IntegerType()), T.StructField("n", T.LongType())]
    return heads.mapInArrow(_kinds, T.StructType([T.StructField("scene", files.schema[scene_col].dataType), *found]))


def _explode_any(degree: int | None) -> Callable[[Batches], Batches]:
    """Rows of both kinds of files in one shape: a compressed file leaves the plain columns null, and the other way round."""

    def check(found: int | None, key: pa.Scalar) -> None:
        if found is None or degree not in (None, found):
            raise ValueError(f"not a PLY file of Gaussians{'' if found is None else f' of degree {degree}'}: {key}")

    def plain(data: pa.Buffer, header, found: int) -> Iterator[tuple[int, list[pa.Array]]]:
        n, width = header.element("vertex")[0], 14 + 3 * BANDS[found]
        if not header.binary:
            raise ValueError("a plain file must be binary and little-endian")
        if data.size < header.size + n * width * 4:
            raise ValueError("the file is cut short")
        rows = np.frombuffer(data, "<f4", n * width, header.size).reshape(n, width)
        places = [k for k in range(width) if not 6 <= k < width - 8]
        for first in range(0, n, BATCH):
            part = rows[first : first + BATCH]
            rest = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * (width - 14)), pa.array(np.ascontiguousarray(part[:, 6 : width - 8]).reshape(-1)))
            empty = [pa.nulls(len(part), pa.int64())] * len(PACKED) + [pa.nulls(len(part), pa.list_(pa.int16()))] + [pa.nulls(len(part), pa.float32())] * len(BOUNDS)
            yield len(part), [pa.array(np.arange(first, first + len(part))), *empty, *[pa.array(np.ascontiguousarray(part[:, k])) for k in places], rest]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                data = value.as_buffer()
                header = header_of(data)
                if is_compressed(header):
                    check({0: 0, 9: 1, 24: 2, 45: 3}[sh_codes(header)], key)
                    rest = lambda n: [pa.nulls(n, pa.float32())] * len(SCALARS) + [pa.nulls(n, pa.list_(pa.float32()))]
                    parts = ((p[1] - p[0], [*columns_of(*p), *rest(p[1] - p[0])]) for p in packed_parts(data, header))
                else:
                    check(degree_of(header), key)
                    parts = plain(data, header, degree_of(header))
                for n, columns in parts:
                    yield pa.RecordBatch.from_arrays([pa.repeat(key, n), *columns], ["scene", *PACKED_SCHEMA.names, *(f"plain_{c}" for c in (*SCALARS, "f_rest"))])

    return run


def read_files(spark: SparkSession, paths: str | Sequence[str], degree: int | None = None) -> DataFrame:
    """(scene, Gaussians in file domains) of many files in one pass, scene by scene; gids run from 0 in each.

    ``degree``: all files must have it, and harmonics stay in generated code; None takes every file as it is, so that f_rest may differ in length
    between scenes. A file of another kind, cut short or empty fails the query when it runs: look for those with ``detect_formats`` first.
    """
    return decode_files(load_files(spark, paths), degree)


def decode_files(files: DataFrame, degree: int | None = None, scene_col: str = "path", bytes_col: str = "content") -> DataFrame:
    """``read_files`` for files held as values."""
    extra = [T.StructField(f"plain_{c}", T.FloatType()) for c in SCALARS] + [T.StructField("plain_f_rest", T.ArrayType(T.FloatType()))]
    schema = T.StructType([T.StructField("scene", files.schema[scene_col].dataType), *PACKED_SCHEMA.fields, *extra])
    rows = files.select(scene_col, bytes_col).mapInArrow(_explode_any(degree), schema)
    packed, plain = F.col(PACKED[0]).isNotNull(), [f.name for f in extra]
    codes = F.transform("f_rest", lambda c: codec.harmonic(c)) if degree is None else codec.unpack_harmonics(F.col("f_rest"), 3 * BANDS[degree])
    rows = rows.withColumn("__packed", packed).withColumn("__codes", codes.cast("array<float>"))
    decoded = unpack(rows, 0, ["scene", "__packed", "__codes", *plain])
    value = lambda c: F.when(F.col("__packed"), F.col("__codes" if c == "f_rest" else c)).otherwise(F.col(f"plain_{c}"))
    return decoded.select("scene", "gid", *[value(c).alias(c) for c in GAUSSIANS.names if c != "gid"])
