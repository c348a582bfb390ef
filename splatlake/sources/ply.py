"""PLY files: header rules, detection, and a batch source that cuts a file into vertex ranges.

The source opens files with the executors' own file system calls, so they must lie on a disk that all of them mount. For other
stores, and for many files at once, ``files.read_files`` takes whole files as values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.bounds import unpack
from ..operators.frame import SplatFrame
from ..schema import BOUNDS, CHUNK_ROWS, PACKED, SCALARS, degree_of_properties, property_names
from ..state import FormatState

LONGEST_HEADER = 1 << 20
ROWS = 1 << 18  # vertices in a partition, a multiple of a chunk
BATCH = 1 << 14


@dataclass(frozen=True)
class Header:
    """Elements in order: name, count, (type, name) of each property; and the header's length."""

    elements: tuple[tuple[str, int, tuple[tuple[str, str], ...]], ...]
    size: int
    binary: bool

    def element(self, name: str) -> tuple[int, tuple[tuple[str, str], ...]] | None:
        return next(((n, p) for e, n, p in self.elements if e == name), None)


def parse_header(start: bytes) -> Header:
    """The header at the start of a file; ValueError if it is none. Lines may end in \\r\\n."""
    end = start.find(b"end_header")
    stop = start.find(b"\n", end)
    if start[:3] != b"ply" or start[3:4] not in (b"\n", b"\r") or end < 0 or stop < 0:
        raise ValueError("not a PLY file")
    elements: list[tuple[str, int, list[tuple[str, str]]]] = []
    binary = False
    for line in start[:end].decode("ascii").split("\n")[1:]:
        match line.split():
            case ["format", kind, *_]:
                binary = kind == "binary_little_endian"
            case ["element", name, count]:
                elements.append((name, int(count), []))
            case ["property", kind, name] if elements:
                elements[-1][2].append((kind, name))
            case ["property", *rest] if elements:
                elements[-1][2].append((" ".join(rest[:-1]), rest[-1]))
    return Header(tuple((e, n, tuple(p)) for e, n, p in elements), stop + 1, binary)


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        start = f.read(1 << 13)
        while b"end_header" not in start and len(start) < LONGEST_HEADER and (more := f.read(1 << 16)):
            start += more
        if b"end_header" in start and b"\n" not in start[start.find(b"end_header") :]:
            start += f.readline()
    return parse_header(start)


def is_compressed(header: Header) -> bool:
    """18 named float bounds, exactly four packed words, and a chunk for every 256 vertices."""
    chunk, vertex = header.element("chunk"), header.element("vertex")
    if not chunk or not vertex:
        return False
    return chunk[1] == tuple(("float", n) for n in BOUNDS) and vertex[1] == tuple(("uint", n) for n in PACKED) and chunk[0] == -(-vertex[0] // CHUNK_ROWS)


def degree_of(header: Header) -> int | None:
    """The SH degree of an uncompressed file, or None."""
    vertex = header.element("vertex")
    degree = degree_of_properties(len(vertex[1])) if vertex else None
    return degree if degree is not None and [n for _, n in vertex[1]] == property_names(degree) else None


def detect_format(path: str) -> tuple[bool, int | None]:
    """(compressed, degree): (True, None) compressed, (False, degree) plain, (False, None) anything else, missing files too."""
    try:
        header = read_header(path)
    except (OSError, ValueError):
        return False, None
    return (True, None) if is_compressed(header) else (False, degree_of(header))


def sh_codes(header: Header) -> int:
    sh = header.element("sh")
    return len(sh[1]) if sh and all(kind == "uchar" for kind, _ in sh[1]) and len(sh[1]) in (9, 24, 45) else 0


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class PlyReader(DataSourceReader):
    """Reads vertex ranges; filters on gid choose the ranges."""

    def __init__(self, path: str, columns: Sequence[str]) -> None:
        self.path, self.columns, self.header = path, list(columns), read_header(path)
        self.n = self.header.element("vertex")[0]
        self.low, self.high = 0, self.n

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("gid",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        low = self.low // CHUNK_ROWS * CHUNK_ROWS
        return [_Range(max(k, self.low), min(k + ROWS, self.high)) for k in range(low, self.high, ROWS)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        read = self._packed if is_compressed(self.header) else self._plain
        with open(self.path, "rb") as f:
            for first in range(partition.first, partition.last, BATCH):
                yield read(f, first, min(first + BATCH, partition.last))

    @staticmethod
    def _section(f, offset: int, kind: str, rows: int, width: int) -> np.ndarray:
        f.seek(offset)
        found = np.fromfile(f, kind, rows * width)
        if len(found) < rows * width:
            raise ValueError("the file is cut short")
        return found.reshape(rows, width)

    def _plain(self, f, first: int, last: int) -> pa.RecordBatch:
        names = [n for _, n in self.header.element("vertex")[1]]
        rows = self._section(f, self.header.size + first * 4 * len(names), "<f4", last - first, len(names))
        made = {"gid": pa.array(np.arange(first, last))}
        for c in self.columns:
            if c == "f_rest":
                width = len(names) - 14
                made[c] = pa.ListArray.from_arrays(pa.array(np.arange(last - first + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows[:, 6 : 6 + width]).reshape(-1)))
            elif c != "gid":
                made[c] = pa.array(np.ascontiguousarray(rows[:, names.index(c)]))
        return pa.RecordBatch.from_arrays([made[c] for c in self.columns], self.columns)

    def _packed(self, f, first: int, last: int) -> pa.RecordBatch:
        chunks, codes, size = -(-self.n // CHUNK_ROWS), sh_codes(self.header), self.header.size
        low, high = first // CHUNK_ROWS, -(-last // CHUNK_ROWS)
        bounds = self._section(f, size + low * 72, "<f4", high - low, 18)[np.arange(first, last) // CHUNK_ROWS - low]
        words = self._section(f, size + chunks * 72 + first * 16, "<u4", last - first, 4).astype(np.int64)
        sh = self._section(f, size + chunks * 72 + self.n * 16 + first * codes, "u1", last - first, codes).astype(np.int16)
        return pa.RecordBatch.from_arrays(columns_of(first, last, bounds, words, sh), PACKED_SCHEMA.names)


PACKED_SCHEMA = T.StructType(
    [T.StructField("gid", T.LongType())] + [T.StructField(c, T.LongType()) for c in PACKED]
    + [T.StructField("f_rest", T.ArrayType(T.ShortType()))] + [T.StructField(c, T.FloatType()) for c in BOUNDS]
)


class PlySource(DataSource):
    """``spark.read.format("splat_ply").load(path)``; option ``columns`` (comma separated) narrows a plain file's scan."""

    @classmethod
    def name(cls) -> str:
        return "splat_ply"

    def _columns(self) -> list[str]:
        asked = [c for c in self.options.get("columns", "").split(",") if c]
        return ["gid", *[c for c in asked if c != "gid"]] if asked else ["gid", "x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "f_rest", *SCALARS[6:]]

    def schema(self) -> T.StructType:
        header = read_header(self.options["path"])
        if is_compressed(header):
            return PACKED_SCHEMA
        kind = lambda c: T.LongType() if c == "gid" else T.ArrayType(T.FloatType()) if c == "f_rest" else T.FloatType()
        return T.StructType([T.StructField(c, kind(c)) for c in self._columns()])

    def reader(self, schema: T.StructType) -> PlyReader:
        return PlyReader(self.options["path"], schema.names)


def read_ply(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> SplatFrame:
    """A PLY file by its header; ValueError when planned if it is neither kind. Plain files must be binary and little-endian."""
    compressed, degree = detect_format(path)
    if not compressed and (degree is None or not read_header(path).binary):
        raise ValueError(f"not a PLY file of Gaussians: {path}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PlySource)
    reader = spark.read.format("splat_ply")
    if not compressed:
        rows = (reader.option("columns", ",".join(columns)) if columns else reader).load(path)
        return SplatFrame(rows, FormatState.ply(degree), gaps=False)
    degree = {0: 0, 9: 1, 24: 2, 45: 3}[sh_codes(read_header(path))]
    return SplatFrame(unpack(reader.load(path), degree), FormatState.ply(degree), gaps=False)


def packed_parts(data: pa.Buffer, header: Header) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, bounds, words, codes) of the rows of a compressed file held as one value."""
    n, codes = header.element("vertex")[0], sh_codes(header)
    chunks, at = -(-n // CHUNK_ROWS), header.size
    if data.size < at + chunks * 72 + n * (16 + codes):
        raise ValueError("the file is cut short")
    bounds = np.frombuffer(data, "<f4", chunks * 18, at).reshape(chunks, 18)
    words = np.frombuffer(data, "<u4", n * 4, at + chunks * 72).reshape(n, 4)
    sh = np.frombuffer(data, "u1", n * codes, at + chunks * 72 + n * 16).reshape(n, codes)
    for first in range(0, n, BATCH):
        last = min(first + BATCH, n)
        yield first, last, bounds[np.arange(first, last) // CHUNK_ROWS], words[first:last].astype(np.int64), sh[first:last].astype(np.int16)


def columns_of(first: int, last: int, bounds: np.ndarray, words: np.ndarray, sh: np.ndarray) -> list[pa.Array]:
    """Columns of PACKED_SCHEMA."""
    lists = pa.ListArray.from_arrays(pa.array(np.arange(last - first + 1, dtype=np.int32) * sh.shape[1]), pa.array(sh.reshape(-1)))
    return [pa.array(np.arange(first, last)), *(pa.array(w) for w in np.ascontiguousarray(words.T)), lists, *(pa.array(b) for b in np.ascontiguousarray(bounds.T))]


def header_of(data: pa.Buffer | None) -> Header:
    """The header of a file held as one value; ValueError if it has none."""
    return parse_header(b"" if data is None else data.slice(0, min(data.size, LONGEST_HEADER)).to_pybytes())


def _explode_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, value in zip(batch.column(0), batch.column(1), strict=True):
            data = value.as_buffer()
            header = header_of(data)
            if not is_compressed(header):
                raise ValueError("not a compressed PLY file")
            for part in packed_parts(data, header):
                columns = [pa.repeat(key, part[1] - part[0]), *columns_of(*part)]
                yield pa.RecordBatch.from_arrays(columns, ["scene", *PACKED_SCHEMA.names])


def decompress_bytes(files: DataFrame, degree: int = 0, scene_col: str = "path", bytes_col: str = "content") -> DataFrame:
    """(scene, Gaussians) of compressed files held as values, as ``binaryFile`` gives them: one file a value, many files in parallel."""
    schema = T.StructType([T.StructField("scene", files.schema[scene_col].dataType), *PACKED_SCHEMA.fields])
    packed = files.select(scene_col, bytes_col).mapInArrow(_explode_files, schema)
    return unpack(packed, degree, ["scene"])
