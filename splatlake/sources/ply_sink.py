"""Writes one PLY file from many tasks.

All records have a fixed size and gids are dense, so every record's place in the file is known: the driver writes the header and sizes
the file, each task writes its rows at their places, and a rename finishes the file. Nothing passes through the driver, and a task
that runs twice writes the same bytes twice. The path must lie on a disk that all executors mount.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.bounds import pack
from ..schema import BANDS, BOUNDS, CENTRE, CHUNK_ROWS, COLOUR, PACKED, ROTATION, SCALE, property_names

if TYPE_CHECKING:
    from ..operators.frame import SplatFrame


def plain_header(n: int, degree: int) -> bytes:
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *(f"property float {c}" for c in property_names(degree)), "end_header"]
    return ("\n".join(lines) + "\n").encode("ascii")


def compressed_header(n: int, degree: int) -> bytes:
    lines = ["ply", "format binary_little_endian 1.0", f"element chunk {-(-n // CHUNK_ROWS)}", *(f"property float {c}" for c in BOUNDS)]
    lines += [f"element vertex {n}", *(f"property uint {c}" for c in PACKED)]
    if degree:
        lines += [f"element sh {n}", *(f"property uchar f_rest_{k}" for k in range(3 * BANDS[degree]))]
    return ("\n".join([*lines, "end_header"]) + "\n").encode("ascii")


def output_path(path: str, compressed: bool) -> tuple[str, bool]:
    """(path, compressed): the ending may ask for compression, and asking for it may change the ending."""
    if path.endswith((".ply_compressed", ".compressed.ply")):
        return path, True
    if not compressed:
        return path, False
    return (path[: -len(".ply")] if path.endswith(".ply") else path) + ".compressed.ply", True


class _Written(WriterCommitMessage):
    pass


class RecordWriter(DataSourceArrowWriter):
    """Rows (at, values...) to offset + at * record of a file that is there already."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.offset, self.kind = options["path"], int(options["offset"]), options["kind"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        with open(self.path, "r+b") as f:
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = batch.column(0).to_numpy()
                records = np.concatenate([self._values(c, batch.num_rows) for c in batch.columns[1:]], axis=1).astype(self.kind)
                order = np.argsort(at, kind="stable")
                at, records = at[order], np.ascontiguousarray(records[order])
                size = records.shape[1] * records.itemsize
                for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                    f.seek(self.offset + int(at[run[0]]) * size)
                    f.write(records[run[0] : run[-1] + 1].tobytes())
        return _Written()

    @staticmethod
    def _values(column: pa.Array, rows: int) -> np.ndarray:
        if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
            return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
        return column.to_numpy(zero_copy_only=False).reshape(rows, 1)


class RecordSink(DataSource):
    """``df.write.format("splat_records")`` with options path, offset and kind (a NumPy type such as <f4)."""

    @classmethod
    def name(cls) -> str:
        return "splat_records"

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options)


def _section(rows: DataFrame, columns: Sequence[str], path: str, offset: int, kind: str) -> None:
    rows.select(*columns).write.format("splat_records").mode("append").options(path=path, offset=str(offset), kind=kind).save()


def write_ply(frame: SplatFrame, path: str, compressed: bool = False) -> str:
    path, compressed = output_path(path, compressed)
    frame = frame.to_ply().dense()
    spark, n, degree = frame.df.sparkSession, len(frame), frame.degree
    spark.dataSource.register(RecordSink)
    header = compressed_header(n, degree) if compressed else plain_header(n, degree)
    chunks, codes = -(-n // CHUNK_ROWS), 3 * BANDS[degree]
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(header)
        f.truncate(len(header) + (chunks * 72 + n * (16 + codes) if compressed else n * 4 * (14 + codes)))
    try:
        if n and compressed:
            packed = frame.pack()
            _section(frame.chunk_bounds(), ["chunk_id", *BOUNDS], part, len(header), "<f4")
            _section(packed, ["gid", *PACKED], part, len(header) + chunks * 72, "<u4")
            if codes:
                _section(packed, ["gid", "f_rest"], part, len(header) + chunks * 72 + n * 16, "u1")
        elif n:
            names = [*CENTRE, *COLOUR, *(["f_rest"] if codes else []), "opacity", *SCALE, *ROTATION]
            _section(frame.df.repartitionByRange("gid").sortWithinPartitions("gid"), ["gid", *names], part, len(header), "<f4")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return path


def compress_to_tables(frame: SplatFrame) -> tuple[bytes, DataFrame, DataFrame]:
    """(header, chunk table, packed table)."""
    frame = frame.dense()
    return compressed_header(len(frame), frame.degree), frame.chunk_bounds(), frame.pack().drop(*BOUNDS)


def _assemble(degree: int):
    codes = 3 * BANDS[degree]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("gid")
        n = table.num_rows
        stack = lambda names, kind: np.stack([table[c].to_numpy() for c in names], axis=1).astype(kind)
        bounds = stack(BOUNDS, "<f4")[::CHUNK_ROWS]
        sh = np.array(table["f_rest"].to_pylist(), "u1").reshape(n, codes)
        data = compressed_header(n, degree) + bounds.tobytes() + stack(PACKED, "<u4").tobytes() + sh.tobytes()
        return pa.table({"scene": table["scene"].slice(0, 1), "content": pa.array([data], pa.binary())})

    return run


def _assemble_plain(degree: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("gid")
        n = table.num_rows
        stack = lambda names: np.stack([table[c].to_numpy() for c in names], axis=1)
        rest = table["f_rest"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, 3 * BANDS[degree])
        rows = np.concatenate([stack((*CENTRE, *COLOUR)), rest, stack(("opacity", *SCALE, *ROTATION))], axis=1).astype("<f4")
        return pa.table({"scene": table["scene"].slice(0, 1), "content": pa.array([plain_header(n, degree) + rows.tobytes()], pa.binary())})

    return run


def plain_to_bytes(scenes: DataFrame, degree: int = 0) -> DataFrame:
    """(scene, content): as ``compress_to_bytes``, but plain files."""
    kind = scenes.schema["scene"].dataType.simpleString()
    return scenes.groupBy("scene").applyInArrow(_assemble_plain(degree), f"scene {kind}, content binary")


def compress_to_bytes(scenes: DataFrame, degree: int = 0) -> DataFrame:
    """(scene, content): a compressed file as one value for each scene of a table (scene, Gaussians in file domains, gids dense in each).

    A value holds its file whole, so this is for many small scenes; large ones are written with ``write_ply``.
    """
    kind = scenes.schema["scene"].dataType.simpleString()
    return pack(scenes, degree, ["scene"]).groupBy("scene").applyInArrow(_assemble(degree), f"scene {kind}, content binary")
