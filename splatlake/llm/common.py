"""Helpers that the text operators share: word rules, Arrow columns, scratch tables, components.

Word rule used throughout: a word is a run of bytes other than space and \\x09-\\x0D. These bytes never
occur inside a multi-byte UTF-8 character, and ``bytes.split()`` cuts at exactly them.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLANKS = b" \t\n\x0b\x0c\r"
#: Shuffle files of a table that is written are of no more use; Spark then deletes them at once instead of when the driver collects garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives none."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def small_batches(texts: DataFrame, rows: int = 1000) -> DataFrame:
    """The same rows; from now on the session hands Python tasks at most ``rows`` rows at once, so that whole texts take little memory
    on either side. A lower setting stays."""
    conf, name = texts.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, rows)
    return texts


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(id_column.cast("string")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a session on one machine may leave it unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, pattern: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in system.globStatus(path) or ():
        system.delete(found.getPath(), True)


def drop_scratch(spark: SparkSession) -> None:
    """Removes the tables that ``materialise`` has left in the shared folder for this application. Results that still read them must be written before."""
    _delete(spark, f"{shared_folder(spark)}/splatlake-{spark.sparkContext.applicationId}-*")


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and losing an executor loses nothing. Its shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/splatlake-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before) if before is not None else spark.conf.unset(CLEAN_SHUFFLES)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` has written, when everything that reads them has been written itself. Other tables are left alone."""
    for table in tables:
        if path := _written.pop(table, None):
            _delete(table.sparkSession, path)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` has two bigint columns. Returns (node, root) for every node that is not its component's smallest.
    Minima are written out before they are joined, so both join sides are plain scans: a hub that
    holds most edges is then split by adaptive skew joins or meets a broadcast table.
    """

    def minima(e: DataFrame) -> DataFrame:
        return materialise(e.groupBy("u").agg(F.min("v").alias("m")))

    a, b = (F.col(c) for c in edges.columns[:2])
    links = materialise(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        state = links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if state == seen or state[0] == 0:
            roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            _written[roots] = _written.pop(links)  # to be released by the caller
            return roots
        seen = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        old, low = links, minima(both.unionByName(links.select(F.col("v").alias("u"), "v")))
        large = materialise(
            links.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
            .unionByName(low.where("u <> m").select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        release(old, low)
        low = minima(large)
        links = materialise(
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        release(large, low)
