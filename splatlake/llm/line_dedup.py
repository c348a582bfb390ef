"""Operator 3: drop lines that occur in many documents.

Texts are split at \\n; a line's key is the line stripped of ASCII white space with A-Z lower-cased. Each document
gives one row for each distinct key (a 128-bit hash) with the positions of its lines; rows are counted by key with
map-side sums, keys at or over the threshold are joined back (adaptive skew joins split a key that a third of all
documents hold), their distinct documents are counted among these rows only, and the positions found are removed from their text. Rows of one id are one
document; rows without an id are told apart by their text.

Null or empty text: one empty line, never dropped (keys need ``min_chars`` code points). Rows that agree in id and text
are treated alike. Null ids are kept. Long texts are taken whole; a line at several places goes from all of them; an empty table gives an empty result.
Extra columns, whatever they are called, pass through ``drop_common_lines`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, materialise, small_batches, utf8

MASK = 2**63


def signed(x: int) -> int:
    """The low 64 bits of x as a signed integer."""
    x &= 2 * MASK - 1
    return x - 2 * MASK if x >= MASK else x


KEYS = "id long, check long, hi long, lo long, positions array<int>"


def line_keys(min_chars: int):
    """Rows of KEYS: a document's distinct keys, and the positions of their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, checks, his, los, places = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                found: dict[bytes, list[int]] = {}
                for k, line in enumerate(text.translate(LOWER).split(b"\n")):
                    key = line.strip(BLANKS)
                    if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        found.setdefault(key, []).append(k)
                check = signed(xxhash.xxh64_intdigest(text, 42))
                for key, at in found.items():
                    h = xxhash.xxh3_128_intdigest(key)
                    ids.append(doc), checks.append(check), his.append(signed(h >> 64)), los.append(signed(h)), places.append(at)
            columns = [pa.array(x, pa.int64()) for x in (ids, checks, his, los)] + [pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "check", "hi", "lo", "positions"])

    return run


def _without(text_at: int, drop_at: int):
    """Takes the lines at the given positions from each text and appends what is kept, the counts and the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, dropped, hashes = [], [], [], []
            for text, drop in zip(utf8(batch.column(text_at)), batch.column(drop_at).to_pylist(), strict=True):
                lines = text.split(b"\n")
                gone = set(drop or ())
                left = b"\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text
                kept.append(left), total.append(len(lines)), dropped.append(len(gone)), hashes.append(hashlib.sha256(left).hexdigest())
            columns = [batch.column(k) for k in range(batch.num_columns) if k != drop_at]
            columns += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))])

    return run


def common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, check, positions): per document with such lines, the positions of the lines found in ``min_docs`` documents or more."""
    lines = small_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col))).mapInArrow(line_keys(min_chars), KEYS)
    often = materialise(lines.groupBy("hi", "lo").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("hi", "lo"))
    hits = materialise(lines.join(often, ["hi", "lo"], "left_semi"))
    documents = hits.select("hi", "lo", "id", F.when(F.col("id").isNull(), F.col("check")).alias("unnamed")).distinct()
    common = materialise(documents.groupBy("hi", "lo").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("hi", "lo"))
    return hits.join(common, ["hi", "lo"], "left_semi").groupBy("id", "check").agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with four more columns: __kept, __n_lines, __n_dropped and __sha256 of the text without its common lines."""
    hits = common_lines(docs, min_docs, min_chars, id_col, text_col).select(
        F.col("id").alias("__id"), F.col("check").alias("__check"), F.col("positions").alias("__drop")
    )
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__check"))
    joined = docs.join(hits, same, "left").drop("__id", "__check")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    schema = ", ".join([*fields, "__kept string, __n_lines long, __n_dropped long, __sha256 string"])
    return small_batches(joined).mapInArrow(_without(joined.columns.index(text_col), len(joined.columns) - 1), schema)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more leave every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_common_lines(docs)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("__sha256").alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), often AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
