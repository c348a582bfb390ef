"""A training corpus from raw documents: quality rules, line dedup, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of
``documents``. ``run`` writes each stage's result as Parquet to the shared folder and reads it again for the next one.

Null and empty texts fail the quality rules. Texts of any length are taken whole. Rows without an id that pass are kept by every stage unless they hold a
benchmark item; of repeated rows one stays. Empty tables give empty results. Extra columns, whatever they are called, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatlake.llm.bpe import token_digests
from splatlake.llm.common import materialise, release
from splatlake.llm.decontaminate import drop_leaks
from splatlake.llm.line_dedup import drop_common_lines
from splatlake.llm.quality_rules import filter_documents
from splatlake.llm.simhash_dedup import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: rejected documents go."""
    return filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: lines of ten documents or more leave every text; n_chars follows. A text may end up empty."""
    kept = drop_common_lines(docs)
    new = {"text": F.col("__kept"), "n_chars": F.char_length("__kept").cast("long")}
    return kept.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each group of documents linked at 0.8 of their five-word shingles the one with the smallest id stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the token digests of what is left."""
    import public_tokenizers as P

    return token_digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        read, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
            release(read)
    return docs


#: Learnt rules, XXH64 and token ranks are beyond SQL.
ORACLE_SQL = None
