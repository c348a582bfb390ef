"""Counts over whole texts that the quality operators learn from.

Null and empty texts have no words and all counts zero; ratios then are zero too. Nothing but the text enters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, remainder, small_batches, utf8

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_adjacent", "longest_word", "n_lines",
    "n_upper", "n_letters", "n_digits", "n_bangs", "n_pipes", "n_stops", "n_high",
)
#: name: (numerator, denominator); a denominator of zero counts as one. None: one.
RATIOS: dict[str, tuple[str, str | None]] = {
    "words": ("n_words", None), "longest": ("longest_word", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"), "repeated": ("n_repeat_words", "n_words"), "distinct": ("n_distinct", "n_words"), "adjacent": ("n_adjacent", "n_words"),
    "upper": ("n_upper", "n_letters"), "digits": ("n_digits", "word_chars"), "bangs": ("n_bangs", "n_words"), "pipes": ("n_pipes", "n_words"),
    "stops": ("n_stops", "n_words"), "high": ("n_high", "word_chars"), "line_words": ("n_words", "n_lines"),
}


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Word positions inside n-word windows that occur twice or more, first occurrences included."""
    windows = list(zip(*(words[k:] for k in range(n)), strict=False))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    covered, last = 0, 0
    for k, w in enumerate(windows):
        if times[w] > 1:
            covered += k + n - max(k, last)
            last = k + n
    return covered


def counts(text: bytes) -> tuple[int, ...]:
    """The COUNTS of one text."""
    words = text.split()
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    blanks = int(sum(n[b] for b in BLANKS))
    points = int(len(text) - n[0x80:0xC0].sum())
    seen: set[bytes] = set()
    dup, lines = 0, text.split(b"\n")
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(BLANKS):
            seen.add(line)
    total = lambda chars: int(sum(n[b] for b in chars))
    upper, lower = int(n[65:91].sum()), int(n[97:123].sum())
    return (
        len(words), points - blanks, total(b"#*$%&|<>"), dup, repeated_words(words), len(set(words)), sum(a == b for a, b in zip(words, words[1:], strict=False)),
        max(map(len, words), default=0), len(lines), upper, upper + lower, int(n[48:58].sum()), total(b"!?"), int(n[124]), total(b".,;"), int(n[128:].sum()),
    )


def _count(at: int, n_kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts(t) for t in utf8(batch.column(at))], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *(pa.array(c) for c in found.T)], [str(k) for k in range(n_kept + len(COUNTS))])

    return run


def with_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the COUNTS of each text."""
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in COUNTS]
    read = keep if text_col in keep else [*keep, text_col]
    return small_batches(docs.select(*read)).mapInArrow(_count(read.index(text_col), len(keep)), ", ".join(fields))


def ratio(name: str) -> Column:
    """A ratio as a Spark expression over the COUNTS."""
    top, bottom = RATIOS[name]
    return F.col(top).cast("double") if bottom is None else F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def ratios(columns: dict[str, np.ndarray]) -> np.ndarray:
    """All ratios, one column each, from arrays of COUNTS."""
    return np.stack([columns[top] / (1.0 if bottom is None else np.maximum(columns[bottom], 1)) for top, bottom in RATIOS.values()], axis=1)


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Ratios and labels of at most ``max_rows`` labelled training rows, those whose crc32 of the id modulo 4 is not 2.

    Beyond that bound a hash of the id decides which rows come in. Rows without a label are left out; of several labels of a document the
    highest counts; of several texts under one id each is a row.
    """
    known = labels.where(F.col("quality").isNotNull() & (remainder(F.col(id_col), 4) != 2)).groupBy(id_col).agg(F.max("quality").alias("__y"))
    n = known.count()
    part = min(1.0, 0.95 * max_rows / max(n, 1))
    known = known.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(part * 1_000_000)).limit(max_rows)
    rows = with_counts(docs.select(id_col, text_col).join(F.broadcast(known), id_col), [id_col, "__y"], text_col).limit(max_rows).toArrow()
    rows = rows.sort_by([(id_col, "ascending"), ("n_words", "ascending"), ("word_chars", "ascending")])
    return ratios({c: rows[c].to_numpy() for c in COUNTS}), rows["__y"].to_numpy().astype(np.float64)
