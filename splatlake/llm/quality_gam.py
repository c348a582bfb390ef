"""Operator 1: a quality classifier, a generalised additive model with pairwise interactions.

Features are binned at training quantiles. Boosting goes round the features; each step fits a tree of depth two to the log-loss
gradient over one feature's bins and adds it to that feature's lookup table. Then the pairs whose residual
grid promises most are boosted the same way with trees over two features. A score is the sigmoid of the intercept plus one
table entry per feature and pair, added by array.

Training reads at most ``MAX_ROWS`` labelled rows, which the driver fits in memory; without labels every score is 0.5, with one class
only the smoothed rate. Empty, null and very long texts are scored like any other. Repeated rows get equal scores; a null id never trains, so such rows count as held
out. An empty table gives an empty result. Only the id and the text are read, so extra columns may have any name; of several labels of an id the highest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, utf8
from .stats import COUNTS, counts, ratios, training_sample

MAX_ROWS = 20_000
BINS, PAIR_BINS = 48, 12
LAMBDA = 2.0


@dataclass
class Gam:
    """Lookup tables by feature and by pair of features."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, k], "right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], "right") for pair in self.pairs for k in pair[:2]}
        for i, j, table in self.pairs:
            out += table[coarse[i], coarse[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + LAMBDA)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain and cut of bins in order."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    k = int(np.argmax(gains))
    return float(gains[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values over bins of one feature."""
    gain, cut = _split(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + LAMBDA))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _tree2(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values over the grid of two features."""
    best = max(((*_split(g.sum(axis=1 - a), h.sum(axis=1 - a)), a) for a in (0, 1)), key=lambda s: s[0]) if depth else (0.0, 0, 0)
    gain, cut, axis = best
    if gain <= 1e-9:
        return np.full(g.shape, g.sum() / (h.sum() + LAMBDA))
    parts = [_tree2(*(np.split(v, [cut], axis=axis)[side] for v in (g, h)), depth - 1) for side in (0, 1)]
    return np.concatenate(parts, axis=axis)


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, n_pairs: int = 8, pair_rounds: int = 60) -> Gam:
    """A model of P(y = 1)."""
    n, k = x.shape
    if not n:
        return Gam(0.0, [np.zeros(0)] * k, [np.zeros(1)] * k)
    p = (y.sum() + 1) / (n + 2)
    model = Gam(float(np.log(p / (1 - p))) if n else 0.0, [_edges(x[:, j], BINS) for j in range(k)], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    raw = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-raw))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for j in range(k):
            g, h = slopes()
            size = len(model.tables[j])
            step = rate * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size), 2)
            model.tables[j] += step
            raw += step[bins[j]]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(k)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        a, b = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
        return np.bincount(coarse[i] * b + coarse[j], v, a * b).reshape(a, b)

    g, h = slopes()
    promise = sorted(((_gain(grid(i, j, g), grid(i, j, h)).sum(), i, j) for i in range(k) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1))) for _, i, j in promise[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = rate * _tree2(grid(i, j, g), grid(i, j, h), 2)
            table += step
            raw += step[coarse[i], coarse[j]]
    return model


def _score(model: Gam):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts(t) for t in utf8(batch.column(1))], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(ratios(dict(zip(COUNTS, found.T, strict=True)))))], ["id", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """(id, score): the probability of label 1 for every text, learnt from the labelled training rows."""
    model = fit(*training_sample(docs, labels, max_rows, id_col, text_col))
    return docs.select(id_col, text_col).mapInArrow(_score(model), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def op1_quality_gam(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_documents(docs, labels)
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
