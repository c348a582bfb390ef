"""Operator 4: quality rules as a learned decision list.

Sequential covering on labelled statistics: a rule grows by the threshold condition of most information gain, up to three; it is pruned
from its end while precision on a separate third of the rows improves, and is accepted only at ``PRECISION`` there; the
rows it covers leave, and the next rule follows. The list becomes an ordered Spark conditional expression
over the count columns: first rule that holds rejects, else the document is kept.

Learning reads at most ``MAX_ROWS`` labelled training rows (crc32 of the id modulo 4 is not 2); without labels no rule is learnt and
only the base rule rejects. Null and empty texts have no words, so they fail the base rule. Long texts are counted whole. Repeated rows get equal verdicts, null ids
never train but are judged, ties of information gain go to the first feature and lowest threshold, and an empty table gives an empty result. Extra columns pass through
``filter_documents``, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import RATIOS, ratio, training_sample, with_counts

MAX_ROWS = 20_000
PRECISION = 0.9
LEAST = 5  # rows that a rule must reject rightly, in growing
LEAST_TESTED = 3  # and in testing
LONGEST = 3
MOST_RULES = 16


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(RATIOS).index(self.feature)]
        return v >= self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = ratio(self.feature)
        return v >= F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _counts(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[int, int]:
    """Rows covered, and those of them that are bad."""
    at = covers(rule, x)
    return int(at.sum()), int((at & bad).sum())


def _smoothed(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    covered, right = _counts(rule, x, bad)
    return (right + 1) / (covered + 2)


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Adds the condition of most information gain until no kept row is covered."""
    rule: Rule = ()
    at = np.ones(len(x), bool)
    while len(rule) < LONGEST and (at & ~bad).any() and (at & bad).any():
        p0, n0 = (at & bad).sum(), (at & ~bad).sum()
        best, choice = 0.0, None
        for k, name in enumerate(RATIOS):
            v = x[at, k]
            b = bad[at]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            ends = np.flatnonzero(np.append(v[1:] > v[:-1], True))  # last row of each value
            p, n = np.cumsum(b)[ends], np.cumsum(~b)[ends]
            for above in (False, True):
                pp, nn = (p, n) if not above else (p0 - np.append(0, p[:-1]), n0 - np.append(0, n[:-1]))
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp >= LEAST, pp * (np.log2(pp / (pp + nn)) - np.log2(p0 / (p0 + n0))), 0)
                i = int(np.argmax(gain))
                if gain[i] > best + 1e-12:
                    near = (i - 1 if above else i + 1)
                    t = v[ends[i]] if not 0 <= near < len(ends) else (v[ends[i]] + v[ends[near]]) / 2
                    best, choice = gain[i], Condition(name, above, float(t))
        if choice is None:
            break
        rule += (choice,)
        at &= choice.holds(x)
    return rule


def learn(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Rules that reject, in order. y: 1 for rows to keep."""
    bad = y < 0.5
    test = np.random.default_rng(0).random(len(x)) < 1 / 3
    rules: list[Rule] = []
    while len(rules) < MOST_RULES and (bad & ~test).sum() >= LEAST:
        rule = _grow(x[~test], bad[~test])
        while len(rule) > 1 and _smoothed(rule[:-1], x[test], bad[test]) >= _smoothed(rule, x[test], bad[test]):
            rule = rule[:-1]
        covered, right = _counts(rule, x[test], bad[test])
        if not rule or right < LEAST_TESTED or right < PRECISION * covered:
            break
        rules.append(rule)
        left = ~covers(rule, x)
        x, bad, test = x[left], bad[left], test[left]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as an ordered conditional expression over COUNTS: true keeps."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """The columns ``keep``, the COUNTS, base_failed and kept for every row."""
    rules = learn(*training_sample(docs, labels, max_rows, id_col, text_col))
    counted = with_counts(docs, keep, text_col).withColumn("base_failed", base_failed())
    return counted.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns only, whatever these are called."""
    rules = learn(*training_sample(docs, labels, max_rows, id_col, text_col))
    numbered = docs.toDF(*[f"__{k}" for k in range(len(docs.columns))])
    kept = with_counts(numbered, numbered.columns, f"__{docs.columns.index(text_col)}").where(~base_failed() & verdict(rules))
    return kept.select(*[F.col(f"__{k}").alias(c) for k, c in enumerate(docs.columns)])


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = judge(docs, labels, ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
