"""Operator 9: language-model scores by prediction by partial matching over bytes.

Training documents (crc32 of the id modulo 10 is not 0) give counts of every byte with its four preceding bytes; four bytes FF
stand before a text and one byte FE ends it (neither occurs in UTF-8). The counts are summed by Spark over all of
them and make a context trie. Escapes follow method C (distinct symbols over total plus distinct), with full
symbol exclusion: what a longer context has seen leaves the shorter ones, whose sums of excluded counts are tabulated per context. Beyond
order 0 the 256 byte values less those seen share the rest evenly. A score is the sum of log10 over all bytes and the end.

The trie is a partitioned table at every size, and the context is always four bytes. Only the log probabilities of the commonest nodes, at most
``FREQUENT_NODES``, and the logs of the commonest words, at most ``FREQUENT``, go to the tasks (a histogram of counts decides which); a document's other bytes and words are kept
with their numbers and meet theirs in a join, where bytes new to their context are followed down to shorter ones. What goes where changes no score. Words are known by a 64-bit hash.

A-Z are lower-cased throughout. A null or empty text has one token, its end; texts of any length are read in windows. Without training rows, as in an
empty table or where all ids are null, counts are zero and bytes uniform. Rows with a null id never train, so they count as held out. Repeated rows train as often as they stand and get
equal scores; rows are told apart by a row number, so ids may repeat. Only the id and the text are read, so extra columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, materialise, remainder, utf8

ORDER = 4
FREQUENT_NODES = 2_000_000
FREQUENT = 100_000
START, END = 0xFF, 0xFE
WORDS, BYTES = 0, 1
END_TOKEN = b"\n"  # never a word
WINDOW = 1 << 20
FLUSH = 400_000


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - 2**64 if h >= 2**63 else h


def contexts(joined: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, position) of each byte but START: the byte and the ``order`` before it, the oldest highest. The first ``order`` bytes only precede."""
    wide = joined.astype(np.uint64)
    key = wide[order:].copy()
    for k in range(1, order + 1):
        key |= wide[order - k : len(wide) - k] << np.uint64(8 * k)
    at = np.flatnonzero(joined[order:] != START)
    return key[at], at


def windows(text: bytes, order: int) -> Iterator[np.ndarray]:
    """A text framed by START and END bytes, in overlapping pieces of bounded size."""
    framed = np.frombuffer(bytes([START]) * order + text + bytes([END]), np.uint8)
    for k in range(0, len(framed) - order, WINDOW):
        yield framed[k : k + WINDOW + order]


def grouped(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, text number of each) in pieces of about WINDOW: short texts together, long ones in windows."""
    held, numbers, size = [], [], 0
    for number, text in enumerate(texts):
        for piece in windows(text, order):
            held.append(piece), numbers.append(number)
            size += len(piece)
            if size >= WINDOW:
                yield np.concatenate(held), np.repeat(numbers, [len(p) for p in held])
                held, numbers, size = [], [], 0
    if held:
        yield np.concatenate(held), np.repeat(numbers, [len(p) for p in held])


def _sum_by(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))) if n is None else (np.add.reduceat(n, first) if len(keys) else n)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, n): partial counts of words and of bytes in context."""

    def rows(kind: int, keys, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["kind", "key", "n"])

    words: Counter = Counter()
    keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        texts = [t.translate(LOWER) for t in utf8(batch.column(0))]
        for text in texts:
            words.update(text.split())
            if len(words) > FLUSH:
                yield rows(WORDS, [word_hash(w) for w in words], list(words.values()))
                words.clear()
        words[END_TOKEN] += len(texts)
        for joined, _ in grouped(texts, ORDER):
            k, m = _sum_by(contexts(joined, ORDER)[0])
            keys, n = _sum_by(np.concatenate([keys, k]), np.concatenate([n, m]))
            if len(keys) > 4 * FLUSH:
                yield rows(BYTES, keys.view(np.int64), n)
                keys, n = keys[:0], n[:0]
    if words:
        yield rows(WORDS, [word_hash(w) for w in words], list(words.values()))
    if len(keys):
        yield rows(BYTES, keys.view(np.int64), n)


class Known:
    """A hash table of keys and values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(10, int(2 * max(len(keys), 1)).bit_length())
        self.slots = np.full(1 << self.bits, 2**64 - 1, np.uint64)  # no key: it would have START as its last byte
        self.values = np.zeros(1 << self.bits, np.float32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.slots[at[left]] == np.uint64(2**64 - 1)
            take, first = np.unique(at[left[free]], return_index=True)
            won = left[free][first]
            self.slots[take], self.values[take] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's value, and which keys there are."""
        at = self._slot(keys)
        found = self.slots[at]
        hit = found == keys
        out = np.where(hit, self.values[at], 0).astype(np.float64)
        left = np.flatnonzero(~hit & (found != np.uint64(2**64 - 1)))
        while len(left):  # other keys' slots: look on
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            found = self.slots[at[left]]
            same = found == keys[left]
            out[left[same]], hit[left[same]] = self.values[at[left[same]]], True
            left = left[~same & (found != np.uint64(2**64 - 1))]
        return out, hit


def score_known(texts: list[bytes], known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text the sum over the known bytes in context; and (text, key, times) of the others, in order of text."""
    out, owners, others = np.zeros(len(texts)), [], []
    for joined, numbers in grouped(texts, ORDER):
        keys, at = contexts(joined, ORDER)
        text = numbers[ORDER:][at]
        logs, hit = known.find(keys)
        out += np.bincount(text, logs, len(texts))
        owners.append(text[~hit]), others.append(keys[~hit])
    owner, key = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((owners, np.int64), (others, np.uint64)))
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))) if len(key) else np.zeros(0, np.int64)
    return out, owner[first], key[first], np.diff(np.append(first, len(key)))


def _scores(model):
    """Per row: id, n_tokens, known and base of the frequent words, the score of the frequent nodes, and the other words and bytes (kinds, keys, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, frequent = model.value
        for batch in batches:
            texts = [t.translate(LOWER) for t in utf8(batch.column(1))]
            tokens, known, base, kinds, keys, times = [], [], [], [], [], []
            score, owner, other, other_n = score_known(texts, nodes)
            ends = np.searchsorted(owner, np.arange(len(texts) + 1))
            for k, text in enumerate(texts):
                words = Counter(text.split())
                words[END_TOKEN] = 1
                mine, logs, rare, rare_n = 0, 0.0, [], []
                for w, n in words.items():
                    h = word_hash(w)
                    c = frequent.get(h)
                    if c is None:
                        rare.append(h), rare_n.append(n)
                    else:
                        mine += n
                        logs += n * c
                of = slice(ends[k], ends[k + 1])
                tokens.append(words.total()), known.append(mine), base.append(logs)
                kinds.append([WORDS] * len(rare) + [BYTES] * (of.stop - of.start))
                keys.append(rare + other[of].view(np.int64).tolist()), times.append(rare_n + other_n[of].tolist())
            columns = [batch.column(0), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            columns += [pa.array(kinds, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kind, key, n): counts over all training documents, in the shared folder."""
    rows = docs.where(F.coalesce(remainder(F.col(id_col), 10), F.lit(0)) != 0).select(text_col)
    return materialise(rows.mapInArrow(_gather, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))


@dataclass
class Trie:
    """The model as tables. nodes: (level, node, n), a context and symbol of each order; contexts: (level, context, total, distinct, excluded), the
    last the counts that the next shorter one has of its symbols."""

    nodes: DataFrame
    contexts: DataFrame


def mask(level: int) -> Column:
    return F.lit(2 ** (8 * (level + 1)) - 1)


def trie_of(grams: DataFrame) -> Trie:
    """From (key, n), the counts of five bytes."""
    levels = [materialise(grams.select(F.col("key").alias("node"), "n"))]
    for k in range(ORDER - 1, -1, -1):
        levels.append(materialise(levels[-1].groupBy(F.col("node").bitwiseAND(mask(k)).alias("node")).agg(F.sum("n").alias("n"))))
    levels.reverse()
    contexts_ = []
    for k, nodes in enumerate(levels):
        below = levels[k - 1].select(F.col("node").alias("shorter"), F.col("n").alias("less")) if k else None
        with_less = nodes.join(below, F.col("node").bitwiseAND(mask(k - 1)) == F.col("shorter")) if k else nodes.withColumn("less", F.lit(0).cast("long"))
        sums = with_less.groupBy(F.shiftright("node", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("less").alias("excluded"))
        contexts_.append(sums.select(F.lit(k).alias("level"), "*"))
    nodes = reduce(DataFrame.unionByName, [x.select(F.lit(k).alias("level"), "node", "n") for k, x in enumerate(levels)])
    return Trie(nodes, materialise(reduce(DataFrame.unionByName, contexts_)))


def commonest(table: DataFrame, most: int) -> DataFrame:
    """The rows of a table with counts n whose counts are highest: as many sixteenths of a doubling as hold ``most`` rows at most."""
    size = F.floor(F.log2("n") * 16).cast("int")
    held, least = 0, None
    for found in table.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # at most 16 rows for each doubling
        held += found["count"]
        if held > most:
            break
        least = found["size"]
    return table.where(size >= least) if least is not None else table.limit(0)


def probabilities(wanted: DataFrame, trie: Trie) -> DataFrame:
    """(key, log): the log10 probability of each key's last byte after the bytes before it. ``wanted``: distinct keys."""
    steps = wanted.select("key", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("level"))
    cut = F.lit(-1)
    for k in range(ORDER + 1):
        cut = F.when(F.col("level") == k, mask(k)).otherwise(cut)
    node = F.col("key").bitwiseAND(cut)
    steps = steps.select("key", "level", node.alias("node"), F.shiftright(node, 8).alias("context"))
    met = steps.join(trie.nodes, ["level", "node"], "left").join(trie.contexts, ["level", "context"], "left")
    at = lambda c, k: F.max(F.when(F.col("level") == k, F.col(c))).alias(f"{c}{k}")
    wide = met.groupBy("key").agg(*[at(c, k) for c in ("n", "total", "distinct", "excluded") for k in range(ORDER + 1)])
    out, passed = None, F.lit(0.0)
    for k in range(ORDER, -1, -1):
        longer = k < ORDER  # a context that was never seen excludes nothing
        total = F.col(f"total{k}") - (F.coalesce(f"excluded{k + 1}", F.lit(0)) if longer else 0)
        distinct = F.col(f"distinct{k}") - (F.coalesce(f"distinct{k + 1}", F.lit(0)) if longer else 0)
        seen, log = F.col(f"n{k}").isNotNull(), passed + F.log10(F.col(f"n{k}") / (total + distinct))
        out = F.when(seen, log) if out is None else out.when(seen, log)
        passed = passed + F.when(distinct > 0, F.log10(distinct / (total + distinct))).otherwise(0.0)
    return wide.select("key", out.otherwise(passed - F.log10(F.greatest(F.lit(1), 256 - F.coalesce("distinct0", F.lit(0))))).alias("log"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent_nodes: int = FREQUENT_NODES, frequent: int = FREQUENT) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = docs.sparkSession
    counts = train(docs, id_col, text_col)
    words = counts.where(F.col("kind") == WORDS).select("key", "n")
    trie = trie_of(counts.where(F.col("kind") == BYTES).select("key", "n"))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scale = total + 0.1 * (distinct + 1)

    common = commonest(words, frequent).toArrow()
    logs = np.log10((common["n"].to_numpy() + 0.1) / scale)
    deepest = commonest(trie.nodes.where(F.col("level") == ORDER).select("node", "n"), frequent_nodes)
    of = trie.contexts.where(F.col("level") == ORDER).select("context", "total", "distinct")
    nodes = deepest.join(of, F.shiftright("node", 8) == F.col("context")).select("node", F.log10(F.col("n") / (F.col("total") + F.col("distinct"))).alias("log")).toArrow()
    known = Known(nodes["node"].to_numpy().astype(np.int64).view(np.uint64), nodes["log"].to_numpy())
    shared = spark.sparkContext.broadcast((known, dict(zip(common["key"].to_pylist(), logs.tolist(), strict=True))))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, known long, base double, score double, kinds array<int>, keys array<long>, times array<long>"
    rows = docs.select(id_col, text_col).mapInArrow(_scores(shared), schema).withColumn("__row", F.monotonically_increasing_id())
    rows = materialise(rows)
    rare = rows.select("__row", F.explode(F.arrays_zip("kinds", "keys", "times")).alias("o")).select("__row", F.col("o.kinds").alias("kind"), F.col("o.keys").alias("key"), F.col("o.times").alias("times"))
    wanted = rare.where(F.col("kind") == BYTES).select("key").distinct()
    values = words.select(F.lit(WORDS).alias("kind"), "key", F.log10((F.col("n") + 0.1) / F.lit(float(scale))).alias("log")).unionByName(
        materialise(probabilities(wanted, trie)).select(F.lit(BYTES).alias("kind"), "key", "log"))
    met = rare.join(values, ["kind", "key"], "left")
    word, log = F.col("kind") == WORDS, F.col("times") * F.coalesce("log", F.lit(math.log10(0.1 / scale)))
    sums = met.groupBy("__row").agg(
        F.sum(F.when(word, log).otherwise(0.0)).alias("more"), F.sum(F.when(word, 0.0).otherwise(log)).alias("more_score"),
        F.sum(F.when(word & F.col("log").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
    )
    out = rows.drop("kinds", "keys", "times").join(sums, "__row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select(
        id_col, "n_tokens", plus("known", "more_known").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), plus("base", "more").alias("base_score"),
        plus("score", "more_score").alias("score"),
    )


def op9_ppm(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    out = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 10) == 0, F.lit(True)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
