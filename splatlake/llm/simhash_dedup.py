"""Operator 5: near-duplicates by SimHash, found through Golay-code keys.

A document's fingerprint has a bit set where more than half of its 3-word shingle hashes have it. Equal fingerprints form
one class. The 64 bits are cut into segments of 22, 21 and 21 bits; of at most two differing bits, one segment of the
cyclic pairs (C, A), (A, B), (B, C) always has none while its partner has one at most (pigeonhole). The partner is decoded with
the perfect [23,12,7] Golay code to the index of its nearest codeword and, where that is three bits off, of the five
codewords four bits off: two words one bit apart always share an index. So each class gets 16 keys or so of exact segment and index.

Classes that share a key in a bucket of at most ``max_bucket`` are joined as pairs and verified. Larger buckets
take an exact linear way instead: each member gives its fingerprint and the 64 one bit away; two fingerprints differ in two bits or fewer exactly
if they share one of these 65 words, so linking each to the smallest holder of the word loses nothing.

Fewer than three words: the whole sequence is the shingle; none (null, empty, white space only): fingerprint zero, linked
like any other. Repeated rows are copies; null ids get the component of their fingerprint. Components take the smallest id.

``similar_documents`` is the wider search, for filtering: links are pairs of a Jaccard similarity of 0.8 or more on five-word shingle
sets. Such texts differ in ten bits of 64 or so, which no Golay key of useful selectivity bridges. So the pairs within two bits are joined by
those that share one of eight bands of three min-hashes, and every pair is verified on its whole sets. Texts of equal words are one class first.
Each class meets the smallest class of every bucket. What these stars leave apart is searched without loss: two sets of that similarity share one at least of each one's
smallest shingles, all but 0.8 of the set less one. Classes of different components that share such a shingle are tried, in groups of at most ``max_bucket``. Those of
larger groups are searched again by the rarest shingles among them instead of the smallest, and there groups of any size give all pairs. So no link is lost; a crowd
of texts that are all nearly as similar as a link asks costs the square of its size.
Texts without words are one class. Null ids, repeated rows, long texts and empty tables are as above.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, connected_components, materialise, release, small_batches, utf8

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # lowest bit, width
PAIRS = ((2, 0), (0, 1), (1, 2))  # exact segment, decoded segment
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
CHUNK = 1 << 16
MOST_BROADCAST = 2_000_000
SLICES = 4  # parts in which whole shingle sets are shuffled, one after the other
BANDS, ROWS = 8, 3  # 0.997 of the pairs at a similarity of 0.8 share a band


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included, in big-endian order of bytes."""
    h = xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, dtype=">u8")
    if len(words) < n:
        return np.array([h(b" ".join(words), 42)], dtype=">u8")
    return np.fromiter((h(b" ".join(words[k : k + n]), 42) for k in range(len(words) - n + 1)), dtype=np.uint64, count=len(words) - n + 1).astype(">u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; none of none."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, n: int = 3) -> int:
    """SimHash of lower-cased word shingles, repeats included; ties give 0."""
    return majority(shingle_hashes(text.translate(LOWER).split(), n))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in utf8(batch.column(2))], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["id", "check", "fp"])


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of 0..2047 shifted by 12 bits; per syndrome the error pattern; the five patterns of weight four, or zeros."""

    def syndrome(word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= GENERATOR << (k - 11)
        return word

    unit = [syndrome(1 << k) for k in range(23)]
    leader, five, held = np.zeros(2048, np.int64), np.zeros((2048, 5), np.int64), np.zeros(2048, np.int64)
    for weight in (1, 2, 3, 4):
        for bits in combinations(range(23), weight):
            s, word = 0, 0
            for k in bits:
                s, word = s ^ unit[k], word | 1 << k
            if weight < 4:
                leader[s] = word
            else:
                five[s, held[s]] = word
                held[s] += 1
    high = np.zeros(4096, np.int64)
    for x in range(4096):
        for k in range(12):
            if x >> k & 1:
                high[x] ^= unit[11 + k]
    return high, leader, five


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word the indices (top 12 bits) of its nearby codewords, six columns, and which of them hold."""
    high, leader, five = golay_tables()
    s = high[words >> 11] ^ (words & 2047)
    near = words ^ leader[s]
    others = words[:, None] ^ five[s]
    holds = np.concatenate([np.ones((len(words), 1), bool), five[s] != 0], axis=1)
    return np.concatenate([near[:, None], others], axis=1) >> 11, holds


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) for each fingerprint (unsigned 64-bit)."""
    parts = [((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    keys, rows = [], []
    for family, (exact, fuzzy) in enumerate(PAIRS):
        index, holds = golay_indices(parts[fuzzy])
        key = (family << 40) | (parts[exact][:, None] << 12) | index
        row, _ = np.nonzero(holds)
        keys.append(key[holds]), rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        keys, rows = keys_of(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["key", "fp"])


def near_edges(classes: DataFrame, max_bucket: int = 64) -> DataFrame:
    """(a, b): enough pairs of fingerprints at two differing bits or fewer to connect every component. ``classes``: distinct fp."""
    keys = materialise(classes.select("fp").mapInArrow(_keys, "key long, fp long"))
    sizes = materialise(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = materialise(keys.join(sizes, "key"))
    release(keys, sizes)
    small = shared.where(F.col("n") <= max_bucket).select("key", "fp")
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 2))
    large = shared.where(F.col("n") > max_bucket).select("fp").distinct()
    around = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)]
    words = materialise(large.select("fp", F.explode(F.array(*around)).alias("word")))
    first = materialise(words.groupBy("word").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").select("word", "low"))
    stars = words.join(first, "word").where("fp <> low")
    edges = materialise(pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).unionByName(stars.select(F.col("fp").alias("a"), F.col("low").alias("b"))).distinct())
    release(shared, words, first)
    return edges


def text_check(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = 64) -> DataFrame:
    """(id, check, fp, component): of every row the xxhash64 of its text, the signed fingerprint and the smallest id it reaches."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_check(F.col(text_col)).alias("check"), F.col(text_col).alias("text"))
    prints = materialise(small_batches(rows).mapInArrow(_fingerprints, "id long, check long, fp long"))
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("low")))
    roots = connected_components(near_edges(classes, max_bucket))
    rooted = materialise(classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = materialise(rooted.groupBy("root").agg(F.min("low").alias("component")))
    known = materialise(rooted.join(lowest, "root").select("fp", "component"))
    return prints.join(known, "fp", "left").select(F.col("id").alias(id_col), "check", "fp", "component")


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors of the min-hash functions, as columns."""
    numbers = np.array([xxhash.xxh64_intdigest(k.to_bytes(4, "little")) for k in range(2 * BANDS * ROWS)], dtype=np.uint64)
    return numbers[: BANDS * ROWS, None], numbers[BANDS * ROWS :, None] | np.uint64(1)


def bands_of(hashes: np.ndarray) -> list[int]:
    """One signed key for each band of min-hashes."""
    masks, factors = _permutations()
    low = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(hashes), CHUNK):
        part = hashes[k : k + CHUNK].astype(np.uint64)
        np.minimum(low, ((part ^ masks) * factors).min(axis=1), out=low)
    keys = [xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def needed(n: int, similarity: float) -> int:
    """So many shingles does a set of ``n`` have in common with one that similar, at least."""
    return math.ceil(similarity * n - 1e-9)


def _sketches(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sizes, prints, bands, firsts = [], [], [], [], []
            for text in utf8(batch.column(3)):
                parts = text.translate(LOWER).split()
                hashes = shingle_hashes(parts, words)
                classes.append(xxhash.xxh64_intdigest(b" ".join(parts), 7))
                distinct = np.unique(hashes.astype(np.uint64))
                sizes.append(len(distinct))
                firsts.append(distinct[: len(distinct) - needed(len(distinct), similarity) + 1 if len(distinct) else 0].view(np.int64))
                prints.append(majority(hashes))
                bands.append(bands_of(hashes))
            signed = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (classes, prints)]
            keys = np.array(bands, dtype=np.int64).reshape(-1, BANDS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], signed[0], pa.array(sizes, pa.int64()), signed[1], *(pa.array(keys[:, b]) for b in range(BANDS)), pa.array(firsts, pa.list_(pa.int64()))],
                ["id", "check", "ref", "class", "n", "fp", *(f"k{b}" for b in range(BANDS)), "first"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.translate(LOWER).split(), words)).astype(np.uint64).view(np.int64) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["class", "shingles"])

    return run


def _hinted(df: DataFrame) -> DataFrame:
    """A table that is read for the second time, broadcast up to ``MOST_BROADCAST`` rows."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _in_slices(table: Callable[[Callable[[str], Column]], DataFrame]) -> DataFrame:
    """The tables that ``table`` gives for each of ``SLICES`` conditions on a column, together. Each is written before the next is made, so that only its shuffles are on disk."""
    parts = [materialise(table(lambda c, k=k: F.pmod(F.xxhash64(c), F.lit(SLICES)) == k)) for k in range(SLICES)]
    whole = materialise(reduce(DataFrame.unionByName, parts))
    release(*parts)
    return whole


def _shingle_sets(part: DataFrame, classes: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(class, shingles) of the classes in ``part``, from one row of each. Texts are not shuffled unless the rows are too many to broadcast."""
    refs = materialise(classes.join(part, "class", "left_semi").select("class", "ref"))
    sets = materialise(small_batches(rows.join(_hinted(refs), "ref").select("class", "text")).mapInArrow(_sets(words), "class long, shingles array<long>").dropDuplicates(["class"]))
    release(refs)
    return sets


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of classes whose shingle sets are that similar. One row of each class that takes part gives its set.

    A class of many pairs sends its set with each. So that these copies are not all on disk at once, the pairs are taken in ``SLICES`` parts by ``b``.
    """
    part = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    sets = _shingle_sets(part, classes, rows, words)
    x, y = (sets.select(F.col("class").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    alike = both * (1 + similarity) >= similarity * (F.size("of_a") + F.size("of_b")) - 1e-9
    links = _in_slices(lambda part: _hinted(pairs.where(part("b"))).join(x, "a").join(y.where(part("b")), "b").where(alike).select("a", "b"))
    release(sets)
    return links


def _pairs(groups: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of each group that no link connects yet and whose sizes allow the similarity."""
    x, y = (groups.select("g", *[F.col(c).alias(f"{p}_{c}") for c in ("class", "n", "root")]) for p in "xy")
    fits = F.least("x_n", "y_n") >= similarity * F.greatest("x_n", "y_n") - 1e-9
    return x.join(y, "g").where((F.col("x_root") != F.col("y_root")) & (F.col("x_class") < F.col("y_class")) & fits).select(F.col("x_class").alias("a"), F.col("y_class").alias("b"))


def _apart(held: DataFrame, rooted: DataFrame) -> DataFrame:
    """(g, class, n, root, size): the groups of ``held`` (g, class) that have classes of several components."""
    often = materialise(held.groupBy("g").agg(F.count("*").alias("size")).where("size > 1"))
    met = materialise(held.join(often, "g").join(rooted.select("class", "n", "root"), "class"))
    mixed = met.groupBy("g").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("g")
    apart = materialise(met.join(mixed, "g", "left_semi"))
    release(often, met)
    return apart


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, max_bucket: int = 32) -> DataFrame:
    """(id, check, class, component): of every row the xxhash64 of its text, the hash of its words and the smallest id linked to it, directly or through others."""
    text = F.col(text_col)
    id_ = F.col(id_col).cast("long")
    rows = docs.select(id_.alias("id"), text_check(text).alias("check"), F.xxhash64(id_, F.coalesce(text, F.lit(""))).alias("ref"), text.alias("text"))
    bands = [f"k{b}" for b in range(BANDS)]
    sketches = materialise(small_batches(rows).mapInArrow(_sketches(words, similarity), "id long, check long, ref long, class long, n long, fp long, " + ", ".join(f"{k} long" for k in bands) + ", first array<long>"))
    classes = materialise(sketches.groupBy("class").agg(F.min("id").alias("low"), *[F.min(c).alias(c) for c in ("ref", "n", "fp", *bands)]))

    prints = materialise(classes.groupBy("fp").agg(F.min("class").alias("a")))
    edges = near_edges(prints)
    near = edges.toDF("x", "y")
    close = near.join(prints.toDF("x", "a"), "x").join(prints.toDF("y", "b"), "y").select("a", "b")
    same = classes.join(prints, "fp").select("a", F.col("class").alias("b"))
    keys = classes.select("class", "n", F.posexplode(F.array(*bands)).alias("band", "key"))
    first = materialise(keys.groupBy("key").agg(F.min("class").alias("a"), F.count("*").alias("size")).where("size > 1").select("key", "a"))
    keys = materialise(keys.join(first, "key"))
    release(first)
    stars = keys.select("a", F.col("class").alias("b"))

    def distinct(pairs: DataFrame) -> DataFrame:
        return materialise(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    tried = distinct(close.unionByName(same).unionByName(stars))
    release(edges, prints, keys)
    links = _verified(tried, classes, rows, words, similarity)
    roots = connected_components(links)

    rooted = materialise(classes.join(roots, classes["class"] == roots.node, "left").select("class", "n", "ref", F.coalesce("root", "class").alias("root")))
    release(roots)
    held = rooted.join(sketches.select("class", "ref", "first"), ["class", "ref"]).select("class", "first")
    held = materialise(held.select(F.explode("first").alias("g"), "class"))
    groups = _apart(held, rooted)
    release(held)
    crowded = groups.where(F.col("size") > max_bucket).select("class").distinct()
    of_crowds = _shingle_sets(crowded, classes, rows, words)
    sets = of_crowds.select("class", F.size("shingles").alias("n"), F.explode("shingles").alias("g"))
    counts = _in_slices(lambda part: sets.where(part("g")).groupBy("g").agg(F.count("*").alias("holders")).where("holders > 1"))

    def rarest(part: Callable[[str], Column]) -> DataFrame:
        ordered = sets.where(part("class")).join(counts, "g").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("holders", "g"))).alias("order"))
        # Shingles that one class alone has come first and meet nothing.
        first = F.size("order") - F.ceil(similarity * F.col("n") - 1e-9) + 1
        return ordered.where(first > 0).select("class", F.explode(F.slice("order", F.lit(1), first.cast("int"))).alias("o")).select("o.g", "class")

    rare = _in_slices(rarest)
    release(of_crowds, counts)
    again = _apart(rare, rooted)
    more = distinct(_pairs(groups.where(F.col("size") <= max_bucket), similarity).unionByName(_pairs(again, similarity)))
    release(groups, rare, again)
    new = materialise(more.join(tried, ["a", "b"], "left_anti"))
    others = _verified(new, classes, rows, words, similarity)
    release(more, tried)

    roots = connected_components(links.unionByName(others))
    release(links, others)
    whole = materialise(classes.join(roots, classes["class"] == roots.node, "left").select("class", "low", F.coalesce("root", "class").alias("root")))
    lowest = materialise(whole.groupBy("root").agg(F.min("low").alias("component")))
    known = materialise(whole.join(lowest, "root").select("class", "component"))
    found = materialise(sketches.join(known, "class", "left").select(F.col("id").alias(id_col), "check", "class", "component"))
    release(sketches, classes, rooted, roots, new, whole, lowest, known)
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[..., DataFrame] = similar_documents) -> DataFrame:
    """One row of each component of ``groups``: the smallest id and, where rows repeat that id, the one whose text hash is smallest.

    Rows without an id cannot be named, so all of them stay. What goes is joined, which is less than what stays: texts are shuffled only
    where the ids that go are too many to broadcast.
    """
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).cast("long").alias("__id"), text_check(F.col(text_col)).alias("__check"))
    found = groups(docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")), "__id", "__text")
    gone = materialise(found.where(F.col("__id") != F.col("component")).select("__id", F.col("check").alias("__check")).distinct())
    often = materialise(found.where(F.col("__id") == F.col("component")).groupBy("__id").count().where("count > 1").select("__id"))
    release(found)
    single = rows.join(often, "__id", "left_anti").join(gone, ["__id", "__check"], "left_anti").select("__row")
    repeated = rows.join(often, "__id", "left_semi").join(gone, ["__id", "__check"], "left_anti").groupBy("__id").agg(F.min_by("__row", "__check").alias("__row"))
    return single.unionByName(repeated.select("__row")).select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
