"""Operator 8: near-duplicate passages by compact windows.

Lower-cased words make five-word shingles; ``HASHES`` functions hash them. For each function a Cartesian tree over the hashes of a text
gives its compact windows (l, c, r): every subsequence from l..c to c..r has its minimum at c. A window is kept as the range of places
where passages of ``MIN_WORDS`` words with that minimum begin; windows that hold none are not made, so there are about two per 46 shingles and function.

Windows whose minimum one text alone has are dropped. In each text an interval join over the places cuts those of every two functions
into joint windows: the passages that begin there share both minima, which is the key. Texts of a key are candidates, as passages
that agree under two functions: exact passages agree under all, passages of Jaccard 0.8 under two of four functions with a chance of 0.97 at each place.
Groups of at most ``ALL_PAIRS`` texts give all their pairs; in larger ones each member is paired with the group's shortest text.

Exact passages lose nothing by that: in larger groups of the first two functions, and in those where a text has the key at several places, each passage of
``MIN_WORDS`` words that begins in a joint window is counted by its hash, and is repeated if two texts hold it. All other exact passages meet in a group
that gives all its pairs. Nor do passages that are only similar: a minimum of a larger group that no passage found so far covers is held against all other members,
of which some can hold such a passage: at least as many shingles as it has in a row, four shared ones for each that either text has alone. Those are tried there, on the surroundings;
of the ones that hold a passage the most similar and those that reach furthest are then verified on whole texts, and all of them if none does. Members of a group are
compared in tiles of ``QUERIES`` times ``MEMBERS``, each pair once, on 32-bit hashes, whose collisions only add tries. Passages of twice the length and more are
searched from the minima of their parts. Members that are covered have their links through the texts
they were found with; those are not expanded into all pairs.

Verification has both texts: from each shared minimum the passage grows both ways while shared shingles outweigh others 8 to 1, which is
Jaccard 0.8: to the best balance over the whole texts, else in step with each other, else as far as the balance holds, else as far as both are equal. What
falls short of ``MIN_WORDS`` words on either side is widened to them. Then its exact Jaccard similarity must be 0.8. A minimum at several places of the texts is tried from each of them against the
other text's first and the one of the same rank, so anchors grow in proportion to the texts. Equal texts are one class, whose windows count once; a class of two
documents or more is repeated from end to end if it has ``MIN_WORDS`` words.

Null, empty and shorter texts have no passage; long texts are cut into pieces only to hash their words. Equal minima: the one nearest the middle. Null ids
are kept; repeated rows are copies of each other. An empty table gives an empty result. Only the id and the text are read, so extra columns may have any name. Texts,
shingles and words are known by 64-bit hashes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, materialise, release, utf8

N = 5
MIN_WORDS = 50
HASHES = 4
ALL_PAIRS = 8
SIMILARITY = 0.8
MOST_BROADCAST = 1_000_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: One hash function each: odd multipliers of the shingles' hashes.
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
BOTH = list(combinations(range(HASHES), 2))  # the functions of a joint window; the first counts exact passages
TOGETHER = 1 << 19  # words whose trees grow at a time
PIECE = 1 << 18  # bytes whose words are hashed at a time
PARTS = 4  # of the pairs whose texts are on the way at a time
SLICE = 256  # pairs whose texts and anchors a task unpacks at a time
QUERIES, MEMBERS = 128, 1024  # places of a group that a task compares at a time, about
REMEMBERED = 1 << 23  # shingles of texts met before that a task holds
KNOWN = 1 << 20  # texts that a task remembers to have seen


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out, done = np.ones(n, np.uint64), 1
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(pow(base, done, 2**64))
        done += k
    return out


BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * FACTOR)
IS_BLANK = np.isin(np.arange(256), list(BLANKS))
UP, DOWN = _powers(int(FACTOR), PIECE + 1), _powers(pow(int(FACTOR), -1, 2**64), PIECE + 1)
BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting."""
    out = np.sort(values)
    return out[np.append(True, out[1:] != out[:-1])] if len(out) else out


def _unbroken(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows, sorted by ``names``, in tables that hold all rows of each of their groups, and where the groups begin and end."""
    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = pa.concat_tables([held, part]).combine_chunks() if held is not None else part
        if not part.num_rows:
            continue
        keys = [part.column(n).to_numpy() for n in names]
        starts = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
        held = part.slice(starts[-1])
        if len(starts) > 1:
            yield part.slice(0, starts[-1]), starts
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def _hash_words(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of at most PIECE bytes, and where they begin. A word's hash is a difference of running sums, moved to place 0."""
    data = np.frombuffer(blob, np.uint8)
    edges = np.flatnonzero(np.diff(IS_BLANK[data], prepend=True, append=True))
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * UP[: len(data)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * DOWN[start]), start


def _hash_long(text: bytes) -> np.ndarray:
    """As _hash_words of a text of any length. Words of PIECE bytes or more have a hash of their own kind."""
    found, at = [], 0
    while at < len(text):
        cut = len(text)
        if len(text) - at >= PIECE:
            cut = max(text.rfind(bytes([b]), at, at + PIECE) for b in BLANKS)
            if cut < at:
                m = BLANK.search(text, at)
                cut = m.start() if m else len(text)
                found.append(np.array([xxhash.xxh3_64_intdigest(text[at:cut])], np.uint64))
                at = cut
                continue
            cut += 1
        found.append(_hash_words(text[at:cut])[0])
        at = cut
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the five-word shingles of all texts, one after the other, and how many each has."""
    words, counts = [], np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    size = first = 0

    def flush(upto: int) -> None:
        nonlocal held, size, first
        if held:
            got, start = _hash_words(b"\n".join(held).translate(LOWER))
            ends = np.cumsum([len(t) + 1 for t in held])
            counts[first:upto] = np.diff(np.searchsorted(start, ends), prepend=0)
            words.append(got)
        held, size, first = [], 0, upto

    for k, text in enumerate(texts):
        if size + len(text) + 1 >= PIECE:
            flush(k)
        if len(text) + 1 >= PIECE:
            words.append(_hash_long(text.translate(LOWER)))
            counts[k], first = len(words[-1]), k + 1
        else:
            held.append(text)
            size += len(text) + 1
    flush(len(texts))
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    n = len(flat) - N + 1
    if n < 1:
        return flat[:0], np.zeros(len(texts), np.int64)
    out = flat[:n].copy()
    for k in range(1, N):
        out = out * FACTOR + flat[k : k + n]
    owner = np.repeat(np.arange(len(texts)), counts)
    return _mix(out[owner[:n] == owner[N - 1 :]]), np.maximum(counts - N + 1, 0)


def shingles(text: bytes) -> np.ndarray:
    """A 64-bit hash of each five-word shingle."""
    return shingles_of([text])[0]


def compact_windows(values: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows that span ``least`` values, in many texts at once; r is the last place.

    ``ends`` are the ends of the texts in ``values``. The Cartesian trees grow level by level: each stretch splits at its minimum, of
    equal ones at the one next to its middle, and parts shorter than ``least`` are dropped.
    """
    lo, hi, found = np.append(0, ends[:-1]), ends, []
    while True:
        long = hi - lo >= least
        lo, hi = lo[long], hi[long]
        if not len(lo):
            return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (lo, lo, lo)
        sizes = hi - lo
        offsets = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(lo - offsets, sizes)
        part = values[at]
        hit = np.flatnonzero(part == np.repeat(np.minimum.reduceat(part, offsets), sizes))
        stretch = np.searchsorted(offsets, hit, "right") - 1
        if len(hit) > len(lo):
            order = np.lexsort((np.abs(hit - offsets[stretch] - sizes[stretch] // 2), stretch))
            hit, stretch = hit[order], stretch[order]
            hit = hit[np.append(True, stretch[1:] != stretch[:-1])]
        centre = at[hit]
        found.append((lo, centre, hi - 1))
        lo, hi = np.stack([lo, centre + 1], axis=1).ravel(), np.stack([centre, hi], axis=1).ravel()


#: place: the centre, and in its lowest 32 bits how far before it passages begin first and last.
WINDOWS = "key long, check long, n_words int, place long"


def _windows(min_words: int):
    least = min_words - N + 1

    def rows(checks: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        base, counts = shingles_of(texts)
        long = counts >= least
        base, check, counts = base[np.repeat(long, counts)], np.array(checks, np.int64)[long], counts[long]
        if not len(counts):
            return
        ends = np.cumsum(counts)
        starts = ends - counts
        for f in range(HASHES):
            values = base * ODD[f]
            l, c, r = compact_windows(values, ends, least)  # noqa: E741
            text = np.searchsorted(ends, c, "right")
            key = (values[c] & ~np.uint64(3) | np.uint64(f)).view(np.int64)
            here = starts[text]
            place = (c - here) << 32 | np.minimum(c - l, least - 1) << 16 | np.maximum(c - r + least - 1, 0)
            columns = [pa.array(key), pa.array(check[text]), pa.array((counts + N - 1)[text].astype(np.int32)), pa.array(place.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "check", "n_words", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of WINDOWS: per function the compact windows of a text as ranges of the places where passages begin. Texts met before in this task are left out."""
        known: set[int] = set()
        for batch in batches:
            checks, texts, size = [], [], 0
            for check, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if check in known:
                    continue
                if len(known) < KNOWN:
                    known.add(check)
                checks.append(check), texts.append(text)
                size += len(text)
                if size > 6 * TOGETHER:
                    yield from rows(checks, texts)
                    checks, texts, size = [], [], 0
            yield from rows(checks, texts)

    return run


JOINT = "key long, check long, n_words int, centres array<int>, starts array<int>"


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of JOINT from (check, n_words, key, place), sorted by check: per two functions and their minima the places in a text of the first one's.

    starts: for the first two functions the first and last place of each joint window, by turns.
    """
    for table, cuts in _unbroken(batches, ["check"]):
        checks, n_words, key, packed = (table.column(n).to_numpy() for n in ("check", "n_words", "key", "place"))
        text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        checks, n_words = checks[cuts[:-1]], n_words[cuts[:-1]].astype(np.int64)
        offset = np.append(0, np.cumsum(n_words)[:-1])
        centre = packed >> 32
        first, last = centre - (packed >> 16 & 0xFFFF) + offset[text], centre - (packed & 0xFFFF) + offset[text]
        function = key & 3
        part = {}
        for f in range(HASHES):
            at = np.flatnonzero(function == f)
            part[f] = at[np.argsort(first[at], kind="stable")]
        for pair, (f, g) in enumerate(BOTH):
            a, b = part[f], part[g]
            low, high = np.searchsorted(last[b], first[a], "left"), np.searchsorted(first[b], last[a], "right")
            n = np.maximum(high - low, 0)
            ia = np.repeat(a, n)
            ib = b[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            joint = _mix(key[ia].view(np.uint64) * FACTOR + key[ib].view(np.uint64)) & ~np.uint64(7) | np.uint64(pair)
            owner, place = text[ia], centre[ia]
            order = np.lexsort((np.maximum(first[ia], first[ib]), joint, owner))
            joint, owner, place, ia, ib = (x[order] for x in (joint, owner, place, ia, ib))
            new = np.append(True, (joint[1:] != joint[:-1]) | (owner[1:] != owner[:-1])) if len(joint) else np.zeros(0, bool)
            again = ~new & (np.append(-1, place[:-1]) == place) if len(joint) else new
            rows = np.flatnonzero(new)
            kept = np.flatnonzero(~again)
            centres = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(kept, rows), len(kept)).astype(np.int32)), pa.array(place[kept].astype(np.int32)))
            if pair:
                starts = pa.array([None] * 0, pa.list_(pa.int32())) if not len(rows) else pa.nulls(len(rows), pa.list_(pa.int32()))
            else:
                ranges = np.stack([np.maximum(first[ia], first[ib]) - offset[owner], np.minimum(last[ia], last[ib]) - offset[owner]], axis=1).astype(np.int32).ravel()
                starts = pa.ListArray.from_arrays(pa.array((2 * np.append(rows, len(joint))).astype(np.int32)), pa.array(ranges))
            columns = [pa.array(joint[rows].view(np.int64)), pa.array(checks[owner[rows]]), pa.array(n_words[owner[rows]].astype(np.int32)), centres, starts]
            yield pa.RecordBatch.from_arrays(columns, ["key", "check", "n_words", "centres", "starts"])


def _rolling(base: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` shingles in a row."""
    if len(base) < width:
        return base[:0]
    out, done, power, step = np.zeros(len(base) + 1, np.uint64), 0, base, 1
    factor = FACTOR
    while True:  # power: hashes of ``step`` shingles; out: of the ``done`` first of each stretch
        if width & step:
            n = len(base) - done - step + 1
            out = out[:n] * factor + power[done : done + n]
            done += step
        if done == width:
            return _mix(out)
        power = power[:-step] * factor + power[step:]
        factor, step = np.uint64(int(factor) ** 2 % 2**64), 2 * step


def _exact(min_words: int):
    least = min_words - N + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, check, first) from (check, text, ranges): a hash of each passage of the least length that begins in the ranges, once per text."""
        for batch in batches:
            keys, checks, firsts = [], [], []
            for check, text, ranges in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                whole = _rolling(shingles(text), least)
                steps = np.zeros(len(whole) + 1, np.int64)
                ends = np.concatenate([np.asarray(r, np.int64) for r in ranges])
                np.add.at(steps, ends[::2], 1)
                np.add.at(steps, ends[1::2] + 1, -1)
                at = np.flatnonzero(np.cumsum(steps[:-1]))
                key, place = np.unique(whole[at], return_index=True)
                keys.append(key.view(np.int64)), checks.append(np.full(len(key), check, np.int64)), firsts.append(at[place].astype(np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, checks, firsts)], ["key", "check", "first"])

    return run


class Stretches:
    """Stretches round a place whose shared shingles (+1) outweigh the others (-8); everything but ``longest`` is looked up."""

    def __init__(self, shared: np.ndarray) -> None:
        n = len(shared)
        self.shared, self.sums = shared, np.append(0, np.cumsum(np.where(shared, 1, -8)))
        sums, places = self.sums, np.arange(n + 1)
        lowest = np.minimum.accumulate(sums)
        self.start = np.maximum.accumulate(np.where(np.append(True, sums[1:] < lowest[:-1]), places, 0))
        back = sums[::-1]
        highest = np.maximum.accumulate(back)
        self.end = n - np.maximum.accumulate(np.where(np.append(True, back[1:] > highest[:-1]), places, 0))[::-1]
        self.highest, self.reach = highest, None

    def best(self, c: int) -> tuple[int, int]:
        """The stretch round c of the best balance; of equal ones the longest."""
        return int(self.start[c]), int(self.end[c + 1]) - 1

    def longest(self, c: int) -> tuple[int, int]:
        """The longest stretch round c whose balance isn't negative, cut back to shared shingles."""
        if self.reach is None:
            n, places = len(self.shared), np.arange(len(self.sums))
            self.reach = np.searchsorted(-self.highest[::-1], -self.sums, "right") - 1  # the last end with no less than each start's sum
            self.next = np.minimum.accumulate(np.where(np.append(self.shared, True), places, n)[::-1])[::-1]
            self.last = np.maximum.accumulate(np.where(self.shared, places[:-1], -1)) if n else self.shared
        sizes = self.reach[: c + 1] - np.arange(c + 1)
        first = int(np.where(self.reach[: c + 1] > c, sizes, 0).argmax())
        return int(self.next[first]), int(self.last[self.reach[first] - 1])


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values


Passage = tuple[int, int, int, int, int, int]


def passages(
    a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int]], min_words: int, sorted_a: np.ndarray | None = None, sorted_b: np.ndarray | None = None, sure: frozenset[tuple[int, int]] = frozenset()
) -> list[Passage]:
    """(anchor a, first and last word in a, anchor b, first and last word in b) of verified passages. ``sorted_a``, ``sorted_b``: distinct shingles in order;
    ``sure``: anchors that have one in their surroundings; if no other is found, it is taken."""
    least = min_words - N + 1
    reach = 2 * least - 2
    sorted_a, sorted_b = _distinct(a) if sorted_a is None else sorted_a, _distinct(b) if sorted_b is None else sorted_b
    shared_a, shared_b = _among(a, sorted_b), _among(b, sorted_a)
    if 5 * min(np.count_nonzero(shared_a), np.count_nonzero(shared_b)) < 4 * least:  # too few for a passage of the least length
        return []
    in_b, in_a = Stretches(shared_a), Stretches(shared_b)
    found: list[Passage] = []
    tried: dict[tuple[int, int, int, int], bool] = {}
    steps: dict[int, tuple[int, Stretches]] = {}

    def similar(a0: int, a1: int, b0: int, b1: int) -> bool:
        if (span := (a0, a1, b0, b1)) not in tried:
            sa, sb = _distinct(a[a0 : a1 + 1]), _distinct(b[b0 : b1 + 1])
            both = int(_among(sa, sb).sum())
            tried[span] = both >= SIMILARITY * (len(sa) + len(sb) - both)
        return tried[span]

    def spans(ca: int, cb: int) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
        yield in_b.best(ca), in_a.best(cb)
        if (shift := cb - ca) not in steps:
            if len(steps) > 64:
                steps.clear()
            start = max(0, -shift)
            on = min(len(a) - start, len(b) - start - shift)
            steps[shift] = start, Stretches(a[start : start + on] == b[start + shift : start + shift + on])
        start, step = steps[shift]
        g0, g1 = step.best(ca - start)
        yield (start + g0, start + g1), (start + shift + g0, start + shift + g1)
        yield in_b.longest(ca), in_a.longest(cb)
        other = np.flatnonzero(~step.shared)
        k = int(np.searchsorted(other, ca - start))
        g0, g1 = start + (int(other[k - 1]) + 1 if k else 0), start + (int(other[k]) if k < len(other) else len(step.shared)) - 1
        yield (g0, g1), (g0 + shift, g1 + shift)

    def padded(first: int, last: int, n: int) -> tuple[int, int]:
        last = min(n - 1, max(last, first + least - 1))
        return max(0, min(first, last - least + 1)), last

    for ca, cb in sorted(anchors):
        if a[ca] != b[cb] or any(x[1] <= ca <= x[2] - N + 1 and x[4] <= cb <= x[5] - N + 1 for x in found):
            continue
        for span_a, span_b in spans(ca, cb):
            (a0, a1), (b0, b1) = padded(*span_a, len(a)), padded(*span_b, len(b))
            if 5 * min(span_a[1] - span_a[0] + 1, span_b[1] - span_b[0] + 1) >= 4 * least and similar(a0, a1, b0, b1):
                found.append((ca, a0, a1 + N - 1, cb, b0, b1 + N - 1))
                break
        else:
            if (ca, cb) in sure:
                la, lb = max(0, ca - reach), max(0, cb - reach)
                here = passages(a[la : ca + reach + 1], b[lb : cb + reach + 1], [(ca - la, cb - lb)], min_words)
                found += [(ca, la + a0, la + a1, cb, lb + b0, lb + b1) for _, a0, a1, _, b0, b1 in here]
    return found


def anchors_of(places_a: list[int], places_b: list[int]) -> Iterator[tuple[int, int]]:
    """Each place with the other text's first one, and with the one of the same rank."""
    for k in range(max(len(places_a), len(places_b))):
        a, b = places_a[min(k, len(places_a) - 1)], places_b[min(k, len(places_b) - 1)]
        yield a, b
        yield a, places_b[0]
        yield places_a[0], b


#: Anchors of two places as one number, its lowest 31 bits the second, the next one for those that have a passage in their surroundings; where a minimum has several places in a text, ``repeats`` has them all.
PAIR = "a long, b long, anchors array<long>, repeats array<struct<ca:array<int>,cb:array<int>>>"


def _verify(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (check, centre, first, last, other) for both sides of verified pairs."""
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def of(texts: dict[int, bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
            nonlocal size
            if size > REMEMBERED:
                held.clear()
                size = 0
            new = [c for c in texts if c not in held]
            flat, counts = shingles_of([texts[c] for c in new])
            for check, base in zip(new, np.split(flat, np.cumsum(counts)[:-1]), strict=False):
                held[check] = base, _distinct(base)
                size += 2 * len(base)
            return held

        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            columns: list[list] = [[] for _ in range(5)]
            names = {n: k for k, n in enumerate(batch.schema.names)}
            col = lambda n: batch.column(names[n])
            checks_a, checks_b = col("a").to_pylist(), col("b").to_pylist()
            known = of(dict(zip(checks_a, utf8(col("text_a")), strict=True)) | dict(zip(checks_b, utf8(col("text_b")), strict=True)))
            for a, b, anchors, repeats in zip(checks_a, checks_b, col("anchors").to_pylist(), col("repeats").to_pylist(), strict=True):
                near = frozenset((x >> 32, x & 0x7FFFFFFF) for x in anchors if x & 1 << 31)
                pairs = {(x >> 32, x & 0x7FFFFFFF) for x in anchors} | {x for p in repeats for x in anchors_of(p["ca"], p["cb"])}
                (base_a, sorted_a), (base_b, sorted_b) = known[a], known[b]
                for ca, a0, a1, cb, b0, b1 in passages(base_a, base_b, list(pairs), min_words, sorted_a, sorted_b, near):
                    for column, values in zip(columns, ((a, b), (ca, cb), (a0, b0), (a1, b1), (b, a)), strict=True):
                        column += values
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["check", "centre", "first", "last", "other"])

    return run


def _surroundings(min_words: int):
    least = min_words - N + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (check, centre, bare, middle, shingles) from (check, text, places): the shingle at a place, and in 32 bits all shingles of the passages of less than
        twice the least length that hold it."""
        for batch in batches:
            checks, centres, bare, middles, found = [], [], [], [], []
            for check, text, places in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                base = shingles(text).view(np.int64)
                for p in places:
                    c = p["centre"]
                    checks.append(check), centres.append(c), bare.append(p["bare"]), middles.append(base[c])
                    found.append(base[max(0, c - 2 * least + 2) : c + 2 * least - 1].astype(np.int32))
            if checks:
                columns = [pa.array(checks, pa.int64()), pa.array(centres, pa.int32()), pa.array(bare, pa.bool_()), pa.array(middles, pa.int64()), pa.array(found, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["check", "centre", "bare", "middle", "shingles"])

    return run


def _columns(values: np.ndarray, sizes: np.ndarray, before: np.ndarray, reach: int, fill: int) -> np.ndarray:
    """A column for each of the surroundings, with the shingle at the place in row ``reach`` and ``before`` others above it."""
    out = np.full((len(sizes), 2 * reach + 1), fill, values.dtype)
    row, top = np.arange(2 * reach + 1), (reach - before)[:, None]
    out[(row >= top) & (row < top + sizes[:, None])] = values
    return np.ascontiguousarray(out.T)


def _weights(values: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each shingle counts on the way from the place to either side: where it is shared 1, else -4, and 0 where it has been met on that side; nor do losses
    after the place count that are met before it too. Last, how many shingles of each of the surroundings are repeats."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    after = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes) > before[owner]
    side = 1 << 32
    key = owner << 33 | np.where(after, side, 0) | values
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else order
    ends, runs = np.append(starts[1:], len(key)) - 1, key[starts]
    later = runs & side != 0
    met = order[np.where(later, starts, ends)]
    twice = met[_among(runs ^ side, runs)] if len(runs) else met
    gains = np.zeros(len(values), np.int16)
    gains[met] = 1
    losses = -4 * gains
    losses[twice[after[twice]]] = 0
    distinct = np.bincount(owner[met], minlength=len(sizes)) - np.bincount(owner[twice], minlength=len(sizes)) // 2
    return gains, losses, sizes - distinct


def _alike_each(
    x: np.ndarray, sizes_x: np.ndarray, before_x: np.ndarray, y: np.ndarray, sizes_y: np.ndarray, before_y: np.ndarray, least: int, jaccard: bool = False
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As ``alike``, for one after the other of x: its number, those of y, and which of its surroundings' shingles each of these shares.

    ``jaccard``: only those where both passages together can be similar. That takes four shared shingles for each that either has alone, and a passage has
    as many alone as the best stretch of the least length at least.
    """
    reach = 2 * least - 2
    names, x = np.unique(x, return_inverse=True)
    at = np.minimum(np.searchsorted(names, y), len(names) - 1)
    nobody = len(names)  # stands for shingles of no x, and for places outside of the text
    outside = -4 * reach
    weights_x, weights_y = _weights(x, sizes_x, before_x), _weights(y, sizes_y, before_y)
    y = np.where(names[at] == y, at, nobody)
    gain_x, loss_x = (_columns(w, sizes_x, before_x, reach, out) for w, out in zip(weights_x[:2], (0, outside), strict=True))
    gain_y, loss_y = (_columns(w, sizes_y, before_y, reach, out) for w, out in zip(weights_y[:2], (0, outside), strict=True))
    places_x, places_y = (_columns(v, n, k, reach, nobody) for v, n, k in ((x, sizes_x, before_x), (y, sizes_y, before_y)))
    in_y = np.zeros((nobody + 1, len(sizes_y)), bool)
    in_y[places_y, np.arange(len(sizes_y))] = True
    in_y[nobody] = False
    ends = np.arange(reach + 1, 2 * reach + 2)
    latest = np.minimum(reach, ends - least)  # the last start of a passage that ends there

    def balance(gains: np.ndarray, losses: np.ndarray, shared: np.ndarray) -> np.ndarray:
        sums = np.zeros((2 * reach + 2, shared.shape[1]), np.int16)
        np.cumsum(np.where(shared, gains, losses), axis=0, out=sums[1:])
        return (sums[ends] - np.minimum.accumulate(sums[: reach + 1], axis=0)[latest]).max(axis=0)

    def alone(losses: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Four times the fewest shingles that a passage has alone."""
        sums = np.zeros((2 * reach + 2, shared.shape[1]), np.int16)
        np.cumsum(np.where(shared, np.int16(0), -losses), axis=0, out=sums[1:])
        return (sums[reach + 1 : reach + 1 + least] - sums[reach + 1 - least : reach + 1]).min(axis=0)

    for k in range(len(sizes_x)):
        shared = in_y[places_x[:, k]]
        distinct = max(1, least - weights_x[2][k])  # in a passage at least
        some = np.flatnonzero(5 * np.count_nonzero(shared, axis=0) >= 4 * distinct)
        if not len(some):
            continue
        best = balance(gain_x[:, k, None], loss_x[:, k, None], shared[:, some])
        some, best = some[best >= 0], best[best >= 0]
        if not len(some):
            continue
        in_x = np.zeros(nobody + 1, bool)
        in_x[places_x[:, k]] = True
        in_x[nobody] = False
        also, losses = in_x[places_y[:, some]], loss_y[:, some]
        fits = balance(gain_y[:, some], losses, also) >= (alone(loss_x[:, k, None], shared[:, some]) if jaccard else 0)
        if jaccard:
            fits &= best >= alone(losses, also)
        some = some[fits]
        if len(some):
            yield k, some, shared[:, some]


def alike(x: np.ndarray, sizes_x: np.ndarray, before_x: np.ndarray, y: np.ndarray, sizes_y: np.ndarray, before_y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of surroundings that can hold a passage of similarity 0.8 round their places: ``least`` shingles or more, of which a fifth at most is not the other's.

    ``x`` and ``y`` hold the shingles of all surroundings, one after the other, ``before`` how many of them stand before the place. A passage's distinct shingles
    are at most those met on the way to its two ends if they are shared, and at least those of one side and what only the other side has if not, so no such pair is left out.
    """
    none = np.zeros(0, np.int64)
    found = [(np.full(len(some), k), some) for k, some, _ in _alike_each(x, sizes_x, before_x, y, sizes_y, before_y, least)]
    return np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)])


def furthest(shared: np.ndarray, reach: int, proven: Callable[[int], bool]) -> Iterator[int]:
    """Of the proven columns the one with most shared shingles, and those whose stretch of the best balance reaches further before and after the place than that one's."""
    first = next((m for m in np.argsort(-np.count_nonzero(shared, axis=0), kind="stable").tolist() if proven(m)), None)
    if first is None:
        return
    yield first
    sums = np.zeros((2 * reach + 2, shared.shape[1]), np.int16)
    np.cumsum(np.where(shared, np.int16(1), np.int16(-8)), axis=0, out=sums[1:])
    before = reach - sums[: reach + 1].argmin(axis=0)
    after = reach - sums[: reach : -1].argmax(axis=0)
    for far in (before, after):
        further = np.flatnonzero(far > far[first])
        order = further[np.argsort(-far[further], kind="stable")].tolist()
        yield from islice((m for m in order if proven(m)), 1)


def _alike(min_words: int):
    least = min_words - N + 1
    reach = 2 * least - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, b, anchor) from (middle, across, down, query, check, centre, shingles), sorted by the first three: for each query of a tile others that hold a
        passage round its place (``furthest``); if none does there, all that are ``alike``. Equal surroundings are tried once, and a text with equal ones at several places with one of them."""
        for table, ends in _unbroken(batches, ["middle", "across", "down"]):
            query, check, centre = (table.column(n).to_numpy() for n in ("query", "check", "centre"))
            shingles = table.column("shingles").combine_chunks()
            values, cuts = shingles.flatten().to_numpy(), shingles.offsets.to_numpy()
            cuts, before = cuts - cuts[0], np.minimum(centre, reach)
            pairs: list[tuple[int, int, bool]] = []
            for low, high in zip(ends[:-1], ends[1:], strict=True):
                kinds: dict[tuple[bytes, int], int] = {}
                kind = {r: kinds.setdefault((values[cuts[r] : cuts[r + 1]].tobytes(), int(before[r])), r) for r in range(low, high)}
                places: tuple[dict[tuple[int, int], list[int]], ...] = ({}, {})  # of each kind and text, the others and the queries
                for r in range(low, high):
                    places[int(query[r])].setdefault((kind[r], int(check[r])), []).append(r)
                others, asking = (np.array([p[0] for p in x.values()], np.int64) for x in places)
                if not len(others) or not len(asking):
                    continue
                ordered = {r: _distinct(values[cuts[r] : cuts[r + 1]]) for r in set(kind.values())}
                tried: dict[tuple[int, int], bool] = {}

                def proven(i: int, m: int, kind=kind, ordered=ordered, tried=tried) -> bool:  # noqa: ANN001
                    if (both := (kind[i], kind[m])) not in tried:
                        one, two = (values[cuts[r] : cuts[r + 1]] for r in both)
                        tried[both] = bool(passages(one, two, [(int(before[i]), int(before[m]))], min_words, ordered[both[0]], ordered[both[1]]))
                    return tried[both]

                def flat(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                    own = np.concatenate([values[cuts[r] : cuts[r + 1]] for r in rows]).astype(np.int64) & 0xFFFFFFFF
                    return own, cuts[rows + 1] - cuts[rows], before[rows]

                for k, some, shared in _alike_each(*flat(asking), *flat(others), least, jaccard=True):
                    i, apart = int(asking[k]), check[others[some]] != check[asking[k]]
                    j, shared = others[some[apart]].tolist(), shared[:, apart]
                    taken = set(furthest(shared, reach, lambda m, i=i, j=j: proven(i, j[m])))
                    pairs += [(q, j[m], bool(taken)) for q in places[1][kind[i], int(check[i])] for m in (taken or range(len(j)))]
            if pairs:
                i, j, sure = np.array(pairs).T
                i, j = np.where(check[i] > check[j], j, i), np.where(check[i] > check[j], i, j)
                columns = [check[i], check[j], centre[i].astype(np.int64) << 32 | sure << 31 | centre[j]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "anchor"])

    return run


def _hinted(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    texts = materialise(rows.join(_hinted(wanted, wanted.count()), "check", "left_semi").dropDuplicates(["check"]))
    release(wanted)
    return texts


def candidates(joint: DataFrame, groups: DataFrame, large: DataFrame, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """Rows of PAIR: pairs of texts that share a key of JOINT, in the groups of ``large`` only those with the group's shortest text."""
    small = joint.join(groups.where(F.col("n") <= all_pairs).select("key").hint("shuffle_hash"), "key").groupBy("key").agg(F.collect_list(F.struct("check", "centres")).alias("m"))
    pairs = small.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y")).where("x.check < y.check")
    pairs = pairs.select(F.col("x.check").alias("a"), F.col("y.check").alias("b"), F.col("x.centres").alias("ca"), F.col("y.centres").alias("cb"))
    lead = large.groupBy("key").agg(F.min(F.struct("n_words", "check", "centres")).alias("lead"))
    stars = large.join(lead, "key").where("lead.check <> check").select(
        F.col("lead.check").alias("a"), F.col("check").alias("b"), F.col("lead.centres").alias("ca"), F.col("centres").alias("cb"))
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[F.when(F.col("a") < F.col("b"), F.col(s)).otherwise(F.col(t)).alias(s) for s, t in (("ca", "cb"), ("cb", "ca"))])
    alone = (F.size("ca") == 1) & (F.size("cb") == 1)
    anchor = F.when(alone, F.shiftleft(F.col("ca")[0].cast("long"), 32).bitwiseOR(F.col("cb")[0].cast("long")))
    met = pairs.unionByName(stars).select("a", "b", anchor.alias("anchor"), F.when(~alone, F.struct("ca", "cb")).alias("more"))
    return materialise(met.groupBy("a", "b").agg(F.collect_set("anchor").alias("anchors"), F.collect_set("more").alias("repeats")))


def rest(large: DataFrame, ranges: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    """Rows of PAIR: of large groups each member whose minimum no range (check, first, last) covers, with another one that holds a similar passage there, or else with all that can hold one."""
    large = large.select("key", "check", F.explode("centres").alias("centre"))
    within = (F.col("check") == F.col("r_check")) & (F.col("centre") >= F.col("first")) & (F.col("centre") <= F.col("last") - (N - 1))
    bare = materialise(large.join(ranges.select(F.col("check").alias("r_check"), "first", "last"), within, "left_anti"))
    members = large.join(bare.select("key").distinct(), "key", "left_semi").select("check", "centre").distinct()
    members = members.join(bare.select("check", "centre", F.lit(True).alias("bare")).distinct(), ["check", "centre"], "left")
    places = members.groupBy("check").agg(F.collect_list(F.struct("centre", F.coalesce("bare", F.lit(False)).alias("bare"))).alias("places"))
    local = texts.join(places, "check").select("check", "text", "places").mapInArrow(_surroundings(min_words), "check long, centre int, bare boolean, middle long, shingles array<int>")
    local = materialise(local)
    release(bare)
    # The queries and the members of one middle shingle meet in tiles, so that no task holds a whole group.
    tiles = local.groupBy("middle").agg(F.ceil(F.count_if("bare") / QUERIES).cast("int").alias("across"), F.ceil(F.count("*") / MEMBERS).cast("int").alias("down"))
    tiles = materialise(tiles.where("across > 0"))
    tiled = local.join(_hinted(tiles, tiles.count()), "middle")
    own = F.xxhash64("check", "centre")

    def dealt(rows: DataFrame, query: bool) -> DataFrame:
        mine, others = ("across", "down") if query else ("down", "across")
        rows = rows.withColumn(mine, F.pmod(own, F.col(mine)).cast("int")).withColumn(others, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        return rows.select("middle", "across", "down", F.lit(query).alias("query"), "check", "centre", "shingles")

    tile = ["middle", "across", "down"]
    met = dealt(tiled.where("bare"), True).unionByName(dealt(tiled, False)).repartition(*tile).sortWithinPartitions(*tile)
    pairs = met.mapInArrow(_alike(min_words), "a long, b long, anchor long").groupBy("a", "b").agg(F.collect_set("anchor").alias("anchors"))
    found = materialise(pairs.withColumn("repeats", F.expr("cast(array() as array<struct<ca:array<int>,cb:array<int>>>)")))
    release(local, tiles)
    return found


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """(id, n_words, spans, partner) of documents with repeated passages: merged word ranges, last word included, and the smallest id of a text that shares one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("check"), text.alias("text"))
    ids = materialise(rows.select("id", "check"))
    texts = rows.select("check", "text")

    windows = materialise(texts.mapInArrow(_windows(min_words), WINDOWS))
    often = materialise(windows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    shared = windows.join(often.hint("shuffle_hash"), "key", "left_semi").dropDuplicates(["key", "check", "place"])
    by_text = shared.select("check", "n_words", "key", "place").repartition("check").sortWithinPartitions("check")
    joint = materialise(by_text.mapInArrow(_joint, JOINT))
    first_of_text = (F.shiftright("place", 32) == F.shiftright("place", 16).bitwiseAND(0xFFFF)) & (F.col("key").bitwiseAND(3) == 0)
    sizes = materialise(windows.where(first_of_text).select("check", "n_words").distinct())
    release(windows, often)
    groups = materialise(joint.groupBy("key").agg(F.count("*").alias("n"), F.max(F.size("centres")).alias("places")).where("n > 1"))
    crowds = groups.where(F.col("n") > all_pairs).select("key")
    large = materialise(joint.join(_hinted(crowds, crowds.count()), "key").select("key", "check", "n_words", "centres"))

    crowded = groups.where((F.col("key").bitwiseAND(7) == 0) & ((F.col("n") > all_pairs) | (F.col("places") > 1))).select("key")
    crowded = materialise(joint.join(_hinted(crowded, crowded.count()), "key", "left_semi").groupBy("check").agg(F.collect_list("starts").alias("ranges")))
    of_crowds = _texts(texts, crowded.select("check"))
    stretches = materialise(of_crowds.join(crowded, "check").mapInArrow(_exact(min_words), "key long, check long, first int"))
    release(crowded, of_crowds)
    holders = materialise(stretches.groupBy("key").agg(F.min("check").alias("least"), F.max("check").alias("most")).where("least < most"))
    other = F.when(F.col("check") == F.col("least"), F.col("most")).otherwise(F.col("least"))
    exact = stretches.join(holders, "key").select("check", F.floor(F.col("first") / min_words).alias("place"), "first", (F.col("first") + F.lit(min_words - 1)).alias("last"), other.alias("other"))

    met = candidates(joint, groups, large, all_pairs)
    release(joint, groups)
    both = _texts(texts, materialise(met.select(F.col("a").alias("check")).union(met.select("b")).distinct()))

    def verified(pairs: DataFrame, of: DataFrame) -> DataFrame:
        with_a = pairs.join(of.select(F.col("check").alias("a"), F.col("text").alias("text_a")), "a")
        with_both = with_a.join(of.select(F.col("check").alias("b"), F.col("text").alias("text_b")), "b")
        found = with_both.mapInArrow(_verify(min_words), "check long, centre int, first int, last int, other long")
        return found.select("check", F.col("centre").cast("long").alias("place"), F.lit(False).alias("exact"), "first", "last", "other")

    def united(ranges: DataFrame) -> DataFrame:
        """Passages round one centre hold it, and exact ones that begin within their own length touch: the union of either is one range."""
        return materialise(ranges.groupBy("check", "place", "exact").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("other").alias("other")))

    def in_parts(pairs: DataFrame, of: DataFrame) -> list[DataFrame]:
        """The passages of all pairs. Each pair carries both its texts, so one part after the other is shuffled and verified."""
        return [united(verified(pairs.where(F.pmod(F.xxhash64("a"), F.lit(PARTS)) == k), of)) for k in range(PARTS)]

    near = [united(exact.withColumn("exact", F.lit(True))), *in_parts(met, both)]
    release(stretches, holders, met)
    more = rest(large, reduce(DataFrame.unionByName, near), both, min_words)
    release(large)
    again = _texts(both, materialise(more.select(F.col("a").alias("check")).union(more.select("b")).distinct()))
    release(both)
    last = in_parts(more, again)
    release(more, again)
    ranges = reduce(DataFrame.unionByName, near + last)
    classes = materialise(ids.groupBy("check").agg(F.min("id").alias("low"), F.count("*").alias("copies")))
    partners = ranges.join(classes.select(F.col("check").alias("other"), "low"), "other").select("check", "first", "last", F.col("low").alias("partner"))
    whole = classes.where("copies > 1").join(sizes, "check").select("check", F.lit(0).alias("first"), (F.col("n_words") - 1).alias("last"), F.col("low").alias("partner"))
    merged = partners.unionByName(whole).groupBy("check").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("ranges"), F.min("partner").alias("partner"))
    spans = F.expr("""aggregate(ranges, cast(array() as array<struct<first:int,last:int>>), (s, r) -> if(size(s) > 0 and r.first <= s[size(s) - 1].last + 1,
        concat(slice(s, 1, size(s) - 1), array(named_struct('first', s[size(s) - 1].first, 'last', greatest(s[size(s) - 1].last, r.last)))),
        concat(s, array(named_struct('first', r.first, 'last', r.last)))))""")
    found = materialise(merged.select("check", spans.alias("spans"), "partner").join(sizes, "check"))
    release(*near, *last, classes, sizes)
    return ids.join(found, "check").select(F.col("id").alias(id_col), "n_words", "spans", "partner")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with passages of 50 words or more that other documents share."""
    out = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    repeated = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("spans").alias("n_spans"), repeated.alias("n_repeated"), "spans", F.col("partner").alias("partner_id"))
