"""Plain versions of the text operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser
from urllib.parse import urlsplit

import public_tokenizers as P
import regex
import tiktoken
import xxhash

from splatlake.llm.bpe import read_ranks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_RANKS = read_ranks(P.path("byte_bpe_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=_RANKS, special_tokens={})


def lines_kept(texts, least=10, ids=None):
    """Per text: the kept text, lines, lines dropped. Texts of one id are one document."""
    ids = range(len(texts)) if ids is None else [t if i is None else i for i, t in zip(ids, texts, strict=True)]
    split = [(t or "").split("\n") for t in texts]
    key = lambda line: line.strip(BLANK).translate(LOWER)
    n = Counter(k for k, _ in {(key(x), i) for lines, i in zip(split, ids, strict=True) for x in lines} if k)
    out = []
    for lines in split:
        kept = [x for x in lines if n[key(x)] < least]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n = Counter(windows)
    covered = {p for k, w in enumerate(windows) if n[w] > 1 for p in range(k, k + 5)}
    lines = text.split("\n")
    dup = sum(1 for k, x in enumerate(lines) if WORD.search(x) and x in lines[:k])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def alike(a, b, least=0.8):
    """Whether two sets have that Jaccard similarity; two empty ones have."""
    both = len(a & b)
    return both * (1 + least) >= least * (len(a) + len(b)) - 1e-9


def shingle_set(text, n=5):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) or frozenset([tuple(words)] if words else [])


def components(ids, prints, link=lambda a, b: (a ^ b).bit_count() <= 2):
    """Smallest id that each row reaches by links."""
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if link(prints[a], prints[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(ids)):
        groups[find(k)].append(ids[k])
    return [min((i for i in groups[find(k)] if i is not None), default=None) for k in range(len(ids))]


def tokens(text):
    ids = TIKTOKEN.encode_ordinary(text or "")
    packed = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(TIKTOKEN.decode_bytes(ids)).hexdigest()


def ppm(train, tests, order=4):
    """log10 probabilities with escape method C and full exclusion, by dictionaries."""
    seen = defaultdict(Counter)
    frame = lambda t: b"\xff" * order + t + b"\xfe"
    for t in map(frame, train):
        for k in range(order, len(t)):
            for n in range(order + 1):
                seen[t[k - n : k]][t[k]] += 1
    out = []
    for t in map(frame, tests):
        total = 0.0
        for k in range(order, len(t)):
            gone: set = set()
            for n in range(order, -1, -1):
                if (here := seen.get(t[k - n : k])) is None:
                    continue
                left = {s: c for s, c in here.items() if s not in gone}
                size = sum(left.values()) + len(left)
                if t[k] in left:
                    total += math.log10(left[t[k]] / size)
                    break
                total += math.log10(len(left) / size) if left else 0
                gone |= set(here)
            else:
                total -= math.log10(256 - len(gone))
        out.append(total)
    return out


class Dom(HTMLParser):
    """Nested lists [tag, classes, children] of well-formed markup."""

    def __init__(self, page):
        super().__init__()
        self.stack = [["", "", []]]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = [tag, " ".join(dict(attrs).get("class", "").split()), []]
        self.stack[-1][2].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def site_texts(pages, off=("nav", "footer", "ad"), unseen=4, least=0.2, inside=0.1):
    """Main texts of (url, html) by a site style tree over plain dictionaries. Every element is a block; ``off``: tags or classes that aren't content."""
    trees = [(urlsplit(u).hostname, Dom(h).stack[0]) for u, h in pages]
    styles, holders = defaultdict(Counter), Counter()
    gone = lambda n: n[0] in off or n[1] in off
    level = lambda x: re.sub("[0-9]+", "0", " ".join(x.split()))

    def walk(node, path):
        yield node, path
        for c in node[2]:
            if isinstance(c, list) and not gone(c):
                yield from walk(c, (*path, (c[0], c[1])))

    def shown(node):
        return {level(c) for c in node[2] if isinstance(c, str)} - {""}

    for host, root in trees:
        once = {}
        for node, path in walk(root, ()):
            labels = [(c[0], c[1]) for c in node[2] if isinstance(c, list)]
            once.setdefault(path, tuple(a for k, a in enumerate(labels) if not k or labels[k - 1] != a))
        for path, s in once.items():
            styles[host, path][s] += 1
        holders.update({(host, path, x) for node, path in walk(root, ()) for x in shown(node)})

    def importance(host, node, path):
        n = styles[host, path]
        m = sum(n.values())
        inner = [importance(host, c, (*path, (c[0], c[1]))) for c in node[2] if isinstance(c, list) and not gone(c)]
        inner += [1 - math.log(holders[host, path, x]) / math.log(m + unseen) for x in shown(node)]
        own = -sum(k / m * math.log(k / m) for k in n.values()) / math.log(m + unseen)
        g = 0.9 ** (len(n) - 1)
        return min(1, (1 - g) * own + g * sum(inner) / len(inner)) if inner else 0

    def blocks(host, node, path, weight, top=True):
        if gone(node) or (not top and importance(host, node, path) + weight < least):
            return []
        out = []
        for c in node[2]:
            out += blocks(host, c, (*path, (c[0], c[1])), weight, False) if isinstance(c, list) else [" ".join(c.split())]
        return [x for x in out if x]

    texts = []
    for host, root in trees:
        tops, inner = [], None
        for node, path in walk(root, ()):
            if node[0] == "article" and path[: len(inner or ())] != (inner or "none"):
                tops.append((node, path))
                inner = path
        for chosen, weight in ((tops, inside), (tops, 1), ([(root, ())], 0)):
            if found := [x for node, path in chosen for x in blocks(host, node, path, weight)]:
                break
        texts.append("\n".join(found))
    return texts


def leak(text, item, share=0.8):
    """(windows, hits, changed) of an item that a text holds, or None, by looking at every alignment."""
    from splatlake.llm.decontaminate import UNITS

    def split(t):
        return regex.sub(r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "", t or "").strip(BLANK).split()

    def form(words, named):
        out = []
        for w in words:
            w = w if named else w.lower()
            w = "_n" if regex.match(r"\p{Lu}", w) else "_q" if regex.match(r"\p{N}", w) else w.lower()
            out.append("_u" if out and out[-1] == "_q" and w in UNITS else w)
        return out

    a, b = split(text), split(item)
    if len(b) < 5:
        low, small = [w.lower() for w in a], [w.lower() for w in b]
        return (1, 1, False) if b and any(low[k : k + len(b)] == small for k in range(len(a))) else None
    cut = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    theirs = list(zip(*(cut(form(a, named)) for named in (True, False)), strict=True))
    best = None
    for named in (True, False):
        f = form(b, named)
        mine = cut(f)
        hits, changes = set(), {}
        for shift in range(-len(mine), len(theirs)):
            at = [i for i in range(len(mine)) if 0 <= i + shift < len(theirs) and mine[i] in theirs[i + shift]]
            to = defaultdict(Counter)
            for i in at:
                for k in range(i, i + 5):
                    if f[k][0] == "_":
                        to[b[k].lower()][a[k + shift].lower()] += 1
            if sum(max(c.values()) for c in to.values()) >= share * sum(c.total() for c in to.values()):
                hits |= {mine[i] for i in at}
                n = sum(any(x != o for x in c) for o, c in to.items())
                for i in at:
                    changes[mine[i]] = min(n, changes.get(mine[i], n))
        size = len(set(mine))
        if len(hits) >= math.ceil(size * share - 1e-9) and (best is None or len(hits) / size > best[1] / best[0]):
            best = size, len(hits), max(changes.values()) > 0
    return best
