"""Operator 7: main text of web pages by a site style tree.

The DOMs of all pages of a host are merged by style path: an element's path is the chain of its ancestors' tags and classes. For
each element of the merged tree Spark counts the pages that have it, the presentation styles (sequences of child elements) that they use, and
the content (texts and link targets) of its elements. Presentation importance is the entropy of the styles over the m pages, to base m; content
importance is one less the entropy of a feature, log n / log m for a feature of n pages, so what stands on every page has none. All logarithms of m
count ``UNSEEN`` pages more, so that few pages prove little. In each page importance is composed bottom-up,
``(1 - g**l) * own + g**l * mean(children)`` with l styles besides the first and g = 0.9.

One rule decides everywhere: a block goes whose importance plus the weight of its place is under ``THRESHOLD``. The weight is ``INSIDE`` in the
article (outermost article and main elements), 0 on pages without one, and -1 (never enough) outside the article and in menus, headers, footers, sidebars,
notices, adverts, forms and comments, known by their tags and class words. Thus what nearly all pages of a host repeat goes from articles too. Where all
of an article would go, it stays whole: a page's own article is no boilerplate.

Scripts, styles and markup give no text. Blocks end at block elements and <br>. Null or empty html, or pages without text: the empty text.
Broken markup closes as browsers close it, near enough: <p> ends at the next block, stray end tags count for nothing. Time and memory grow in proportion to
the page, however deep it nests. Repeated rows get equal texts; equal styles and features of a page count once. A null url is the host ''; null ids are
kept. An empty table gives an empty result. Only the id, url and html are read, so extra columns may have any name.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, utf8

GAMMA = 0.9
THRESHOLD = 0.2
INSIDE = 0.1
UNSEEN = 4
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s>/]*)[^>]*>"
    r"""|<(?P<start>[a-zA-Z][^\s>/]*+)(?P<attributes>(?>[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)(?=>)|[^>]*+)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|href)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe svg object canvas audio video head title textarea select button datalist".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
    "menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div body main nav aside footer header form html".split())
ROLES_OFF = frozenset("nav aside footer form menu dialog".split())
ROLE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar aside footer header masthead comment comments disqus respond reply replies share sharing social related recommended subscribe newsletter signup login search popup "
    "modal overlay pagination pager widget complementary contentinfo toolbar skip".split()
)
#: Before a role word these say that the element has such a part, not that it is one; the second set does so for headers only.
NOT_ITSELF = frozenset("has with no without is show hide".split())
OF_ARTICLE = frozenset("post entry article story content page section".split())


def names_role(words: str) -> bool:
    """Whether a class word such as ``cookie-banner`` names a menu, advert and so on; ``has-sidebar`` and ``entry-header`` don't."""
    for name in words.split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        for k, x in enumerate(parts):
            if x in ROLE_WORDS and not (k and (parts[k - 1] in NOT_ITSELF or (x == "header" and parts[k - 1] in OF_ARTICLE))):
                return True
    return False


class Node:
    """An element; children are elements and strings. path: a hash of its label and its ancestors'. role: 1 for articles, -1 for what isn't content."""

    __slots__ = ("tag", "label", "path", "children", "role", "href", "importance")

    def __init__(self, tag: str, attributes: str, parent: "Node | None") -> None:
        found = {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
        words = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower() if found else ""
        self.tag, self.children, self.href, self.importance = tag, [], found.get("href", ""), 1.0
        self.label = f"{tag}.{re.sub(r'[0-9]+', '0', words)}" if words.strip() else tag
        self.path = xxhash.xxh64_intdigest(self.label.encode("utf-8", "surrogatepass"), parent.path if parent else 0)
        self.role = 0
        if tag in ("html", "body"):
            pass
        elif tag in ("article", "main") or "main" in words.split():
            self.role = 1
        elif tag in ROLES_OFF or (tag == "header" and not (parent and parent.tag == "article")) or (words and names_role(words)):
            self.role = -1


def parse(page: str) -> Node:
    """The DOM of a page, its broken parts closed."""
    root = Node("", "", None)
    stack, at = [root], 0
    open_at: dict[str, list[int]] = {}  # places in the stack by tag
    scopes: list[int] = [0]

    def cut(k: int) -> None:
        for node in stack[k:]:
            open_at[node.tag].pop()
            if node.tag in SCOPES:
                scopes.pop()
        del stack[k:]

    def close(tags: tuple[str, ...]) -> None:
        """Ends the innermost of these elements inside the innermost scope."""
        k = max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)
        if k > scopes[-1]:
            cut(k)

    closed = page.rfind(">")  # no tag ends beyond
    while at < len(page):
        m = TOKEN.search(page, at) if at <= closed else None
        text = page[at : m.start()] if m else page[at:].split("<!--")[0]
        if text:
            stack[-1].children.append(entities.unescape(text))
        if not m:
            break
        at = m.end()
        if m["start"]:
            tag = m["start"].lower()
            if tag in BLOCK and tag != "br":
                close(("p",))
            if tag in ENDS:
                close(ENDS[tag])
            node = Node(tag, m["attributes"], stack[-1])
            stack[-1].children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID and not m["attributes"].endswith("/"):
                open_at.setdefault(tag, []).append(len(stack))
                if tag in SCOPES:
                    scopes.append(len(stack))
                stack.append(node)
        elif m["end"]:
            tag = m["end"].lower()
            if tag not in SCOPES:
                close((tag,))
            elif open_at.get(tag):
                cut(open_at[tag][-1])
    return root


def _signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def elements(root: Node) -> Iterator[Node]:
    """Elements that may be content, parents first; no recursion, as markup may nest deeply."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.role < 0:
            continue
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in SILENT)


def style(node: Node) -> str:
    """The presentation style: runs of equal child labels count once."""
    labels = [c.label for c in node.children if isinstance(c, Node)]
    return " ".join(a for a, b in zip(labels, [None, *labels], strict=False) if a != b)


def features(node: Node) -> list[str]:
    """Content of an element itself: its texts with digits levelled, and its link target."""
    own = dict.fromkeys(" ".join(re.sub(r"[0-9]+", "0", c).split()) for c in node.children if isinstance(c, str))
    own.pop("", None)
    return [*own, *(["href " + node.href] if node.href else [])]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def marked(root: Node, host: str) -> dict[tuple[int, int], int]:
    """What a page brings to its host's tree, each once, with its rank: (element, 0) is the element itself, (element, hash) a feature of its own."""
    seed, found = _hash(host, 0), {}
    for node in elements(root):
        element = node.path ^ seed
        found.setdefault((element, 0), len(found))
        for x in features(node):
            found.setdefault((element, _hash(x, element)), len(found))
    return found


SEEN = "page long, element long, feature long, style long, rank int"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SEEN from (page, url, html). feature: 0 for an element itself, whose style is given."""
    for batch in batches:
        columns: list[list] = [[] for _ in range(5)]
        for page, url, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
            root, host = parse(text.decode()), host_of(url)
            seed = _hash(host, 0)
            styles = {}
            for node in elements(root):
                styles.setdefault(node.path ^ seed, _hash(style(node), 1))
            for (element, feature), rank in marked(root, host).items():
                for column, value in zip(columns, (page, _signed(element), _signed(feature), 0 if feature else _signed(styles[element]), rank), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.int32()), strict=True)], [x.split()[0] for x in SEEN.split(", ")])


def compose(root: Node, host: str, marks: dict[int, tuple[float, int]]) -> None:
    """Sets the importance of every element, children first. marks: by rank the presentation importance and styles of an element, or the entropy of a feature."""
    rank, seed = marked(root, host), _hash(host, 0)
    for node in reversed(list(elements(root))):
        element = node.path ^ seed
        inner = [c.importance for c in node.children if isinstance(c, Node) and c.role >= 0 and c.tag not in SILENT and c.tag != "br"]
        inner += [1 - marks.get(rank[element, _hash(x, element)], (0.0, 1))[0] for x in features(node)]
        own, styles = marks.get(rank[element, 0], (0.0, 1))
        g = GAMMA ** (styles - 1)
        node.importance = min(1.0, (1 - g) * own + g * sum(inner) / len(inner)) if inner else 0.0


def _blocks(top: Node, weight: float) -> list[str]:
    """The blocks of a branch whose importance and weight are enough together."""
    blocks, run, stack = [], [], [top]

    def flush() -> None:
        if words := "".join(run).split():
            blocks.append(" ".join(words))
        run.clear()

    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif item.tag not in SILENT:
            ends = item.tag in BLOCK
            judged = ends and item.tag != "br" and item is not top
            if (item.importance if judged else 1.0) + (-1.0 if item.role < 0 else weight) < THRESHOLD:
                continue
            if ends:
                flush()
                stack.append(None)
            stack.extend(reversed(item.children))
    flush()
    return blocks


def main_text(root: Node) -> str:
    """The blocks of the article, or of the page where it has none."""
    tops, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.role > 0:
            tops.append(node)
        elif node.role == 0:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in SILENT)
    for branches, weight in ((tops, INSIDE), (tops, 1.0), ([root], 0.0)):
        if blocks := [b for top in branches for b in _blocks(top, weight)]:
            return "\n".join(blocks)
    return ""


def text_of(page: str, host: str, marks: dict[int, tuple[float, int]]) -> str:
    root = parse(page)
    compose(root, host, marks)
    return main_text(root)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The html, the last column, compressed."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([squeeze(x) for x in utf8(batch.column(batch.num_columns - 1))], pa.binary())], [str(k) for k in range(batch.num_columns)])


#: A mark in 64 bits: rank, styles (beyond 255 their part is nought), and importance or entropy in 65,535ths.
STYLES, PARTS = 255, 65_535


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of (id, url, packed html, marks)."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts = []
        for url, page, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            known = {x >> 24: ((x & 0xFFFF) / PARTS, x >> 16 & 0xFF) for x in marks or ()}
            texts.append(text_of(unpack(page).decode(), host_of(url), known))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])


def site_style_trees(seen: DataFrame) -> DataFrame:
    """(element, feature, styles, part): the presentation importance of elements (feature 0), and the entropy of content that more than one page has."""
    counts = materialise(seen.groupBy("element", "feature", "style").agg(F.count("*").cast("double").alias("n")))
    base = F.log(F.col("m") + UNSEEN)
    elements_ = materialise(counts.where("feature = 0").groupBy("element").agg(F.sum("n").alias("m"), F.count("*").alias("styles"), F.sum(F.col("n") * F.log("n")).alias("nlogn")))
    own = (F.log("m") - F.col("nlogn") / F.col("m")) / base
    content = counts.where("feature <> 0 and n > 1").join(elements_.select("element", "m"), "element")
    part = lambda x: F.round(F.greatest(x, F.lit(0.0)) * PARTS).cast("long").alias("part")
    styles = elements_.select("element", F.lit(0).cast("long").alias("feature"), F.least("styles", F.lit(STYLES)).cast("long").alias("styles"), part(own))
    return materialise(styles.unionByName(content.select("element", "feature", F.lit(1).cast("long").alias("styles"), part(F.log("n") / base))))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) for every page.

    One plan for all sizes: what pages show is counted with map-side sums, meets its importance in a join (adaptive skew joins split what a third of all pages
    show), and each page, compressed, meets its marks. Nothing is sent whole to the tasks or the driver.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    page = F.xxhash64("id", "url", "html").alias("page")
    seen = materialise(rows.select(page, "url", "html").mapInArrow(_features, SEEN))
    met = seen.select("page", "element", "feature", "rank").join(site_style_trees(seen), ["element", "feature"])
    mark = F.shiftleft(F.col("rank").cast("long"), 24) + F.shiftleft("styles", 16) + F.col("part")
    marks = met.groupBy("page").agg(F.collect_set(mark).alias("marks"))
    packed = rows.select(page, "id", "url", "html").mapInArrow(_pack, f"page long, id {kind}, url string, html binary")
    return packed.join(marks, "page", "left").select("id", "url", "html", "marks").mapInArrow(_extract, f"`{id_col}` {kind}, `{url_col}` string, text string")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    out = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
