"""Every operator on awkward tables and against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from splatlake.llm import bpe, decontaminate, html_extract, line_dedup, ppm, quality_gam, quality_rules, sharding, simhash_dedup, stats, substring_dedup
from splatlake.llm.common import connected_components
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, check string, n int, kept string, h string"
WORDS = "alpha beta gamma delta Epsilon zeta eta THETA iota kappa über ñandú é 42 x1 don't the of and".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(["", "", ".", ",", "\n"])) for _ in range(n))


def unlike(seed, n):
    """Words that no other seed has."""
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(n))


TEXTS = [
    None, "", " \t\n ", "one", "One  two", "a b c", prose(1, 400), prose(1, 400), prose(1, 400) + " end", prose(2, 60).upper(), "x " * 3000, unlike(3, 20000), "word " * 9, "\n\n\n",
    "tie tie\ntie tie", "日本語 テキスト　全角", "emoji 😀 \x1c \x85 \xa0 end", "<b>|&|</b> " * 20, "\r\nwindows\r\nlines\r\n", "A" * 5000, *(f"Shared Line\nown {k}\n  shared line \t\n" for k in range(12)),
]
ROWS = [(k, t, "en", "s", len(t or ""), -k, "k", "c", 1, "kept", "h") for k, t in enumerate(TEXTS)]
ROWS += [ROWS[6], ROWS[6], (None, None, None, None, None, None, None, None, None, None, None), (None, "no id here " * 20, "en", "s", 1, 1, "k", "c", 1, "k", "h")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, quality int, toxic int")


def test_sharding_is_a_reproducible_shuffle(docs, none):
    rows = sharding.assign_shards(docs, 5).collect()
    again = sharding.assign_shards(docs.repartition(7, "h"), 5).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert len(rows) == len(ROWS) and len({(r.shard, r.slot) for r in rows}) == len(rows)
    by = Counter(r.shard for r in rows)
    assert max(by.values()) - min(by.values()) <= 1
    for s, n in by.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert sharding.assign_shards(none).count() == 0
    assert {tuple(r) for r in sharding.assign_shards(docs, 5, seed=1).collect()} != set(map(tuple, rows))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_the_permutation_is_one(n):
    assert sorted(sharding.permute(np.arange(n), n, 9).tolist()) == list(range(n))


def test_the_permutation_equals_a_plain_feistel_network():
    def plain(x, n, seed):
        half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        while True:
            left, right = x >> half, x & (1 << half) - 1
            for r in range(sharding.ROUNDS):
                m = (right + ((seed + 1) * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03)) % 2**64
                m = (m ^ m >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                m = (m ^ m >> 27) * 0x94D049BB133111EB % 2**64
                left, right = right, left ^ ((m ^ m >> 31) & (1 << half) - 1)
            x = left << half | right
            if x < n:
                return x

    for n in (1, 2, 7, 100, 1025):
        assert sharding.permute(np.arange(n), n, 42).tolist() == [plain(x, n, 42) for x in range(n)]


def test_repeated_rows_fill_no_bucket(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 8)
    rows = spark.createDataFrame([(None, None)] * 100 + [(k, "t") for k in range(30)], "doc_id long, text string")
    got = sharding.assign_shards(rows, 7).collect()
    assert len(got) == 130 and sum(r.doc_id is None for r in got) == 100 and {(r.shard, r.slot) for r in got} == {(k % 7, k // 7) for k in range(130)}


def test_line_dedup(docs, none):
    want = Counter((i, *x) for (i, *_), x in zip(ROWS, brute.lines_kept([r[1] for r in ROWS], ids=[r[0] for r in ROWS]), strict=True))
    out = line_dedup.drop_common_lines(docs)
    assert out.columns == [*docs.columns, "__kept", "__n_lines", "__n_dropped", "__sha256"]
    rows = out.collect()
    assert Counter((r.doc_id, r["__kept"], r["__n_lines"], r["__n_dropped"]) for r in rows) == want
    assert all(hashlib.sha256(r["__kept"].encode()).hexdigest() == r["__sha256"] for r in rows)
    assert line_dedup.drop_common_lines(none).count() == 0
    again = docs.sparkSession.createDataFrame([(1, "one\ntwo")] * 12 + [(2, "two"), (None, "two"), (None, "two"), (None, "two\n")], "doc_id long, text string")
    assert {r["__n_dropped"] for r in line_dedup.drop_common_lines(again, min_docs=5).collect()} == {0}
    assert Counter((r.doc_id, r["__kept"]) for r in line_dedup.drop_common_lines(again, min_docs=4).collect()) == Counter([(1, "one")] * 12 + [(2, ""), (None, ""), (None, ""), (None, "")])
    assert line_dedup.drop_common_lines(docs, min_docs=1, min_chars=12).where("doc_id = 3").first()["__kept"] == "one"


def test_counts(docs, none):
    rows = stats.with_counts(docs, ["doc_id", "text"]).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.base_counts(r.text), repr(r.text)[:50]
    assert stats.with_counts(none, ["doc_id"]).count() == 0


def judged_documents(spark, n=300):
    """Junk has symbols or repeats; label by kind."""
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        rows.append((k, " ".join(w + "###" for w in prose(k, 60).split()) if bad and k % 8 else "again " * 60 if bad else unlike(k, 80)))
        labels.append((k, int(not bad), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), labels_of(spark, labels)


def test_quality_gam_learns(spark, docs, none):
    rows, labels = judged_documents(spark)
    got = {r.doc_id: r.score for r in quality_gam.score_documents(rows, labels).collect()}
    assert all((got[k] >= 0.7) == (k % 4 != 0) for k in got)
    edge = quality_gam.score_documents(docs, labels_of(spark, [(0, 1, 0), (1, 0, 0), (None, 1, 1), (5, None, 0), (6, 1, 0), (6, 0, 1)])).collect()
    assert len(edge) == len(ROWS) and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in edge)
    assert len({r.score for r in edge if r.doc_id == 6}) == 1
    assert {r.score for r in quality_gam.score_documents(docs, labels_of(spark, [])).collect()} == {0.5}
    assert quality_gam.score_documents(none, labels).count() == 0


def test_gam_tables_hold_an_interaction():
    r = np.random.default_rng(0)
    x = r.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    assert (0, 1) in [tuple(sorted(p[:2])) for p in model.pairs]


def test_scores_are_sums_of_table_entries(spark, docs):
    """Row by row: the intercept, a table entry for each feature's bin and one for each pair's cell."""
    rows, labels = judged_documents(spark)
    model = quality_gam.fit(*stats.training_sample(rows, labels, 1000))
    assert model.pairs
    bin_of = lambda edges, v: sum(1 for e in edges if e <= v)
    want = Counter()
    for doc, text, *_ in ROWS:
        c = dict(zip(stats.COUNTS, stats.counts((text or "").encode()), strict=True))
        x = [c[top] / (1 if bottom is None else max(c[bottom], 1)) for top, bottom in stats.RATIOS.values()]
        raw = model.intercept + sum(t[bin_of(e, v)] for e, t, v in zip(model.edges, model.tables, x, strict=True))
        raw += sum(t[bin_of(model.pair_edges[i], x[i]), bin_of(model.pair_edges[j], x[j])] for i, j, t in model.pairs)
        want[doc, round(1 / (1 + math.exp(-raw)), 9)] += 1
    got = docs.select("doc_id", "text").mapInArrow(quality_gam._score(model), "doc_id long, score double").collect()
    assert Counter((r.doc_id, round(r.score, 9)) for r in got) == want


def test_verdicts_follow_the_rules_row_by_row(spark, docs):
    rows, labels = judged_documents(spark)
    rules = quality_rules.learn(*stats.training_sample(rows, labels, 1000))
    assert rules
    for table, plain in ((docs, [r[:2] for r in ROWS]), (rows, [tuple(r) for r in rows.collect()])):
        want = Counter()
        for doc, text in plain:
            c = dict(zip(stats.COUNTS, stats.counts((text or "").encode()), strict=True))
            value = lambda f: c[stats.RATIOS[f][0]] / (1 if stats.RATIOS[f][1] is None else max(c[stats.RATIOS[f][1]], 1))
            failed = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
            rejected = any(all(value(x.feature) >= x.threshold if x.above else value(x.feature) <= x.threshold for x in rule) for rule in rules)
            want[doc, not failed and not rejected] += 1
        counted = stats.with_counts(table, ["doc_id"]).withColumn("kept", ~quality_rules.base_failed() & quality_rules.verdict(rules))
        assert Counter((r.doc_id, r.kept) for r in counted.collect()) == want


def test_quality_rules(spark, docs, none):
    rows, labels = judged_documents(spark)
    got = {r.doc_id: r.kept for r in quality_rules.judge(rows, labels, ["doc_id"]).collect()}
    assert all(got[k] == (k % 4 != 0) for k in got)
    kept = quality_rules.filter_documents(docs, labels_of(spark, []))
    assert kept.columns == docs.columns
    want = sum(1 for r in ROWS if (b := brute.base_counts(r[1]))[0] >= 10 and 100 * b[4] <= 20 * b[0])
    assert kept.count() == want
    assert quality_rules.filter_documents(none, labels).count() == 0


def test_rules_become_an_ordered_expression(spark):
    rules = [(quality_rules.Condition("symbols", True, 0.5),), (quality_rules.Condition("words", False, 3.0), quality_rules.Condition("adjacent", True, 0.5))]
    counted = stats.with_counts(spark.createDataFrame([(1, "a# b#"), (2, "a a"), (3, "a b")], "doc_id long, text string"), ["doc_id"])
    assert {r.doc_id: r.v for r in counted.select("doc_id", quality_rules.verdict(rules).alias("v")).collect()} == {1: False, 2: False, 3: True}
    assert str(rules[0][0]) == "symbols >= 0.5"
    assert quality_rules.learn(np.zeros((0, len(stats.RATIOS))), np.zeros(0)) == []


@pytest.mark.parametrize("bucket", [64, 1])
def test_simhash(docs, none, bucket):
    prints = [brute.fingerprint(r[1]) for r in ROWS]
    comp = brute.components([r[0] for r in ROWS], prints)
    want = Counter((r[0], p, c) for r, p, c in zip(ROWS, prints, comp, strict=True))
    got = simhash_dedup.near_duplicates(docs, max_bucket=bucket).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component) for r in got) == want
    assert simhash_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_are_complete(spark, bucket):
    """A cloud of fingerprints: pairs in small buckets and stars in large ones give the same components as all pairs."""
    r = np.random.default_rng(5)
    fps = set()
    for centre in r.integers(0, 2**64, 6, dtype=np.uint64):
        for _ in range(40):
            x = int(centre)
            for b in r.choice(64, r.integers(0, 4), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    edges = simhash_dedup.near_edges(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket).collect()
    assert all(((a ^ b) % 2**64).bit_count() <= (2 if bucket == 64 else 4) for a, b in edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict(zip(signed, brute.components(signed, fps), strict=True))
    assert {x: got.get(x, x) for x in signed} == want


@pytest.mark.parametrize("groups", [simhash_dedup.near_duplicates, simhash_dedup.similar_documents])
def test_keep_one(docs, none, groups):
    kept = simhash_dedup.keep_one(docs, groups=groups)
    ids, texts = [r[0] for r in ROWS], [r[1] for r in ROWS]
    if groups is simhash_dedup.near_duplicates:
        comp = brute.components(ids, [brute.fingerprint(t) for t in texts])
    else:
        comp = brute.components(ids, [brute.shingle_set(t) for t in texts], brute.alike)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({c for r, c in zip(ROWS, comp, strict=True) if r[0] == c and c is not None}) + Counter({None: 2})
    assert simhash_dedup.keep_one(none, groups=groups).count() == 0


def changed(words, places, mark):
    return " ".join(f"{mark}{k}" if k in places else w for k, w in enumerate(words))


@pytest.mark.parametrize("bucket", [32, 4])
def test_similar_documents_are_found(spark, bucket):
    """Pairs with words changed, crowds round one text, and pairs that a long common passage puts in one bucket, against brute force."""
    r = random.Random(7)
    texts = []
    for k in range(150):
        words = unlike(k, r.randint(60, 200)).split()
        texts += [" ".join(words), changed(words, r.sample(range(len(words)), r.randint(1, 5)), f"pair{k}_")]
    for k in range(3):
        words = unlike(1000 + k, 120).split()
        texts += [changed(words, r.sample(range(120), 2), f"crowd{k}_{j}_") for j in range(40)]
    shared = unlike(2000, 150)
    for k in range(30):
        own = unlike(3000 + k, 60).split()
        texts += [shared + " " + " ".join(own), shared + " " + changed(own, (3,), f"mixed{k}_")]
    sets = [brute.shingle_set(t) for t in texts]
    want = brute.components(list(range(len(texts))), sets, brute.alike)
    found = simhash_dedup.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), max_bucket=bucket)
    got = {x.doc_id: x.component for x in found.collect()}
    assert all(want[got[k]] == want[k] for k in got)  # nothing joined that brute force keeps apart
    linked = [k for k in range(len(texts)) if want[k] != k]
    kinds = {"pairs": range(300), "crowds": range(300, 420), "mixed": range(420, len(texts))}
    recall = {}
    for kind, span in kinds.items():
        mine = [k for k in linked if k in span]
        recall[kind] = sum(got[k] == want[k] for k in mine) / len(mine)
    print(f"similar documents, buckets of {bucket}: {recall} of {len(linked)}")
    assert recall["pairs"] >= 0.99 and recall["mixed"] >= 0.95
    assert recall["crowds"] >= 0.99 or bucket == 4  # a crowd whose texts are 0.7 alike and sometimes 0.8, beyond the bucket: the docstring's limit


@pytest.mark.parametrize("bucket", [1, 4])
def test_no_link_of_a_crowd_is_lost(spark, bucket):
    """A crowd beyond the bucket whose texts are nearly as similar as a link asks, and here and there so: the components are those of brute force."""
    r = random.Random(8)
    words = unlike(1000, 120).split()
    texts = [changed(words, r.sample(range(120), 2), f"crowd_{j}_") for j in range(40)] + ["", None, "two words", "Two  words", "three more words"]
    want = brute.components(list(range(len(texts))), [brute.shingle_set(t) for t in texts], brute.alike)
    found = simhash_dedup.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), max_bucket=bucket)
    assert {x.doc_id: x.component for x in found.collect()} == {k: want[k] for k in range(len(texts))}
    assert len({want[k] for k in range(40)}) < 40


def test_scratch_tables_can_be_dropped(spark, docs):
    import os

    from splatlake.llm.common import drop_scratch, materialise, shared_folder

    made = materialise(docs)
    assert made.count() == len(ROWS)
    folder = shared_folder(spark).removeprefix("file://")
    mine = f"splatlake-{spark.sparkContext.applicationId}-"
    os.makedirs(f"{folder}/splatlake-of-another-job")
    assert any(x.startswith(mine) for x in os.listdir(folder))
    drop_scratch(spark)
    assert not any(x.startswith(mine) for x in os.listdir(folder)) and os.path.isdir(f"{folder}/splatlake-of-another-job")
    os.rmdir(f"{folder}/splatlake-of-another-job")


def shuffle_files(spark):
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in f.getName()}


def test_a_written_table_leaves_no_shuffle_behind(spark, docs):
    import time

    from splatlake.llm.common import materialise

    before = shuffle_files(spark)
    made = materialise(docs.groupBy("text").count())
    until = time.time() + 10
    while (more := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not more and made.count()


@pytest.mark.parametrize(("search", "left"), [(simhash_dedup.similar_documents, 1), (simhash_dedup.keep_one, 2), (substring_dedup.repeated_passages, 2)])
def test_searches_leave_no_scratch_behind(spark, docs, search, left):
    import os

    from splatlake.llm.common import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    found = search(docs)
    assert len(set(os.listdir(folder)) - before) == left
    found.count()


def test_components_of_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(path + star + [(5, 5)], "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {1000 + k: 1000 for k in range(1, 300)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe_equals_tiktoken_and_round_trips(docs, none):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    got = bpe.token_digests(docs, path, P.PATTERN).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *brute.tokens(r[1])) for r in ROWS)
    ids = bpe.encode_texts(docs, path, P.PATTERN)
    back = bpe.decode_ids(ids, path, P.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back) == Counter((r[0], (r[1] or "").encode()) for r in ROWS)
    assert bpe.token_digests(none, path, P.PATTERN).count() == 0


def test_bpe_on_random_characters():
    import public_tokenizers as P

    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    r = random.Random(4)
    alphabet = [chr(c) for c in [*range(0x250), 0x200B, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x301, 0x660, 0x2167]]
    for _ in range(2000):
        text = "".join(r.choices(alphabet, k=r.randint(0, 40)))
        packed = codec.encode(text)
        assert list(memoryview(packed).cast("I")) == brute.TIKTOKEN.encode_ordinary(text) and codec.decode(packed) == text.encode()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-banner">We use cookies</div><div class=ad>Buy!</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>
 text<p>Second&nbsp;part<br>third</p><div class="share">Tweet</div><form><input name=q>Find</form><ul><li>one<li>two</ul></article>
<section id="comments"><article><p>Nice post</p></article></section><aside>Related</aside><footer>&copy; me</footer></body></html>"""


PAGES = "page_id long, url string, html string"


def extracted(spark, rows):
    return {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}


def test_html_by_role(spark):
    want = "Title & more\nFirst bold text\nSecond part\nthird\none\ntwo"
    rows = [(1, "http://a/x", PAGE), (1, "http://a/x", PAGE), (2, None, None), (3, "", ""), (None, "http://[bad", "<p>hi"), (5, "http://b/", "<p>a<p>b<nav>x"), (6, "http://c/", "plain &lt;text")]
    rows += [(8, "http://d/", '<div class="post has-sidebar"><p>All of the story.</p></div>'), (9, "http://e/", "<article><p>Let <math><mi>x</mi></math> be</p><svg><text>no</text></svg></article>"),
             (10, "http://f/", '<div class="my-cookie-banner">c</div><div class="entry-header">head</div><div id="comments">c</div>'), (11, "http://g/", "<main><p>before</p><article><p>in</p></article></main><p>out</p>"), (12, "http://i/", "<article></article><p>text</p>")]
    wide = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], PAGES + ", id string, page string, marks int")
    found = html_extract.extract_main_text(wide)
    assert found.columns == ["page_id", "url", "text"]
    want = [(1, "http://a/x", want)] * 2 + [(2, None, ""), (3, "", ""), (None, "http://[bad", "hi"), (5, "http://b/", "a\nb"), (6, "http://c/", "plain <text"), (8, "http://d/", "All of the story."),
            (9, "http://e/", "Let x be"), (10, "http://f/", "head"), (11, "http://g/", "before\nin"), (12, "http://i/", "text")]
    assert Counter((r.page_id, r.url, r.text) for r in found.collect()) == Counter(want)
    assert html_extract.extract_main_text(wide.limit(0)).count() == 0


def test_deep_and_broken_markup_takes_time_in_proportion(spark):
    import time

    n = 100_000
    pages = ["<div>" * n + "deep", "<b>" * n + "deep" + "</i>" * n + "<p>" * n, "<ul><li><ul>" + "<b>" * n + "<li>" * 3 + "deep" + "</p>" * n, "deep" + "<x" * n]
    began = time.time()
    got = extracted(spark, [(k, "http://h/", p) for k, p in enumerate(pages)])
    assert got[0] == got[1] == got[2] == "deep" and got[3].startswith("deep") and time.time() - began < 60


def test_site_style_tree_finds_what_all_pages_share(spark):
    """Pages without any role: what repeats on each page of the host goes, what differs stays; two pages of another host stay whole."""
    page = lambda k: f"<body><div class=top><p>Welcome to our site</p></div><div class=x><p>{unlike(k, 12)}</p></div><div class=z><p>All rights reserved 20{k:02}</p></div></body>"
    got = extracted(spark, [(k, f"http://h/{k}", page(k)) for k in range(20)] + [(100 + k, f"http://few/{k}", page(0)) for k in range(2)])
    assert all(got[k] == unlike(k, 12) for k in range(20))
    assert all(len(got[100 + k].split("\n")) == 3 for k in range(2))


def test_importance_decides_inside_articles_too(spark):
    """A block without any role that all articles of a host hold goes; what half of them hold stays; where all would go, all stays."""
    page = lambda k: f"<article><h1>{unlike(k, 4)}</h1><p>{unlike(100 + k, 20)}</p>{'<p>Only half</p>' if k % 2 else ''}<div><p>Read more of this every day</p></div></article>"
    rows = [(k, f"http://h/{k}", page(k)) for k in range(40)] + [(100 + k, f"http://same/{k}", "<article><p>same text</p><p>and more</p></article>") for k in range(30)]
    got = extracted(spark, rows)
    for k in range(40):
        assert got[k] == "\n".join([unlike(k, 4), unlike(100 + k, 20), *(["Only half"] if k % 2 else [])])
    assert {got[100 + k] for k in range(30)} == {"same text\nand more"}


def test_forced_importances_change_texts():
    page = "<article><h1>head</h1><p>one</p><p class=x>two</p></article>"
    rank = html_extract.marked(html_extract.parse(page), "h")
    assert html_extract.text_of(page, "h", {}) == "head\none\ntwo"
    for (element, feature), k in rank.items():
        if feature:
            gone = {html_extract._hash(x, element): x for x in ("head", "one", "two")}[feature]
            assert html_extract.text_of(page, "h", {k: (1.0, 1)}) == "\n".join(x for x in ("head", "one", "two") if x != gone)


def test_html_against_brute_force(spark):
    r = random.Random(5)
    shared = [unlike(900 + k, 5) for k in range(4)]

    def page(k, article):
        blocks = [f"<p>{unlike(k * 50 + j, 8)}</p>" if r.random() < 0.7 else f"<div><p>{r.choice(shared)}</p></div>" for j in range(r.randint(1, 6))]
        blocks += [f"<section><p>{shared[0]}</p></section>"] * (r.random() < 0.9) + [f'<div class="ad">{unlike(k + 7, 3)}</div>', f"<h2>{r.choice(shared)} {k}</h2>"]
        r.shuffle(blocks)
        inner = "".join(blocks)
        return f"<body><nav>menu</nav><div>{shared[1]}</div>{f'<article>{inner}</article>' if article else inner}<footer>end</footer></body>"

    rows = [(k, f"http://h{k % 3}/{k}", page(k, k % 3 < 2)) for k in range(90)]
    want = brute.site_texts([x[1:] for x in rows])
    got = extracted(spark, rows)
    assert [got[k] for k in range(90)] == want
    assert any(shared[0] not in w for w in want) and any(shared[0] in w for w in want)


def test_compact_windows_cover_every_passage():
    r = np.random.default_rng(2)
    for values in (r.integers(0, 2**63, 200, dtype=np.uint64), np.zeros(150, np.uint64), r.integers(0, 5, 120, dtype=np.uint64)):
        windows = list(zip(*(x.tolist() for x in substring_dedup.compact_windows(values, np.array([len(values)]), 20)), strict=True))
        for k in range(len(values) - 19):
            assert [values[c] for first, c, last in windows if first <= k <= c < k + 20 <= last + 1] == [values[k : k + 20].min()]


def test_substrings(spark, docs, none):
    passage, other = unlike(900, 60), unlike(901, 80)
    edited = other.split()
    edited[40] = "changed"
    texts = [unlike(k, 50) + " " + passage + " " + unlike(100 + k, 30) for k in range(40)] + [unlike(200, 30) + " " + other, " ".join(edited) + " " + unlike(201, 70), unlike(300, 500), unlike(301, 49)]
    texts += [texts[-2], texts[-1]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(rows).collect()}
    assert set(got) == {*range(42), 42, 44}
    assert all([tuple(s) for s in got[k].spans] == [(50, 109)] for k in range(40))
    assert [tuple(s) for s in got[40].spans] == [(30, 109)] and [tuple(s) for s in got[41].spans] == [(0, 79)]
    assert [tuple(s) for s in got[42].spans] == [(0, 499)] and got[44].partner == 42 and got[41].partner == 40
    edge = {r.doc_id for r in substring_dedup.repeated_passages(docs).collect()}
    assert {6, 7, 8} <= edge and not edge & {0, 1, 2, 3, 11, 19}
    assert substring_dedup.repeated_passages(none).count() == 0


def test_rolling_hashes_tell_stretches_apart():
    base = np.random.default_rng(3).integers(0, 3, 300).astype(np.uint64)
    for width in (1, 2, 12, 46, 300, 301):
        want = [tuple(base[k : k + width]) for k in range(len(base) - width + 1)]
        got = substring_dedup._rolling(base, width).tolist()
        assert len(got) == len(want) and len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def near_passages(texts, least=50):
    """Documents that hold a passage of ``least`` words whose shingles have a Jaccard similarity of 0.8 to one of another text, by looking at all pairs of passages."""
    split = [(t or "").translate(brute.LOWER).split() for t in texts]
    cuts = [{frozenset(tuple(w[k : k + 5]) for k in range(s, s + least - 4)) for s in range(len(w) - least + 1)} for w in split]
    found = set()
    for a in range(len(texts)):
        for b in range(a):
            if split[a] != split[b] and any(len(x & y) >= 0.8 * len(x | y) for x in cuts[a] for y in cuts[b]):
                found |= {a, b}
    return found


def spoilt(text, k, r):
    words = text.split()
    for i in r.sample(range(len(words)), k):
        words[i] = "".join(r.choices("qrstuvwxyz", k=6))
    return " ".join(words)


@pytest.mark.parametrize(("own", "others"), [(25, 20), (10, 20), (10, 40)])
def test_exact_passages_are_found_round_a_common_line(spark, own, others):
    """Pairs share 50 words, of which all but ``own`` are a line of many other texts: every pair is found, and nothing else."""
    texts, want = [], {}
    for k in range(12):
        line = unlike(10_000 + k, 50 - own)
        texts += [f"{unlike(20_000 + 100 * k + j, 20)} {line} {unlike(30_000 + 100 * k + j, 20)}" for j in range(others)]
        passage = f"{unlike(40_000 + k, own // 2)} {line} {unlike(50_000 + k, own - own // 2)}"
        want |= {len(texts) + j: ([(60, 109)], len(texts) + 1 - j) for j in (0, 1)}
        texts += [f"{unlike(60_000 + 10 * k + j, 60)} {passage} {unlike(70_000 + 10 * k + j, 60)}" for j in (0, 1)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: ([tuple(s) for s in r.spans], r.partner) for r in substring_dedup.repeated_passages(rows).collect()}
    assert got == want


@pytest.mark.parametrize("all_pairs", [4, substring_dedup.ALL_PAIRS])
def test_near_passages_against_brute_force(spark, all_pairs):
    """Of documents with a passage similar to another's at least 0.9 are found, in pairs and in crowds; what is found is similar."""
    r = random.Random(3)
    texts = []
    for k in range(12):
        passage = unlike(2000 + k, 50 + k)
        texts += [f"{unlike(3000 + k, 20)} {passage} {unlike(4000 + k, 20)}", f"{unlike(5000 + k, 9)} {spoilt(passage, 1, r)} {unlike(6000 + k, 30)}"]
    for k in range(2):
        passage = unlike(7000 + k, 60)
        texts += [f"{unlike(7100 + 50 * k + j, 10)} {spoilt(passage, 1, r)} {unlike(7500 + 50 * k + j, 10)}" for j in range(15)]
    want = near_passages(texts)
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), all_pairs=all_pairs).collect()}
    recall = len(want & set(got)) / len(want)
    print(f"recall of near passages: {recall:.3f} of {len(want)}")
    assert recall >= 0.9
    for row in got.values():
        assert all(b - a >= 49 for a, b in row.spans)


def test_no_near_passage_of_a_crowd_is_lost(spark):
    """Texts of ten crowds all change one word of a passage of 60: each one that is similar to another is found, whatever the group's shortest text holds."""
    r = random.Random(5)
    texts, want = [], set()
    for k in range(10):
        passage = unlike(110_000 + k, 60)
        crowd = [f"{unlike(120_000 + 100 * k + j, 10)} {spoilt(passage, 1, r)} {unlike(130_000 + 100 * k + j, 10)}" for j in range(40)]
        split = [t.split() for t in crowd]
        cuts = [[{tuple(w[i : i + 5]) for i in range(s, s + 46)} for s in range(len(w) - 49)] for w in split]
        want |= {len(texts) + a for a in range(40) if any(a != b and any(len(x & y) >= 0.8 * len(x | y) for x, y in zip(cuts[a], cuts[b], strict=True)) for b in range(40))}
        texts += crowd
    got = substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == want


def test_alike_surroundings_against_brute_force():
    """Each pair of places round which a passage can lie comes once, whatever the shingles that both share."""
    r, least = np.random.default_rng(4), 6
    reach = 2 * least - 2

    def can_hold(own, c, others):
        return any(
            p <= c < q and 5 * len(set(own[p:q]) - set(others)) <= len(set(own[p:q]))
            for p in range(max(0, c - reach), c + 1) for q in range(p + least, min(len(own), c + reach + 1) + 1)
        )

    texts = [r.integers(0, k % 7 + 2, r.integers(least, 30)).tolist() for k in range(40)] + [(np.arange(20) + k).tolist() for k in range(8)]
    places = [int(r.integers(0, len(t))) for t in texts]
    near = [t[max(0, c - reach) : c + reach + 1] for t, c in zip(texts, places, strict=True)]
    flat = lambda k: (np.array(sum(near[k], []), np.int64), np.array([len(x) for x in near[k]]), np.minimum(places[k], reach))
    one, two = slice(0, None, 2), slice(1, None, 2)
    got = list(zip(*(x.tolist() for x in substring_dedup.alike(*flat(one), *flat(two), least)), strict=True))
    sides = [list(zip(texts[k], places[k], near[k], strict=True)) for k in (one, two)]
    want = {(i, j) for i, (a, ca, na) in enumerate(sides[0]) for j, (b, cb, nb) in enumerate(sides[1]) if can_hold(a, ca, nb) and can_hold(b, cb, na)}
    assert want and want <= set(got) and len(set(got)) == len(got) < len(sides[0]) * len(sides[1])


def crowd_tile(texts, places):
    """One tile in which each of ``texts`` asks and is asked, at ``places``."""
    bases = [substring_dedup.shingles(t.encode()).view(np.int64) for t in texts]
    rows = [(7, 0, 0, asks, k, c, bases[k][max(0, c - 90) : c + 91].astype(np.int32)) for asks in (True, False) for k, c in enumerate(places)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
    names = ["middle", "across", "down", "query", "check", "centre", "shingles"]
    return bases, pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def test_a_crowd_gives_pairs_in_proportion():
    """Of 80 similar texts each is paired with few others, and none is left alone."""
    r = random.Random(8)
    passage = unlike(140_000, 60)
    texts = [f"{unlike(141_000 + k, 10)} {' '.join([*spoilt(passage, 0, r).split()[:57], f'own{k}', *passage.split()[58:]])} {unlike(142_000 + k, 10)}" for k in range(80)]
    _, batch = crowd_tile(texts, [20] * 80)
    for batches in ([batch], [batch.slice(0, 50), batch.slice(50)]):
        pairs = [p for b in substring_dedup._alike(50)(iter(batches)) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert {x for p in pairs for x in p} == set(range(80)) and len(pairs) <= 3 * 80


def test_the_joint_bound_loses_no_passage():
    """Whatever passage lies round two places, their surroundings pass the bound for both texts together."""
    r = random.Random(9)
    texts = []
    for k in range(60):
        passage = unlike(150_000 + k % 6, 70)
        edited = spoilt(passage, r.randrange(4), r).split()
        at = r.randrange(40, 60)
        edited[at:at] = unlike(151_000 + k, r.choice([0, 0, 1, 3, 30])).split()
        edited = edited * r.choice([1, 1, 3])
        texts.append(" ".join(edited))
    bases = [substring_dedup.shingles(t.encode()) for t in texts]
    places = [(k, int(np.flatnonzero(b == bases[k % 6][30])[0])) for k, b in enumerate(bases) if (b == bases[k % 6][30]).any()]
    near = {k: bases[k][max(0, c - 90) : c + 91] for k, c in places}
    small = {k: (v & np.uint64(0xFFFFFFFF)).astype(np.int64) for k, v in near.items()}
    lists = np.concatenate(list(small.values())), np.array([len(v) for v in small.values()]), np.array([min(c, 90) for _, c in places])
    passed = {(places[i][0], places[j][0]) for i, some, _ in substring_dedup._alike_each(*lists, *lists, 46, jaccard=True) for j in some}
    at = dict(places)
    want = {(a, b) for a in near for b in near if any(x[2] - x[1] - 3 < 91 for x in substring_dedup.passages(near[a], near[b], [(min(at[a], 90), min(at[b], 90))], 50))}
    print(len(want), len(passed))
    assert len(want) > 50 and want <= passed < {(a, b) for a in near for b in near}


def test_shingles_of_many_texts_are_those_of_each():
    texts = [(t or "").encode() for t in TEXTS] + [b"a " * 300_000 + b"z" * 400_000 + b" tail of five more words", b"y" * 300_000]
    values, counts = substring_dedup.shingles_of(texts)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        words = text.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
        want = list(zip(*(words[k:] for k in range(5)), strict=False))
        assert len(want) == b - a and len(set(zip(want, values[a:b].tolist(), strict=True))) == len(set(want)) == len(set(values[a:b].tolist()))
        assert (substring_dedup.shingles(text) == values[a:b]).all()


def test_anchors_grow_in_proportion(spark):
    assert len(list(substring_dedup.anchors_of(list(range(500)), list(range(900))))) == 2700
    rows = spark.createDataFrame([(1, "w " * 12_000), (2, "w " * 12_000 + "end"), (3, unlike(1, 60) + " w" * 12_000)], "doc_id long, text string")
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in substring_dedup.repeated_passages(rows).collect()}.keys() == {1, 2, 3}


@pytest.mark.parametrize(("frequent", "nodes"), [(100_000, 2_000_000), (3, 500), (0, 0)])
def test_ppm(docs, frequent, nodes):
    """All texts, the long ones too, whatever goes to the tasks and whatever is joined."""
    got = ppm.score_documents(docs.where("doc_id is not null"), frequent=frequent, frequent_nodes=nodes).collect()
    rows = [(i, (t or "").translate(brute.LOWER)) for i, t, *_ in ROWS if i is not None]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for t in train for w in [*brute.WORD.findall(t), "\n"])
    n, v = sum(count.values()), len(count)
    base, model = {}, dict(zip((t for _, t in rows), brute.ppm([t.encode() for t in train], [t.encode() for _, t in rows]), strict=True))
    for _, t in rows:
        words = [*brute.WORD.findall(t), "\n"]
        base[t] = (len(words), sum(count[w] > 0 for w in words), sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
    texts = {i: t for i, t in rows}
    for r in got:
        assert r.doc_id in texts and r.train_tokens == n
        want = base[texts[r.doc_id]]
        assert (r.n_tokens, r.n_known) == want[:2] and abs(r.base_score - want[2]) < 1e-6 * max(1, -want[2])
        assert abs(r.score - model[texts[r.doc_id]]) < 1e-5 * max(1, -r.score)
    assert len(got) == len(rows)


def test_ppm_edges(docs, none, spark):
    assert ppm.score_documents(none).count() == 0
    alone = spark.createDataFrame([(k, t) for k, t in [(None, "abc"), (None, None)]], "doc_id long, text string")
    rows = {r.n_tokens: r for r in ppm.score_documents(alone).collect()}
    assert rows[2].train_tokens == 0 and abs(rows[2].score + 4 * math.log10(256)) < 1e-9 and rows[1].n_known == 0
    assert ppm.score_documents(docs.where("doc_id is null")).count() == 2


ITEM = "Alice has 3 red apples and Bob has 5 green pears while Alice gives 2 km of rope to Bob in March"


def test_decontamination(spark, docs, none):
    """Against brute force: verbatim, changed, inconsistent, in capitals, cut, and short items. Two stray names of the mixed copy leave 0.8 of its slots consistent."""
    changed = "Carol has 7 red apples and Dave has 9 green pears while Carol gives 4 miles of rope to Dave in June"
    mixed = "Carol has 7 red apples and Dave has 9 green pears while Eve gives 4 miles of rope to Frank in June"
    texts = [f"{unlike(1, 30)} {ITEM} {unlike(2, 30)}", f"{unlike(3, 9)}\n{changed}", mixed, unlike(4, 200), " ".join(ITEM.split()[:10]), None, "", ITEM.replace(" ", "\n"), ITEM.upper(), f"x {ITEM.lower()}",
             "A far Too, short   ITEM here", "too item short", changed.upper(), "One Two Three Four Five Six Seven", unlike(77, 20), " ".join(f"Name{k}" for k in range(40))]
    rows = [*enumerate(texts), (0, texts[0]), (None, ITEM)]
    pairs = [(1, ITEM), (2, unlike(77, 20)), (3, "too short item"), (4, None), (5, "Xx Yy Zz Ww Vv Uu and Tt"), (6, "one"), (7, "")]
    wide = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "doc_id long, text string, h long, item string, form int")
    items = spark.createDataFrame(pairs, "item_id long, text string")
    want = {(d, i, *found) for d, t in rows for i, x in pairs if (found := brute.leak(t, x))}
    got = decontaminate.leaks(wide, items).collect()
    assert {(r.id, r.item, r.n_windows, r.hits, r.n_changed > 0) for r in got} == want
    assert {(d, i) for d, i, *_ in want} == {(0, 1), (1, 1), (2, 1), (7, 1), (8, 1), (9, 1), (None, 1), (10, 3), (13, 6), (14, 2)}
    held = {d for d, *_ in want}
    left = decontaminate.drop_leaks(wide, items)
    assert left.columns == wide.columns and Counter(r.doc_id for r in left.collect()) == Counter(d for d, _ in rows if d not in held)
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(wide, items.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs, items).columns == docs.columns


def test_slots_must_be_consistent(spark):
    item = "Ann sees Ann and Ann hears Ann then Ann calls Ann before Ann meets Ann"
    good, bad = item.replace("Ann", "Zoe"), item
    for name in "Bob Cid Dan Eva Fay Gus Hal Ida".split():
        bad = bad.replace("Ann", name, 1)
    rows = spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")
    assert {r.id for r in decontaminate.leaks(rows, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()} == {1}


def test_decontamination_is_native(spark, docs):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    plan = decontaminate.leaks(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
