"""Operator 10: benchmark decontamination by templates, with DataFrame functions only.

Texts lose all but letters, marks, numbers and white space; words that begin with an upper-case letter become a name placeholder, words that
begin with a number a quantity placeholder, and units after a quantity a unit placeholder; the rest is lower-cased. Each text has a second form without
name placeholders, all lower-cased, so that capitals hide nothing. Windows of five words of either form are hashed. Where a document's windows, of both forms together, hold
at least 0.8 of an item's distinct windows of one form, the slots are checked: along each alignment (document position less item position) a slot value of the item must
stand for one value in the document in 0.8 of its occurrences. Alignments that fail do not count, and
the share of windows in the others must still reach 0.8. Verbatim and re-parameterised copies pass; look-alikes do not. Of the forms that pass, the one with the larger
share is reported, the first of equal ones.

Documents are searched for seeds: so many windows of an item that one at least is in every document that holds enough of them, those with the fewest placeholders and in the fewest
items. The rest is looked at in candidates only, and there only the windows of the items in question, so that windows of nothing but placeholders meet nothing.

Items of one to four words are found where a document holds them whole, word for word but for capitals. Items without words, as null and empty ones, are never found, and null and
empty texts hold nothing. Long texts are taken whole. Rows that agree in id and text are judged alike, null ids included; repeated windows count once, repeated items as one. Empty tables give empty
results. Extra columns may have any name. The items' windows are broadcast only up to ``MOST_BROADCAST`` rows, counted first; beyond that they are
joined by shuffle, and so are the candidate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

N = 5
SHARE = 0.8
MOST_BROADCAST = 1_000_000
WS = r"[\x20\x09-\x0D]"
NWS = r"[^\x20\x09-\x0D]"
UNITS = (
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg lb lbs pound pounds oz ounce ounces ton tons tonne tonnes ml l liter liters litre litres gallon gallons "
    "second seconds sec minute minutes min hour hours hr day days week weeks month months year years dollar dollars euro euros cent cents usd eur percent "
    "degree degrees mph kmh hz khz mhz ghz w kw mw v kb mb gb tb"
).split()
UNIT_PATTERN = f"(_q{WS}+)(?:{'|'.join(UNITS)})({WS}|$)"


def cleaned(text: Column) -> Column:
    """Letters, marks and numbers only, words one space apart."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", " " * 5)
    return F.btrim(F.regexp_replace(F.regexp_replace(spaced, r"[^\p{L}\p{M}\p{N} ]+", ""), " {2,}", " "))


def template(clean: Column) -> Column:
    """A cleaned text with placeholders; word for word as long as the text."""
    names = F.regexp_replace(clean, r"(^| )\p{Lu}[^ ]*", "$1_n")
    quantities = F.regexp_replace(names, r"(^| )\p{N}[^ ]*", "$1_q")
    return F.regexp_replace(F.lower(quantities), UNIT_PATTERN.replace(f"{WS}+", " ").replace(WS, " "), "$1_u$2")


def words(clean: Column) -> Column:
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def windows(tokens: Column, n: int = N) -> Column:
    """Hashes of all windows of ``n`` words, by position. ``tokens``: a plain column, as it is read again for each word."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)]))


FORMS = ("__named", "__lower")


def _prepared(rows: DataFrame, text_col: str) -> DataFrame:
    """With the words (__raw), and both forms of them."""
    clean = rows.withColumn("__clean", cleaned(F.col(text_col))).drop(text_col)
    split = {"__raw": words(F.col("__clean")), "__named": words(template(F.col("__clean"))), "__lower": words(template(F.lower("__clean")))}
    return clean.withColumns(split).drop("__clean")


def _hinted(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def _whole(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(id, check, item) for items of ``n`` words, fewer than five, that documents hold whole."""
    of = lambda rows: rows.withColumn("c", F.lower(cleaned(F.col("t")))).withColumn("w", words(F.col("c"))).drop("t", "c")
    short = materialise(of(items).where(F.size("w") == n).select("item", F.get(windows(F.col("w"), n), F.lit(0)).alias("h")).distinct())
    held = of(docs).select("id", "check", F.explode(F.array_distinct(windows(F.col("w"), n))).alias("h"))
    return held.join(_hinted(short, short.count()), "h").select("id", "check", "item").distinct()


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(id, check, item, n_windows, hits, n_slots, n_changed): the items that documents hold. check: xxhash64 of the text."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("check"), F.col(text_col).alias("t"))
    of_items = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("t"))
    forms = _prepared(of_items, "t").select("item", "__raw", F.posexplode(F.array(*FORMS)).alias("form", "__template"))
    part = lambda column, start: F.slice(column, start + 1, N)
    at = forms.select("item", "form", "__raw", "__template", F.posexplode(windows(F.col("__template"))).alias("i", "h"))
    at = materialise(at.select("item", "form", "i", "h", part("__raw", F.col("i")).alias("item_raw"), part("__template", F.col("i")).alias("item_template")))
    kinds = at.groupBy("item", "form", "h").agg(F.min(F.size(F.filter("item_template", lambda w: w.startswith("_")))).alias("slots"))
    spread = kinds.groupBy("h").agg(F.count("*").alias("holders"))
    sizes = kinds.groupBy("item", "form").agg(F.count("*").alias("n_windows"))
    need = F.ceil(F.col("n_windows") * F.lit(share) - F.lit(1e-9))
    known = materialise(kinds.join(spread, "h").join(sizes, ["item", "form"]))
    rank = F.row_number().over(Window.partitionBy("item", "form").orderBy("slots", "holders", "h"))  # an item's windows
    seeds = materialise(known.withColumn("rank", rank).where(F.col("rank") <= F.col("n_windows") - need + 1).select("h", "item", "form", "n_windows"))
    n, n_seeds = at.count(), seeds.count()

    both = F.array_distinct(F.concat(*[windows(F.col(x)) for x in FORMS]))
    found = _prepared(rows, "t").select("id", "check", F.explode(both).alias("h")).join(_hinted(seeds, n_seeds), "h")
    few = materialise(found.select(F.col("id").alias("c_id"), F.col("check").alias("c_check"), F.col("item").alias("c_item"), F.col("form").alias("c_form"), "n_windows").distinct())
    same = F.col("id").eqNullSafe(F.col("c_id")) & (F.col("check") == F.col("c_check"))
    n_few = few.count()
    texts = _prepared(rows.join(_hinted(few.select("c_id", "c_check").distinct(), n_few), same, "left_semi"), "t")
    here = texts.select("id", "check", "__raw", F.posexplode(F.arrays_zip(*[windows(F.col(x)).alias(f"h{k}") for k, x in enumerate(FORMS)])).alias("d", "z"))
    here = here.select("id", "check", "d", part("__raw", F.col("d")).alias("raw"), F.explode(F.array_distinct(F.array("z.h0", "z.h1"))).alias("h"))
    aligned = materialise(
        here.join(_hinted(few, n_few), same).select("id", "check", "d", "raw", "h", F.col("c_item").alias("item"), F.col("c_form").alias("form"), "n_windows")
        .join(_hinted(at, n), ["item", "form", "h"])
        .select("id", "check", "item", "form", "n_windows", (F.col("d") - F.col("i")).alias("shift"), "h", "raw", "item_raw", "item_template")
    )
    where = ["id", "check", "item", "form", "shift"]
    slots = aligned.select(*where, F.explode(F.arrays_zip("raw", "item_raw", "item_template")).alias("s")).where(F.col("s.item_template").startswith("_"))
    values = slots.groupBy(*where, F.lower("s.item_raw").alias("of"), F.lower("s.raw").alias("to")).agg(F.count("*").alias("times"))
    by_value = values.groupBy(*where, "of").agg(F.max("times").alias("most"), F.sum("times").alias("times"), F.max((F.col("of") != F.col("to")).cast("int")).alias("changed"))
    by_shift = materialise(by_value.groupBy(*where).agg((F.sum("most") >= F.lit(share) * F.sum("times")).alias("consistent"), F.count("*").alias("n_slots"), F.sum("changed").alias("n_changed")))
    at_shift = [F.col("id").eqNullSafe(F.col("s_id"))] + [F.col(c) == F.col(f"s_{c}") for c in where[1:]]
    checked = aligned.join(by_shift.select(*[F.col(c).alias(f"s_{c}") for c in where], "consistent", "n_slots", "n_changed"), at_shift, "left").where(F.coalesce("consistent", F.lit(True)))
    pairs = checked.groupBy("id", "check", "item", "form", "n_windows", "h").agg(F.max(F.coalesce("n_slots", F.lit(0))).alias("n_slots"), F.min(F.coalesce("n_changed", F.lit(0))).alias("n_changed"))
    held = pairs.groupBy("id", "check", "item", "form", "n_windows").agg(F.count("*").alias("hits"), F.max("n_slots").alias("n_slots"), F.max("n_changed").alias("n_changed")).where(F.col("hits") >= need)
    best = F.max_by(F.struct("n_windows", "hits", "n_slots", "n_changed"), F.struct(F.col("hits") / F.col("n_windows"), -F.col("form")))
    out = held.groupBy("id", "check", "item").agg(best.alias("b")).select("id", "check", "item", "b.*")

    length = F.size(words(cleaned(F.col("t"))))
    for k in sorted(r[0] for r in of_items.select(length.alias("n")).where(F.col("n").between(1, N - 1)).distinct().collect()):  # of 1 to 4
        one = F.lit(1).cast("long")
        out = out.unionByName(_whole(rows, of_items, k).select("id", "check", "item", one.alias("n_windows"), one.alias("hits"), F.lit(0).cast("long").alias("n_slots"), F.lit(0).cast("long").alias("n_changed")))
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    found = materialise(leaks(docs, items, id_col, text_col, share=share).select(F.col("id").alias("__id"), F.col("check").alias("__check")).distinct())
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(text_col, F.lit(""))) == F.col("__check")), "left_anti")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents that hold benchmark items."""
    found = leaks(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", "hits", (F.col("n_changed") > 0).alias("changed"))


OP10_SQL = rf"""
WITH raw AS (
  SELECT 0 AS kind, doc_id AS id, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT 1, item_id, coalesce(text, '') FROM benchmark
), clean AS (
  SELECT kind, id, trim(regexp_replace(t, '[^\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D]+', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS c FROM raw
), formed AS (
  SELECT kind, id, c, 0 AS form, c AS f FROM clean UNION ALL SELECT kind, id, c, 1, lower(c) FROM clean
), named AS (
  SELECT kind, id, c, form, regexp_replace(regexp_replace(f, '(^|{WS})\p{{Lu}}{NWS}*', '\1_n', 'g'), '(^|{WS})\p{{N}}{NWS}*', '\1_q', 'g') AS q FROM formed
), toks AS (
  SELECT kind, id, form, string_split_regex(c, '{WS}+') AS raw, string_split_regex(regexp_replace(lower(q), '{UNIT_PATTERN}', '\1_u\2', 'g'), '{WS}+') AS tpl FROM named WHERE c <> ''
), win AS (
  SELECT kind, id, form, i, raw[i:i + {N - 1}] AS raw, tpl[i:i + {N - 1}] AS tpl FROM (SELECT *, unnest(range(1, len(tpl) - {N - 2})) AS i FROM toks WHERE len(tpl) >= {N})
), iw AS (SELECT id AS item_id, form, i, raw, tpl FROM win WHERE kind = 1
), dw AS (SELECT DISTINCT id AS doc_id, i, raw, tpl FROM win WHERE kind = 0 AND tpl IN (SELECT tpl FROM iw)
), sizes AS (SELECT item_id, form, count(DISTINCT tpl) AS n_windows FROM iw GROUP BY 1, 2
), al AS (
  SELECT w.doc_id, iw.item_id, iw.form, w.i - iw.i AS shift, w.tpl, w.raw, iw.raw AS iraw FROM dw w JOIN iw ON w.tpl = iw.tpl
), slots AS (
  SELECT doc_id, item_id, form, shift, lower(unnest(iraw)) AS o, lower(unnest(raw)) AS d, unnest(tpl) AS s FROM al
), vals AS (SELECT doc_id, item_id, form, shift, o, d, count(*) AS n FROM slots WHERE starts_with(s, '_') GROUP BY ALL
), byval AS (SELECT doc_id, item_id, form, shift, o, max(n) AS most, sum(n) AS n, max((o <> d)::int) AS ch FROM vals GROUP BY ALL
), bys AS (SELECT doc_id, item_id, form, shift, sum(most) >= {SHARE} * sum(n) AS ok, sum(ch) AS ch FROM byval GROUP BY 1, 2, 3, 4
), good AS (
  SELECT al.doc_id, al.item_id, al.form, al.tpl, min(coalesce(bys.ch, 0)) AS ch FROM al LEFT JOIN bys USING (doc_id, item_id, form, shift) WHERE coalesce(bys.ok, true) GROUP BY ALL
), held AS (
  SELECT doc_id, item_id, form, n_windows, count(*) AS hits, max(ch) > 0 AS changed FROM good JOIN sizes USING (item_id, form)
  GROUP BY doc_id, item_id, form, n_windows HAVING count(*) >= ceil(n_windows * {SHARE} - 1e-9)
), short AS (
  SELECT id AS item_id, tpl AS w FROM (SELECT id, string_split_regex(lower(c), '{WS}+') AS tpl FROM clean WHERE kind = 1 AND c <> '') WHERE len(tpl) < {N}
), low AS (
  SELECT id AS doc_id, string_split_regex(lower(c), '{WS}+') AS w FROM clean WHERE kind = 0 AND c <> ''
), grams AS (
  SELECT DISTINCT doc_id, w[i:i + n - 1] AS w FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM low, (SELECT DISTINCT len(w) AS n FROM short) WHERE len(w) >= n)
)
SELECT doc_id, item_id, n_windows, hits, changed FROM held
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY hits / n_windows DESC, form) = 1
UNION ALL SELECT DISTINCT doc_id, item_id, 1, 1, false FROM grams JOIN short USING (w)
"""
