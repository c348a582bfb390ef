from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from splatlake.llm import decontaminate, quality_rules
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def brute_pipeline(spark, sf_dir):
    """The stages one by one on plain lists; the learnt verdict is the operator's own."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    kept = {r.doc_id for r in quality_rules.judge(read("documents"), read("labels"), ["doc_id"]).where("kept").collect()}
    docs = sorted((r.doc_id, r.text) for r in read("documents").collect() if r.doc_id in kept)
    docs = [(i, x[0]) for (i, _), x in zip(docs, brute.lines_kept([t for _, t in docs]), strict=True)]
    comp = brute.components([i for i, _ in docs], [brute.shingle_set(t) for _, t in docs], brute.alike)
    docs = [d for d, c in zip(docs, comp, strict=True) if d[0] == c]
    items = {r.item_id: r.text.lower().split() for r in read("benchmark").collect()}
    held = set()
    for i, t in docs:
        words = t.lower().split()
        windows = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for w in items.values():
            mine = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
            if mine and len(mine & windows) >= 0.8 * len(mine):
                held.add(i)
    return Counter((i, *brute.tokens(t)) for i, t in docs if i not in held)


def test_pipeline_equals_brute_force(spark):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == brute_pipeline(spark, SF)


def test_stages_keep_columns_and_take_awkward_tables(spark, tmp_path):
    assert len(corpus_pipeline.STAGES) == 5
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    for name, rows in (("empty", []), ("odd", [(1, None, None, None, None, None), (2, "", "", "", 0, ""), (3, "w " * 50, "en", "s", 100, "e"), (None, " ".join(map(str, range(40))), "en", "s", 5, "e"), (3, "w " * 50, "en", "s", 100, "e")])):
        folder = tmp_path / name
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(folder))
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        assert corpus_pipeline.run(spark, str(folder)).count() == (0 if name == "empty" else 1)


def test_decontamination_stage_is_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = decontaminate.drop_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("name", ["op3_line_dedup", "op10_decontamination"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from splatlake.llm import entries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(con.execute(f"select {', '.join(columns)} from ({entries.SQL[name]}) q").fetchall())


def test_held_out_accuracy(spark):
    from splatlake.llm import entries

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = entries.QUERIES["op1_quality_gam"](spark, sf).join(labels, "doc_id").where("held_out")
    assert scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9
