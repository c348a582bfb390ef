import os

import duckdb
import pytest

from splatlake.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "events")


def rounded(rows):
    return sorted(repr([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({SQL[name]}) q").fetchall()
    assert rounded(map(tuple, got.select(*columns).collect())) == rounded(want)
