"""Every registered query against its DuckDB oracle: the library's own on the tables of sf0.01, the
others on the smallest ones."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from wordrate import plans

SF_OWN = "/root/testdata/sf0.01"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return "-0.0" if v == 0 and math.copysign(1, v) < 0 else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    open_ = {}

    def over(folder):
        if folder not in open_:
            con = open_[folder] = duckdb.connect()
            for t in TABLES:
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
        return open_[folder]
    return over


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    folder = SF_OWN if name in plans.QUERIES else sf_dir
    sdf = E.queries()[name](spark, folder)
    cols = sorted(sdf.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = duck(folder).sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    exp = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert got == exp


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_rows_only_queries_run(spark, sf_dir, name):
    assert E.queries()[name](spark, sf_dir).count() >= 1


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "weighted_sum" in df.columns
