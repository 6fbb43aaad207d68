"""Each query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from tidemark.plans.derived import with_sql
from tidemark.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 7) + 0.0
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    run = duck.execute(ORACLE[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in run.fetchall()), key=repr)
    assert got == want


def test_two_keys_against_insertion(spark, duck):
    """The only query without an oracle: rows go in one by one, those that break a key are ignored."""
    assert set(QUERIES) - set(ORACLE) == {"k2_first_by_two_keys"}
    hashes, urls, want = set(), set(), []
    for h, url, k in duck.execute(with_sql("select doc_id % 4000 h, canonical_url, doc_id from t_docs order by doc_id", "t_docs")).fetchall():
        if h not in hashes and url not in urls:
            want.append((k, h, url))
            hashes.add(h)
            urls.add(url)
    got = QUERIES["k2_first_by_two_keys"](spark, SF).collect()
    assert sorted((r.ord, r.hash, r.canonical_url) for r in got) == want


def test_first_links_takes_the_operators_default(spark, tmp_path):
    html = "".join(f'<a href="/x{k}">x</a>' for k in range(50))
    spark.createDataFrame([(1, "https://h.example/", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["win10_first_links"](spark, str(tmp_path)).count() == 40


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
