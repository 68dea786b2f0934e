import duckdb
import pytest

import __spark_entry__
from shelfmark.plans.queries import QUERIES, SQL
from tests.conftest import DATA, plain


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(agree, name):
    agree(QUERIES[name], SQL[name])


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bucket_fingerprint_ignores_order(spark):
    from shelfmark.operators import changes

    rows = spark.read.parquet(f"{DATA}/orders.parquet")
    one = changes.fingerprint_in_buckets(rows, "o_orderkey", "o_custkey").first()
    two = changes.fingerprint_in_buckets(rows.orderBy("o_totalprice").repartition(3), "o_orderkey", "o_custkey").first()
    less = changes.fingerprint_in_buckets(rows.filter("o_orderkey > 0"), "o_orderkey", "o_custkey").first()
    assert one == two != less


def agree_on(rows, table, name, folder):
    """Asserts that a query and its SQL return the same rows of one small table; returns them."""
    rows.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    told = sorted([plain(r[n]) for n in names] for r in QUERIES[name](rows.sparkSession, str(folder)).collect())
    assert told == sorted(list(map(plain, r)) for r in found.fetchall())
    return told


def test_labels_of_cut_titles_agree_with_sql(spark, tmp_path):
    page = '<html><body><nav><ul><li><a href="/a">{0}</a></li><li><a href="/b&amp;c">b</a></li></ul></nav><article><h1>{1}</h1></article></body></html>'
    titles = [("a", "One &amp;&amp"), ("a", "Two &quot;&quot"), ("a", "&lt &gt &am &"), ("a&amp;", "a&amp;"), ("Rech.", "Rech."), ("&amp;amp", "&amp;lt;")]
    pages = spark.createDataFrame([(i, f"https://x.org/{i}", page.format(*t)) for i, t in enumerate(titles)], "page_id long, url string, html string")
    told = agree_on(pages, "pages", "link_candidates", tmp_path)
    assert len(told) == 12 and ["0", "/a.pdf", "a|One &&amp", "1"] in told and ["4", "/a.pdf", "Rech.|Rech.", "1"] in told


def test_years_after_an_encoded_space_agree_with_sql(spark, tmp_path):
    keys = [(1, 1949, "2000-01-01"), (2, 1949, "1995-01-01"), (3, 19491960, "2000-01-01"), (4, 401996, "2001-05-05"), (194900, 7, "1999-12-31"), (5, 20, "1998-03-04"), (6, 1, None)]
    orders = spark.createDataFrame(keys, "o_orderkey long, o_custkey long, day string").selectExpr("o_orderkey", "o_custkey", "timestamp(day) AS o_orderdate")
    told = agree_on(orders, "orders", "year_guess", tmp_path)
    assert dict(told) == {"1": "", "2": "1995", "3": "1960", "4": "1996", "194900": "1949", "5": "", "6": ""}
