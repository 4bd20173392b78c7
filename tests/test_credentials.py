"""Credentials go from the address of every page."""

import duckdb

from flowlake.functions import text as X
from flowlake.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_page_loses_credentials(spark):
    """A third of the pages got an address without any, so nothing was stripped from them."""
    urls = [r.url for r in QUERIES["f7_strip_url_credentials"](spark, SF).collect()]
    want = duckdb.sql(ORACLES["f7_strip_url_credentials"].replace("FROM pages", f"FROM '{SF}/pages.parquet'")).fetchall()
    assert len(urls) == len(want) > 0 and not any(u.split("://")[1].startswith(("@", "user:pw@")) for u in [*urls, *(u for _, u in want)])


def test_an_address_without_credentials_stays(spark):
    cases = [("https://@a/b", "https://@a/b"), ("https://u@a/b", "https://a/b"), ("https://a/b@c", "https://a/b@c")]
    df = spark.createDataFrame(cases, "url string, want string")
    assert [tuple(r) for r in df.select(X.strip_url_credentials(df.url), "want").collect() if r[0] != r[1]] == []
