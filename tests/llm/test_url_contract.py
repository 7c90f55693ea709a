"""The rules of op6_url_models, word by word as its contract lists them."""

from __future__ import annotations

from newsloom.llm.catalog import QUERIES

RULED = [
    ("https://a.org/x", "org/", "allow"), ("http://example.org/es/x", "example.org/es/", "block"), ("http://example.org/en/1", "example.org/en/1", "block"),
    ("http://sub.example.org/en/17?q#f", "example.org/en/1", "block"), ("http://example.org/en/2", "org/", "allow"), ("http://B.com/fr/y", "com/fr/", "allow"),
    ("http://com/de/", "com/de/", "block"),
]


def test_rules_of_the_contract(spark, tmp_path):
    spark.createDataFrame([(k, url) for k, (url, _, _) in enumerate(RULED)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(QUERIES["op6_url_models"](spark, str(tmp_path)).select("page_id", "rule", "verdict").collect())
    assert [tuple(r) for r in got] == [(k, rule, verdict) for k, (_, rule, verdict) in enumerate(RULED)]
