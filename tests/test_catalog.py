"""Catalogue queries against their SQL on the smallest tables."""

import os

import pytest

from compare import difference
from newsloom.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# The rest runs the same way with TEST_ALL=1.
QUICK = ["news_list", "page_keyset", "home_layout", "feed_sections", "sources_public", "run_outcomes_24h", "slot_gaps", "outbox_project", "canonical_url", "scan_doc_json", "quality_checks",
         "search_sort", "phrase_boost", "suggest_prefix", "index_terms_english", "retention_applied", "sink_articles", "article_copies", "scan_gkg_counts"]


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("TEST_ALL") else QUICK)
def test_matches_sql(spark, name):
    assert difference(spark, SF, name, QUERIES[name], ORACLES[name]) in (None, "both empty")
