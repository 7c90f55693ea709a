"""Queries against their SQL on rows that the smallest tables do not hold."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from compare import difference
from newsloom.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


def tables(folder, **changed: str) -> str:
    """The smallest tables, some of them replaced by a statement over themselves."""
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[:-8]
        if name in changed:
            duckdb.sql(f"COPY ({changed[name].format(f"'{path}'")}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        else:
            os.symlink(path, f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["candidates_union", "scan_doc_json", "scan_doc_json_counts"])
def test_answers_of_many_pages_stay_apart(spark, tmp_path, name):
    sf = tables(tmp_path, pages="SELECT * REPLACE (page_id + 49900 AS page_id) FROM {}")
    assert difference(spark, sf, name, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", ["normalize_candidates", "dedup_url", "sightings_merge"])
def test_titles_with_the_name_of_their_publisher(spark, tmp_path, name):
    site = "split_part(regexp_extract(url, '://([^/]*)', 1), '.', 1)"
    title = f"'<title>Some words about it' || CASE page_id % 4 WHEN 0 THEN ' | ' || {site} WHEN 1 THEN ' - ' || upper({site}) || ' - a slogan' WHEN 2 THEN repeat(' and on', 60) ELSE ' | other' END || '</title>'"
    sf = tables(tmp_path, pages=f"SELECT * REPLACE (regexp_replace(html, '(?s)<title>.*?</title>', {title}) AS html) FROM {{}}")
    assert difference(spark, sf, name, QUERIES[name], ORACLES[name]) is None


def test_upper_case_of_sharp_s_and_all_spam_terms(spark, tmp_path):
    head = "CASE doc_id % 3 WHEN 0 THEN 'Straße mit großem Maß' WHEN 1 THEN repeat('Ein Maß voll ', 22) || 'am Fluß' ELSE 'Satta matka and viagra for all' END"
    sf = tables(tmp_path, documents=f"SELECT * REPLACE ({head} || chr(10) || text AS text) FROM {{}}")
    assert difference(spark, sf, "quality_checks", QUERIES["quality_checks"], ORACLES["quality_checks"]) is None
