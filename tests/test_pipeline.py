"""Curation end to end: a ferry strike read in batches, replayed, streamed, and judged again under other rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions.rules import RelevanceConfig, Rule
from newsloom.plans import news, pipeline, stats
from newsloom.plans.pipeline import Setup, State, apply_rows
from newsloom.streaming import ingest

NOW = dt.datetime(2025, 3, 9, 18, tzinfo=dt.timezone.utc)
AT = "2025-03-09 18:00:00"
STRIKE = "Ferry crews on the northern line vote to strike over winter rosters"


def setup_of(spark, ferry_weight=55.0):
    rules = [
        Rule("ferry", "phrase", "ferry crews", ferry_weight, ("title",)),
        Rule("union", "regex", r"\bunion\b", 60.0),
        Rule("sport", "phrase", "regatta", -70.0, ("title", "url")),
    ]
    cats = [(4, "labour", "Labour", 10, True, True, 1.0), (9, "general", "General", 200, False, True, 1.0)]
    words = [(1, 4, "phrase", "strike", ["title"], 1.0, True)]
    return Setup(
        rules, {7: 20.0, 8: 25.0}, RelevanceConfig(50.0, 30.0, r"\bferry\b"),
        spark.createDataFrame(cats, schemas.CATEGORY), spark.createDataFrame(words, schemas.CATEGORY_RULE),
    )


def item(arrival, title=STRIKE, url=None, hours=5, **more):
    when = (NOW - dt.timedelta(hours=hours)).strftime("%Y%m%dT%H%M%SZ")
    row = {"provider": "gdelt-doc", "url": url or f"https://paper{arrival}.example.net/items/{arrival}", "title": title, "published_at": when,
           "language": "English", "source_country": "Iceland", "niche_id": 3, "run_id": 2, "arrival": arrival}
    return [{**row, **more}.get(n) for n in schemas.CANDIDATE.names]


BATCHES = [
    # A representative, its equal headline elsewhere, its near headline that also names the union, and a race report.
    [item(1), item(2, url="https://tribune.example.net/a"), item(3, STRIKE + " says union", url="https://gazette.example.net/b"),
     item(4, "Ferry crews cheer as the regatta reaches the harbour at dusk", url="https://gazette.example.net/regatta")],
    # The first address again with a tracking parameter, an unusable address, and a late article, older than all others.
    [item(5, url="https://paper1.example.net/items/1?utm_campaign=q"), item(6, url="mailto:x"), item(7, "Ferry crews return to work after a quiet night in port", hours=70)],
]


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.CANDIDATE)


def now():
    return F.lit(AT).cast("timestamp")


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("curated"))
    run = ingest.store_batch(path, setup_of(spark), now())
    for n, rows in enumerate(BATCHES):
        run(frame(spark, rows), n)
    run(frame(spark, BATCHES[0]), 0)  # replayed after a later batch
    return path


def view(articles):
    return {r.id: (r.status, r.duplicate_of_id) for r in articles.collect()}


def test_batches_and_replay(spark, root):
    state = ingest.read_state(spark, root)
    assert view(state.articles) == {1: ("accepted", None), 2: ("duplicate", 1), 3: ("duplicate", 1), 4: ("rejected", None), 7: ("accepted", None)}
    assert {r.status: r.n for r in stats.articles_by_status(state.articles).collect()} == {"accepted": 2, "duplicate": 2, "rejected": 1}
    seen = {(r.batch, r.outcome): r["count"] for r in ingest.read_outcomes(spark, root).groupBy("batch", "outcome").count().collect()}
    assert seen == {(0, "accepted"): 1, (0, "duplicate"): 2, (0, "rejected"): 1, (1, "existing"): 1, (1, "invalid"): 1, (1, "accepted"): 1}
    coverage = {(r.article_id, r.source_domain) for r in news.also_reported_by(state.articles).collect()}
    assert coverage == {(1, "tribune.example.net"), (1, "gazette.example.net")}


def test_unchanged_rules_change_nothing(spark, root):
    out = pipeline.rescore(ingest.read_state(spark, root), setup_of(spark), now())
    assert tuple(out["counts"].first()) == (5, 0)


def test_copies_are_released_with_their_representative(spark, root):
    """Without weight on the crews, only the headline that names the union still counts: it leaves its rejected representative."""
    state = ingest.read_state(spark, root)
    out = pipeline.rescore(state, setup_of(spark, ferry_weight=0.0), now())
    assert view(out["articles"]) == {1: ("rejected", None), 2: ("rejected", None), 3: ("accepted", None), 4: ("rejected", None), 7: ("rejected", None)}
    assert {r.article_id for r in out["changes"].collect()} == {1, 3, 7}
    # And back again: the earlier article is accepted and takes its copies.
    again = pipeline.rescore(State(apply_rows(state.articles, out["articles"], ["id"]), state.article_categories, state.sources), setup_of(spark), now())
    assert view(again["articles"]) == view(state.articles)


def test_one_publisher_releases_copies_elsewhere(spark, root):
    state = ingest.read_state(spark, root)
    placed = state.articles.withColumn("source_id", F.when(F.col("id") == 1, 11).otherwise(12).cast(schemas.ARTICLE["source_id"].dataType))
    out = pipeline.rescore(State(placed, state.article_categories, state.sources), setup_of(spark, ferry_weight=0.0), now(), source_id=11)
    assert view(out["articles"]) == {1: ("rejected", None), 2: ("rejected", None), 3: ("accepted", None)}


def test_late_evidence_promotes_an_article_without_any(spark):
    empty = State(*(spark.createDataFrame([], s) for s in (schemas.ARTICLE, ingest._CATEGORIES, schemas.SOURCE)))
    plain = dict(title="Lighthouse keepers gather for their yearly dinner by the sea", url="https://coast.example.net/dinner", source_country=None)
    one = pipeline.process(frame(spark, [item(1, **plain)]), empty, setup_of(spark), now())
    assert view(one["articles"]) == {1: ("rejected", None)}
    stored = one["articles"].withColumn("matched_query_ids", F.lit(None).cast("array<int>"))
    state = State(stored, one["article_categories"], one["sources"])
    two = pipeline.process(frame(spark, [item(2, matched_query_id=7, **plain), item(3, matched_query_id=8, **plain)]), state, setup_of(spark), now())
    assert [(r.id, r.status, r.matched_query_ids) for r in two["articles"].collect()] == [(1, "pending_review", [7, 8])]


def test_stream_equals_batches(spark, root, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    for rows in BATCHES:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(landing)
        ingest.stream_ingest(spark, landing, out, str(tmp_path / "ck"), setup_of(spark), now()).awaitTermination()
    columns = ["id", "status", "duplicate_of_id", "duplicate_reason", "relevance_score", "url_hash"]
    tables = [{tuple(r) for r in ingest.current(spark, p, "articles").select(*columns).collect()} for p in (out, root)]
    assert tables[0] == tables[1]
