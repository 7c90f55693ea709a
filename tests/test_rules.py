"""Rule semantics on small cases."""

from pyspark.sql import functions as F

from newsloom.functions import rules
from newsloom.functions.rules import RelevanceConfig, Rule
from newsloom.operators.relevance import score_relevance


def test_word_boundary_is_ascii(spark):
    df = spark.createDataFrame([("étram tramé tram",)], "t STRING")
    n = df.select(F.regexp_count("t", F.lit(rules.java_pattern(r"\btram\b")))).first()[0]
    assert n == 3


def score(spark, title, rule, entities=None, ids=None, weights=None):
    df = spark.createDataFrame([(title, None, "https://a.in/x", entities, None, 0.0, ids or [])],
                               "title STRING, description STRING, original_url STRING, entities STRING, source_country STRING, trust_weight DOUBLE, matched_query_ids ARRAY<INT>")
    return score_relevance(df, [rule], weights or {}, RelevanceConfig(50.0, 30.0)).first()


def test_proximity(spark):
    rule = Rule("p", "proximity", "lantern", 50.0, ("title",), "market", 3)
    assert score(spark, "Lantern lights the market", rule).relevance_score == 50.0
    assert score(spark, "Lantern makers met many people during the new market", rule).relevance_score == 0.0


def test_phrase_never_spans_two_entities(spark):
    rule = Rule("m", "phrase", "night market", 45.0)
    assert [s.rule for s in score(spark, "x", rule, "Old Night ; Market Hall").relevance_signals] == []
    assert [s.rule for s in score(spark, "x", rule, "a ; Old night Market ; b").relevance_signals] == ["m"]


def test_evidence_and_clamp(spark):
    rule = Rule("b", "phrase", "tram", 90.0)
    r = score(spark, "tram tram tram tram tram tram", rule, ids=[1, 2, 9], weights={1: 35.0, 2: 30.0})
    assert r.relevance_score == 100.0 and r.relevance_status == "relevant"
    assert [(s.rule, s["count"], s.contribution) for s in r.relevance_signals] == [("b", 6, 117.0), ("provider-query-match", 2, 35.0), ("multiple-query-match", 2, 5.0)]
