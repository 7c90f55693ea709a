"""The quality stage computes each statistic of a row once, however many rules read it."""

from newsloom.llm import rule_ensemble


def test_rules_read_statistics_and_do_not_compute_them(spark, monkeypatch):
    at = rule_ensemble.STATISTICS.index("repeated_words")
    rules = tuple(rule_ensemble.Rule(((at, True, cut / 20),)) for cut in range(1, 20))
    monkeypatch.setattr(rule_ensemble, "learn", lambda *_: rule_ensemble.Ensemble(3.0, (-0.5,) * len(rules), rules))
    df = spark.createDataFrame([(1, "a b c d"), (2, "a a a a a a a a a a"), (3, None)], "doc_id long, text string")
    kept = rule_ensemble.accepted(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(words") == 1
    assert {r.doc_id for r in kept.collect()} == {1, 3}
