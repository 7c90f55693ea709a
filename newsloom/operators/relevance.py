"""Rule-based relevance score of articles, explained by signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.rules import RULE_FIELDS, RelevanceConfig, Rule, java_pattern, occurrences, round2
from newsloom.functions.binding import let
from newsloom.functions.fold import fold_accents
from newsloom.functions.text import WORD_END, match_text
from newsloom.functions.url import url_match_text


def entity_segments(entities: Column) -> Column:
    """Match text of each ``;`` item, so a phrase never spans two names.

    An item holds no ``;`` and hence no complete HTML entity, so accents can be folded once on
    the whole list; U+037E would decompose into a semicolon and is blanked first.
    """
    folded = F.lower(let(F.replace(F.coalesce(entities, F.lit("")), F.lit("\u037e"), F.lit(" ")), fold_accents))

    def piece(name: Column) -> Column:
        plain = F.regexp_replace(name, r"['’]s" + WORD_END, "")
        return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))

    return F.filter(F.transform(F.split(folded, ";"), piece), lambda s: s != "")


def field_segments(articles: DataFrame) -> DataFrame:
    """Adds the match text of each field; entities as an array of independent pieces."""
    return articles.withColumns(
        {
            "seg_title": match_text(F.col("title")),
            "seg_description": match_text(F.col("description")),
            "seg_url": url_match_text(F.col("original_url")),
            "seg_entities": entity_segments(F.col("entities")),
        }
    )


def field_count(rule: Rule, name: str) -> Column:
    """Occurrences of a rule in one field."""
    column = F.col(f"seg_{name}")
    if name != "entities":
        return occurrences(rule, column)
    per_piece = F.transform(column, lambda s: occurrences(rule, s).cast("int"))
    return F.aggregate(per_piece, F.lit(0), lambda a, b: a + b)


def rule_signal(rule: Rule, counts: dict[str, Column], config: RelevanceConfig) -> Column:
    """``struct<rule,fields,count,raw>`` of one rule from its per-field counts, null without a match.

    A rule counts once, at its strongest field, plus a small capped bonus for repeats.
    """
    total = reduce(lambda a, b: a + b, counts.values())
    factors = [
        F.when(n > 0, float(config.field_multipliers.get(f, 0.0))).otherwise(0.0) for f, n in counts.items()
    ]
    best = F.greatest(F.lit(0.0), *factors)
    extra = F.least(total - 1, F.lit(config.frequency_bonus_cap))
    raw = F.lit(float(rule.weight)) * best * (1 + extra * float(config.frequency_bonus_per_extra))
    signal = F.struct(
        F.lit(rule.name).alias("rule"),
        F.array_compact(F.array(*[F.when(n > 0, F.lit(f)) for f, n in counts.items()])).alias("fields"),
        total.cast("int").alias("count"), raw.alias("raw"),
    )
    return F.when(total > 0, signal)


def _signal(rule: Column, count: Column, raw: Column) -> Column:
    return F.struct(
        rule.alias("rule"), F.array().cast("array<string>").alias("fields"),
        count.cast("int").alias("count"), raw.cast("double").alias("raw"),
    )


def query_weight_list(ids: Column, query_weights: dict[int, float]) -> Column:
    """Weights of the known queries among ``ids``."""
    if not query_weights:
        return F.array().cast("array<double>")
    table = F.create_map(*[F.lit(x) for k, v in sorted(query_weights.items()) for x in (int(k), float(v))])
    looked_up = F.transform(F.coalesce(ids, F.array().cast("array<int>")), lambda i: F.try_element_at(table, i))
    return F.filter(looked_up, lambda w: w.isNotNull())


def provider_evidence(weights: Column, config: RelevanceConfig) -> list[Column]:
    """Best matched query, and a bonus when more than one query returned the article."""
    n = F.size(weights)
    return [
        F.when(n > 0, _signal(F.lit("provider-query-match"), n, F.array_max(weights))),
        F.when(n > 1, _signal(F.lit("multiple-query-match"), n, F.lit(config.multi_query_bonus))),
    ]


def country_boost(country: Column, config: RelevanceConfig) -> Column:
    key = F.trim(F.lower(F.coalesce(country, F.lit(""))))
    if not config.country_boosts:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for k, v in config.country_boosts.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, key), F.lit(0.0))


def country_trust_boost(country: Column, trust: Column, config: RelevanceConfig) -> list[Column]:
    key = F.trim(F.lower(F.coalesce(country, F.lit(""))))
    boost = country_boost(country, config)
    trust = F.coalesce(trust, F.lit(0.0))
    return [
        F.when(boost != 0, _signal(F.concat(F.lit("source-country:"), key), F.lit(1), boost)),
        F.when(trust != 0, _signal(F.lit("source-trust"), F.lit(1), trust)),
    ]


def anchor_check(weights: Column, config: RelevanceConfig) -> Column:
    """No anchor configured, some query matched, or the anchor occurs in any segment."""
    if not config.anchor_pattern:
        return F.lit(True)
    pattern = F.lit(java_pattern(config.anchor_pattern))
    plain = [F.rlike(F.col(f"seg_{f}"), pattern) for f in RULE_FIELDS if f != "entities"]
    in_names = F.exists("seg_entities", lambda s: F.rlike(s, pattern))
    return reduce(lambda a, b: a | b, [F.size(weights) > 0, *plain, in_names])


def score_relevance(
    articles: DataFrame, rules: list[Rule], query_weights: dict[int, float], config: RelevanceConfig
) -> DataFrame:
    """Adds ``relevance_score``, ``relevance_status``, ``anchor_found`` and ``relevance_signals``.

    Needs title, description, original_url, entities, source_country, trust_weight and
    matched_query_ids. One generated expression per rule: no shuffle, no rule join.
    """
    weighted = field_segments(articles).withColumn(
        "_weights", query_weight_list(F.col("matched_query_ids"), query_weights)
    )
    weights = F.col("_weights")
    # The counts are plain integer columns of their own stage: regular expressions run once per
    # rule and field, and everything after them is generated arithmetic.
    names = {(k, f): f"_n{k}_{f}" for k, r in enumerate(rules) for f in r.fields}
    weighted = weighted.withColumns(
        {name: field_count(rules[k], f).cast("int") for (k, f), name in names.items()}
    )
    parts = [
        rule_signal(r, {f: F.col(names[k, f]) for f in r.fields}, config) for k, r in enumerate(rules)
    ]
    parts += provider_evidence(weights, config)
    parts += country_trust_boost(F.col("source_country"), F.col("trust_weight"), config)
    signalled = weighted.withColumns(
        {"_raw": F.filter(F.array(*parts), lambda s: s.isNotNull()), "anchor_found": anchor_check(weights, config)}
    )
    total = F.aggregate("_raw", F.lit(0.0), lambda a, s: a + s.raw)
    scored = signalled.withColumn(
        "relevance_score", round2(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)))
    )
    score = F.col("relevance_score")
    shown = F.transform(
        F.concat(
            "_raw",
            F.when(
                ~F.col("anchor_found"), F.array(_signal(F.lit("anchor-missing"), F.lit(0), F.lit(0.0)))
            ).otherwise(F.filter(F.col("_raw"), lambda s: F.lit(False))),
        ),
        lambda s: F.struct(s.rule.alias("rule"), s.fields.alias("fields"), s["count"].alias("count"), round2(s.raw).alias("contribution")),
    )
    return scored.withColumns(
        {
            "relevance_status": F.when(~F.col("anchor_found"), "irrelevant")
            .when(score >= config.accept_threshold, "relevant")
            .when(score >= config.review_threshold, "review")
            .otherwise("irrelevant"),
            "relevance_signals": shown,
        }
    ).drop("_raw", "_weights", *names.values())
