"""Explicit schemas of every record and table; nothing is inferred when reading."""

from __future__ import annotations

from pyspark.sql import types as T

STR, INT, LONG, SHORT, DBL, TS, BOOL = (
    T.StringType(), T.IntegerType(), T.LongType(), T.ShortType(), T.DoubleType(), T.TimestampType(), T.BooleanType(),
)
TEXTS, INTS, TEXT_MAP = T.ArrayType(STR), T.ArrayType(INT), T.MapType(STR, STR)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SIGNAL = _table(rule=STR, fields=TEXTS, count=INT, contribution=DBL)

CANDIDATE = _table(
    provider=STR, provider_ref=STR, url=STR, title=STR, description=STR, image_url=STR, source_domain=STR,
    source_country=STR, language=STR, author=STR, published_at=STR, entities=STR, matched_query_id=INT,
    metadata=TEXT_MAP, niche_id=SHORT, run_id=LONG, arrival=LONG,
)
ARTICLE_NORM = _table(
    provider=STR, provider_ref=STR, original_url=STR, canonical_url=STR, url_hash=STR, title=STR,
    normalized_title=STR, title_hash=STR, description=STR, image_url=STR, author=STR, language=STR,
    source_domain=STR, source_country=STR, published_at=TS, entities=STR, matched_query_ids=INTS,
    provider_metadata=TEXT_MAP, niche_id=SHORT, run_id=LONG, arrival=LONG,
)
ARTICLE = _table(
    id=LONG, niche_id=SHORT, source_id=INT, provider=STR, provider_ref=STR, original_url=STR, canonical_url=STR,
    url_hash=STR, title=STR, normalized_title=STR, title_hash=STR, description=STR, image_url=STR, author=STR,
    language=STR, source_domain=STR, source_name=STR, source_country=STR, published_at=TS, first_seen_at=TS,
    last_seen_at=TS, status=STR, relevance_score=DBL, relevance_status=STR, relevance_signals=T.ArrayType(SIGNAL),
    quality_status=STR, quality_reasons=TEXTS, duplicate_of_id=LONG, duplicate_reason=STR, manual_status=STR,
    manual_categories=BOOL, matched_query_ids=INTS, entities=STR, provider_metadata=TEXT_MAP, created_at=TS,
    updated_at=TS,
)
ARTICLE_CATEGORY = _table(article_id=LONG, category_id=SHORT, slug=STR, score=DBL, assigned_by=STR)
SOURCE = _table(id=INT, domain=STR, name=STR, country=STR, status=STR, trust_weight=DBL, homepage_url=STR)
CHANGE = _table(id=LONG, article_id=LONG, created_at=TS, processed_at=TS, attempts=SHORT, last_error=STR)
RUN = _table(
    id=LONG, niche_id=SHORT, query_id=INT, kind=STR, provider=STR, window_start=TS, window_end=TS, status=STR,
    fetched=INT, accepted=INT, pending=INT, rejected=INT, duplicates=INT, existing=INT, invalid=INT, error=STR,
    started_at=TS, finished_at=TS, duration_ms=INT,
)
BACKFILL = _table(
    id=INT, niche_id=SHORT, range_start=TS, range_end=TS, strategy=STR, status=STR, total_slices=INT, completed_at=TS,
)
BACKFILL_SLICE = _table(
    id=LONG, backfill_id=INT, provider=STR, query_id=INT, slice_start=TS, slice_end=TS, status=STR, attempts=SHORT,
    fetched=INT, matched=INT, error=STR,
)
RULE = _table(
    id=INT, niche_id=SHORT, name=STR, rule_type=STR, pattern=STR, pattern_b=STR, max_distance=INT, fields=TEXTS,
    weight=DBL, enabled=BOOL,
)
CATEGORY = _table(
    id=SHORT, slug=STR, name=STR, sort_order=SHORT, is_feed_section=BOOL, enabled=BOOL, min_score=DBL,
)
CATEGORY_RULE = _table(
    id=INT, category_id=SHORT, rule_type=STR, pattern=STR, fields=TEXTS, weight=DBL, enabled=BOOL,
)
BOOKMARK = _table(user_id=LONG, article_id=LONG, created_at=TS)
DOC_ANSWER = _table(
    articles=T.ArrayType(
        _table(url=STR, title=STR, seendate=STR, socialimage=STR, domain=STR, language=STR, sourcecountry=STR)
    )
)
