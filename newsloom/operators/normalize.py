"""The normalise job: provider candidates to canonical articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as t
from newsloom.functions import url as u
from newsloom.functions.binding import let
from newsloom.functions.times import parse_feed_timestamp
from newsloom.schemas import ARTICLE_NORM

# --- fixed values: must equal the published behaviour for results to match -------------------
LANGUAGE_ALIASES = {"english": "en", "eng": "en", "en": "en", "tamil": "ta", "tam": "ta", "ta": "ta"}
GENERIC_SEGMENTS = ["news", "latestnews", "indianews", "breakingnews", "topnews"]
GENERIC_LABELS = ["www", "news", "amp"]
# ---------------------------------------------------------------------------------------------
_SEPARATOR = t.WS + r"+[|\-–—:]" + t.WS + "+"


def normalize_language(value: Column) -> Column:
    key = F.lower(F.trim(value))
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv])
    known = F.try_element_at(names, key)
    return F.when(value.isNull() | (value == ""), "und").otherwise(
        F.coalesce(known, F.when(F.length(key) <= 3, key).otherwise("und"))
    )


def strip_source_suffix(title: Column, domain: Column) -> Column:
    """A title without the trailing name of its publisher.

    A title is cut before one of its last two separators if what follows directly resembles the domain; the
    left one is tried first. Titles that would be left with under 10 characters stay whole.
    """
    labels = let(F.split(domain, r"\."), lambda d: F.slice(d, F.lit(1), F.greatest(F.size(d) - 1, F.lit(0))))

    def names_source(segment: Column, src: Column) -> Column:
        return let(
            F.regexp_replace(F.lower(segment), "[^a-z0-9]", ""),
            lambda s: F.length(s).between(4, 40)
            & (
                F.contains(src.stem, s)
                | F.contains(s, src.stem)
                | F.exists(src.long_labels, lambda x: F.contains(s, F.regexp_replace(x, "[^a-z0-9]", "")))
                | s.isin(*GENERIC_SEGMENTS)
            ),
        )

    def head(cut_off: Column) -> Column:
        return let(
            F.trim(F.substring(title, F.lit(1), F.length(title) - cut_off)),
            lambda kept: F.when(F.length(kept) >= 10, kept).otherwise(title),
        )

    def decide(x: Column) -> Column:
        def at(items: Column, k: int) -> Column:
            return F.coalesce(F.try_element_at(items, F.lit(k)), F.lit(""))

        last, before = at(x.segments, -1), at(x.segments, -2)
        end = F.length(last) + F.length(at(x.seps, -1))
        return (
            F.when(F.size(x.segments) < 2, title)
            .when((F.size(x.segments) >= 3) & names_source(before, x.src), head(end + F.length(before) + F.length(at(x.seps, -2))))
            .when(names_source(last, x.src), head(end))
            .otherwise(title)
        )

    source = let(
        labels,
        lambda ls: F.struct(
            F.regexp_replace(F.array_join(ls, ""), "[^a-z0-9]", "").alias("stem"),
            F.filter(ls, lambda x: (F.length(x) >= 4) & ~x.isin(*GENERIC_LABELS)).alias("long_labels"),
        ),
    )
    parts = F.struct(
        F.split(title, _SEPARATOR).alias("segments"),
        F.regexp_extract_all(title, F.lit("(" + _SEPARATOR + ")"), F.lit(1)).alias("seps"),
        source.alias("src"),
    )
    return let(parts, decide)


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize(candidates: DataFrame) -> DataFrame:
    """Every candidate with its normalised columns and a ``reason`` that is null when valid."""
    checked = candidates.withColumns(
        {
            "_u": u.url_parts(F.col("url")),
            "_published": parse_feed_timestamp(F.coalesce("published_at", F.lit(""))),
            "_display": t.clean_display_text(F.col("title")),
        }
    ).withColumns(
        {
            "_host": u.strip_host_prefix(F.col("_u.host")),
            "_url_reason": F.when(F.col("url").isNull() | F.col("title").isNull(), "missing_fields").otherwise(
                F.concat(F.lit("invalid_url:"), u.public_url_reason_of(F.col("_u")))
            ),
        }
    )
    titled = checked.withColumn(
        "_title", t.truncate_words(strip_source_suffix(F.col("_display"), F.col("_host")), t.TITLE_MAX)
    )
    named = titled.withColumns(
        {
            "reason": F.coalesce(
                "_url_reason",
                F.when(F.col("_published").isNull(), "invalid_timestamp"),
                F.when(F.col("_title") == "", "missing_title"),
            ),
            "canonical_url": u.canonical_url_of(F.col("_u")),
            "normalized_title": t.match_text(F.col("_title")),
        }
    )

    def cleaned(name: str, limit: int) -> Column:
        # Empty input counts as absent; only a description that cleans to nothing also does.
        return F.when(F.col(name) != "", t.truncate_words(t.clean_display_text(F.col(name)), limit))

    return named.select(
        "provider",
        "provider_ref",
        u.clean_original_url_of(F.col("_u")).alias("original_url"),
        "canonical_url",
        t.sha256_hex(F.col("canonical_url")).alias("url_hash"),
        F.col("_title").alias("title"),
        "normalized_title",
        t.sha256_hex(F.col("normalized_title")).alias("title_hash"),
        _blank_to_null(cleaned("description", t.DESCRIPTION_MAX)).alias("description"),
        F.when(F.col("image_url") != "", u.image_url_or_null(F.col("image_url"))).alias("image_url"),
        cleaned("author", t.AUTHOR_MAX).alias("author"),
        normalize_language(F.col("language")).alias("language"),
        F.col("_host").alias("source_domain"),
        cleaned("source_country", t.COUNTRY_MAX).alias("source_country"),
        F.col("_published").alias("published_at"),
        F.when(F.col("entities") != "", t.truncate_words(F.col("entities"), t.ENTITIES_MAX)).alias("entities"),
        F.when(F.col("matched_query_id").isNotNull(), F.array("matched_query_id"))
        .otherwise(F.array().cast("array<int>"))
        .alias("matched_query_ids"),
        F.col("metadata").alias("provider_metadata"),
        "niche_id",
        "run_id",
        "arrival",
        "reason",
    )


def normalize_candidates(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid ARTICLE_NORM rows, refused rows with their reason)``."""
    rows = normalize(candidates)
    valid = rows.filter(F.col("reason").isNull()).select(*ARTICLE_NORM.names)
    return valid, rows.filter(F.col("reason").isNotNull()).select("niche_id", "run_id", "arrival", "reason")
