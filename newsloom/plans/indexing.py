"""Search documents from articles: full build, change projection, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.plans.news import categories_agg
from newsloom.plans.stats import MAX_OUTBOX_ATTEMPTS


DOCUMENT = [
    "id", "niche", "title", "description", "source_name", "source_domain", "source_country", "categories", "language",
    "published_at", "first_seen_at", "relevance_score", "url", "image_url",
]


def search_documents(
    articles: DataFrame, niches: DataFrame, article_categories: DataFrame, categories: DataFrame,
    now: Column | None = None, retention_days: int = 0,
) -> DataFrame:
    """The public document of every accepted article inside the retention window."""
    rows = articles.filter("status = 'accepted'")
    if retention_days > 0:
        rows = rows.filter(F.col("published_at") >= now - F.expr(f"INTERVAL {int(retention_days)} DAYS"))
    named = niches.select(F.col("id").alias("niche_id"), F.col("slug").alias("niche"))
    return (
        rows.join(named, "niche_id")
        .join(categories_agg(article_categories, categories), "id", "left")
        .withColumns(
            {"categories": F.coalesce("categories", F.array().cast("array<string>")), "url": F.col("original_url")}
        )
        .select(*DOCUMENT)
    )


def pending_changes(changes: DataFrame) -> DataFrame:
    return changes.filter((F.col("processed_at").isNull()) & (F.col("attempts") < MAX_OUTBOX_ATTEMPTS))


def outbox_project(changes: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(documents to upsert, ids to delete)`` for the pending changes.

    A document always comes from the current article, so replaying changes is harmless. The ids
    are made distinct before the join: many changes of one article are one row per task.
    """
    wanted = pending_changes(changes).select(F.col("article_id").alias("id")).distinct()
    return documents.join(wanted, "id", "left_semi"), wanted.join(documents.select("id"), "id", "left_anti")


def rebuild_index(documents: DataFrame, changes: DataFrame, start_id: int) -> tuple[DataFrame, DataFrame]:
    """All documents, and the changes written after the build began, to be projected again."""
    replay = changes.filter(F.col("id") > start_id).withColumns(
        {"processed_at": F.lit(None).cast("timestamp"), "attempts": F.lit(0).cast("smallint")}
    )
    return documents, replay


def outbox_retry(changes: DataFrame) -> DataFrame:
    """Changes that were given up become eligible again."""
    failed = F.col("processed_at").isNull() & (F.col("attempts") >= MAX_OUTBOX_ATTEMPTS)
    return changes.withColumns(
        {
            "attempts": F.when(failed, F.lit(0)).otherwise(F.col("attempts")).cast("smallint"),
            "last_error": F.when(~failed, F.col("last_error")),
        }
    )
