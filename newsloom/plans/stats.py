"""Statistics over articles, publishers, runs and the change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.times import floor_minutes, seconds_between


# --- fixed values ----------------------------------------------------------------------------
STATUSES = ["accepted", "pending_review", "rejected", "duplicate"]
OUTCOMES = ["fetched", "accepted", "pending", "rejected", "duplicates", "existing", "invalid"]
MAX_OUTBOX_ATTEMPTS = 10
PUBLIC_SOURCES_MAX, ADMIN_SOURCES_MAX = 500, 2000
# ---------------------------------------------------------------------------------------------


def articles_by_status(articles: DataFrame) -> DataFrame:
    return articles.groupBy("status").agg(F.count("*").alias("n"))


def status_counts_wide(articles: DataFrame) -> DataFrame:
    return articles.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def _recent(runs: DataFrame, now: Column) -> DataFrame:
    return runs.filter(F.col("started_at") > now - F.expr("INTERVAL 24 HOURS"))


def runs_24h(runs: DataFrame, now: Column) -> DataFrame:
    return _recent(runs, now).groupBy("provider", "status").agg(F.count("*").alias("n"))


def run_outcomes(runs: DataFrame, now: Column) -> DataFrame:
    """``(outcome, n)`` totals of the last day; zero when there were no runs."""
    totals = _recent(runs, now).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in OUTCOMES])
    return totals.unpivot([], OUTCOMES, "outcome", "n")


def ingestion_summary(runs: DataFrame, now: Column) -> DataFrame:
    sums = ["fetched", "accepted", "pending", "rejected", "duplicates", "existing"]
    return (
        _recent(runs, now)
        .groupBy("provider", "kind")
        .agg(
            F.count("*").alias("runs"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            *[F.sum(c).alias(c) for c in sums],
            F.round(F.avg("duration_ms")).alias("avg_duration_ms"),
        )
    )


def last_success_age(runs: DataFrame, now: Column) -> DataFrame:
    """Seconds since the last successful scheduled run, -1 when there is none."""
    good = runs.filter("status = 'succeeded' AND kind = 'scheduled'")
    return good.agg(F.max("finished_at").alias("last")).select(
        F.coalesce(seconds_between(now, F.col("last")), F.lit(-1.0)).alias("age_seconds")
    )


def outbox_status(changes: DataFrame) -> DataFrame:
    return changes.filter("processed_at IS NULL").agg(
        F.count_if(F.col("attempts") < MAX_OUTBOX_ATTEMPTS).alias("pending"),
        F.count_if(F.col("attempts") >= MAX_OUTBOX_ATTEMPTS).alias("failed"),
        F.min("created_at").alias("oldest"),
    )


def index_drift(articles: DataFrame, indexed: DataFrame) -> DataFrame:
    """Accepted rows against indexed documents, and what each side lacks."""
    accepted = articles.filter("status = 'accepted'").select("id", F.lit(1).alias("a"))
    docs = indexed.select("id", F.lit(1).alias("d"))
    # One co-partitioned join gives all four figures.
    return accepted.join(docs, "id", "full").agg(
        F.count("a").alias("accepted"), F.count("d").alias("indexed"),
        F.count_if(F.col("d").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("stale"),
    )


def accepted_per_source(articles: DataFrame) -> DataFrame:
    """Counted before any join, so a publisher with a third of all articles is one row per task."""
    return articles.filter("status = 'accepted'").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("article_count"))


def sources_public(sources: DataFrame, articles: DataFrame, niche_id: int) -> DataFrame:
    counts = accepted_per_source(articles.filter(F.col("niche_id") == niche_id))
    return (
        sources.filter("status <> 'blocked'").join(counts, "id")
        .select("domain", "name", "country", "homepage_url", "article_count")
        .orderBy(F.col("article_count").desc(), "name", "domain")
        .limit(PUBLIC_SOURCES_MAX)
    )


def sources_admin(sources: DataFrame, articles: DataFrame, status: str | None = None) -> DataFrame:
    rows = sources if status is None else sources.filter(F.col("status") == status)
    return (
        rows.join(accepted_per_source(articles), "id", "left")
        .withColumn("accepted_articles", F.coalesce("article_count", F.lit(0).cast("long")))
        .drop("article_count")
        .orderBy("domain")
        .limit(ADMIN_SOURCES_MAX)
    )


def run_history(runs: DataFrame, queries: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    rows = runs if status is None else runs.filter(F.col("status") == status)
    newest = rows.orderBy(F.col("id").desc()).limit(limit)
    names = queries.select(F.col("id").alias("query_id"), F.col("name").alias("query_name"))
    return newest.join(names, "query_id", "left")


def batch_counts(outcomes: DataFrame) -> DataFrame:
    """Outcome counters per run from ``(run_id, outcome)`` rows, as added to the run ledger."""
    names = {
        "accepted": "accepted", "pending_review": "pending", "rejected": "rejected", "duplicate": "duplicates",
        "existing": "existing", "invalid": "invalid",
    }
    return outcomes.groupBy("run_id").agg(*[F.count_if(F.col("outcome") == k).alias(v) for k, v in names.items()])


def cycle_buckets(runs: DataFrame, minutes: int = 30) -> DataFrame:
    """Runs per query and tumbling cycle; more than one in a cycle repeats an idempotent job."""
    return (
        runs.groupBy("query_id", floor_minutes(F.col("started_at"), minutes).alias("cycle"))
        .agg(F.count("*").alias("runs"))
        .withColumn("repeated", F.col("runs") > 1)
    )
