"""Publishers, category assignments, retention: state transitions as whole-table rewrites."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.plans.store import Store
from newsloom.session import materialise


@dataclass(frozen=True)
class RetentionPolicy:
    """Days each kind of row is kept."""

    rejected: int = 30
    duplicates: int = 60
    metadata: int = 30
    changes: int = 7
    runs: int = 90
    slices: int = 30
    dead_letters: int = 30
    audit: int = 365


def sources_upsert(sources: DataFrame, sightings: DataFrame) -> DataFrame:
    """Known publishers plus each new domain of ``(domain, country, arrival)``.

    A publisher keeps its first country that is not null; sightings are reduced per domain before
    anything is joined, so a publisher with a third of all rows stays one row per task.
    """
    first = sightings.groupBy("domain").agg(
        F.min_by("country", F.when(F.col("country").isNotNull(), F.col("arrival"))).alias("seen_country"),
        F.min("arrival").alias("first_arrival"),
    )
    both = sources.join(first, "domain", "full")
    return both.select(
        "id", "domain", F.coalesce("name", "domain").alias("name"), F.coalesce("country", "seen_country").alias("country"),
        F.coalesce("status", F.lit("active")).alias("status"),
        F.coalesce("trust_weight", F.lit(0.0)).alias("trust_weight"),
        F.coalesce("homepage_url", F.concat(F.lit("https://"), "domain", F.lit("/"))).alias("homepage_url"),
    )


def source_rename(articles: DataFrame, renames: DataFrame) -> DataFrame:
    """New publisher names ``(source_id, name)`` copied to their articles."""
    new = renames.select("source_id", F.col("name").alias("_name"))
    return articles.join(new, "source_id", "left").withColumn(
        "source_name", F.coalesce("_name", "source_name")
    ).drop("_name")


def category_replace(current: DataFrame, computed: DataFrame, processed: DataFrame) -> DataFrame:
    """Rule-assigned rows of the processed articles replaced as a set; manual rows stay.

    ``processed`` is ``(article_id, manual_categories)``: an article with manual categories keeps
    all its rows.
    """
    rules_apply = processed.filter("NOT coalesce(manual_categories, false)").select("article_id")
    manual = current.filter("assigned_by = 'manual'")
    untouched = current.filter("assigned_by <> 'manual'").join(rules_apply, "article_id", "left_anti")
    fresh = (
        computed.join(rules_apply, "article_id", "left_semi")
        .withColumn("assigned_by", F.lit("rule"))
        .join(manual.select("article_id", "category_id"), ["article_id", "category_id"], "left_anti")
    )
    columns = ["article_id", "category_id", "score", "assigned_by"]
    return manual.select(*columns).unionByName(untouched.select(*columns)).unionByName(fresh.select(*columns))


def _older(column: str, now: Column, days: int) -> Column:
    return F.coalesce(F.col(column) < now - F.expr(f"INTERVAL {int(days)} DAYS"), F.lit(False))


def expired_articles(articles: DataFrame, now: Column, policy: RetentionPolicy) -> DataFrame:
    """``(id, reason)`` of articles past their retention.

    Rejected rows go only when no copy points at them; the pointed-at ids are distinct before the
    join, so a story with millions of copies is one row.
    """
    automatic = articles.filter("manual_status IS NULL")
    pointed = articles.filter("duplicate_of_id IS NOT NULL").select(F.col("duplicate_of_id").alias("id")).distinct()
    rejected = (
        automatic.filter((F.col("status") == "rejected") & _older("created_at", now, policy.rejected))
        .select("id").join(pointed, "id", "left_anti").select("id", F.lit("rejected").alias("reason"))
    )
    copies = automatic.filter((F.col("status") == "duplicate") & _older("created_at", now, policy.duplicates)).select(
        "id", F.lit("duplicates").alias("reason")
    )
    return rejected.unionByName(copies)


def retained_articles(articles: DataFrame, now: Column, policy: RetentionPolicy = RetentionPolicy()) -> DataFrame:
    gone = expired_articles(articles, now, policy).select("id")
    old = _older("created_at", now, policy.metadata)
    return articles.join(gone, "id", "left_anti").withColumn(
        "provider_metadata", F.when(~old, F.col("provider_metadata"))
    )


def retained_changes(changes: DataFrame, now: Column, policy: RetentionPolicy = RetentionPolicy()) -> DataFrame:
    return changes.filter(~_older("processed_at", now, policy.changes))


def retained_runs(runs: DataFrame, now: Column, policy: RetentionPolicy = RetentionPolicy()) -> DataFrame:
    return runs.filter(~_older("started_at", now, policy.runs))


def retained_slices(slices: DataFrame, backfills: DataFrame, now: Column, policy: RetentionPolicy = RetentionPolicy()) -> DataFrame:
    closed = backfills.filter(
        F.col("status").isin("completed", "cancelled") & _older("completed_at", now, policy.slices)
    ).select(F.col("id").alias("backfill_id"))
    finished = slices.filter(F.col("status").isin("done", "skipped")).join(closed, "backfill_id", "left_semi").select("id")
    return slices.join(finished, "id", "left_anti")


#: Tables that retention works on, each with a key ``id``.
RETAINED = ("articles", "changes", "runs", "slices", "dead_letters", "audit")


def expired(tables: dict[str, DataFrame], backfills: DataFrame, now: Column, policy: RetentionPolicy = RetentionPolicy()) -> dict[str, tuple[str, DataFrame]]:
    """By class: the table and the ids of the rows past their retention; ``provider_metadata`` is emptied, the others go."""
    gone = expired_articles(tables["articles"], now, policy)
    of = lambda name, column, days: (name, tables[name].filter(_older(column, now, days)).select("id"))
    closed = backfills.filter(F.col("status").isin("completed", "cancelled") & _older("completed_at", now, policy.slices)).select(F.col("id").alias("backfill_id"))
    stale = tables["articles"].filter(F.col("provider_metadata").isNotNull() & _older("created_at", now, policy.metadata))
    return {
        "rejected": ("articles", gone.filter("reason = 'rejected'").select("id")), "duplicates": ("articles", gone.filter("reason = 'duplicates'").select("id")),
        "provider_metadata": ("articles", stale.select("id")),
        "changes": of("changes", "processed_at", policy.changes), "runs": of("runs", "started_at", policy.runs),
        "slices": ("slices", tables["slices"].filter(F.col("status").isin("done", "skipped")).join(closed, "backfill_id", "left_semi").select("id")),
        "dead_letters": of("dead_letters", "resolved_at", policy.dead_letters), "audit": of("audit", "created_at", policy.audit),
    }


def apply_retention(kept: Store, number: int, backfills: DataFrame, now: Column, policy: RetentionPolicy = RetentionPolicy()) -> bool:
    """Rewrite the buckets that hold expired rows, all tables in one commit; buckets without any are neither read for it nor written."""
    old = expired({name: kept.current(name) for name in RETAINED}, backfills, now, policy)

    def parts() -> dict[str, tuple[DataFrame, list[int]]]:
        out = {}
        for name in RETAINED:
            ids = None
            for kind, (table, rows) in old.items():
                if table == name and kind != "provider_metadata":
                    ids = rows if ids is None else ids.unionByName(rows)
            ids = materialise(ids.distinct(), "expired")
            stale = materialise(old["provider_metadata"][1], "stale") if name == "articles" else None
            touched = kept.buckets_of(name, ids if stale is None else ids.unionByName(stale))
            if touched:
                rows = kept.current(name, touched).join(ids, "id", "left_anti")
                if stale is not None:
                    rows = rows.join(stale.withColumn("_stale", F.lit(True)), "id", "left").withColumn(
                        "provider_metadata", F.when(F.col("_stale").isNull(), F.col("provider_metadata"))).drop("_stale")
                out[name] = (rows, touched)
        return out

    return kept.replace(number, parts)


def retention_counts(tables: dict[str, DataFrame], backfills: DataFrame, now: Column, policy: RetentionPolicy = RetentionPolicy()) -> DataFrame:
    """``(class, n)``: how many rows each retention rule touches."""
    out = None
    for kind, (_, ids) in expired(tables, backfills, now, policy).items():
        part = ids.agg(F.count("*").alias("n")).select(F.lit(kind).alias("class"), "n")
        out = part if out is None else out.unionByName(part)
    return out
