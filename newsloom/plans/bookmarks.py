"""Bookmarks and recent searches, for all users at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------------------------
MAX_BOOKMARKS = 5000
RECENT_SEARCHES, MIN_QUERY_CHARS = 8, 2
# ---------------------------------------------------------------------------------------------


def bookmark_count(bookmarks: DataFrame) -> DataFrame:
    return bookmarks.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("room", F.greatest(F.lit(MAX_BOOKMARKS) - F.col("n"), F.lit(0)))


def bookmarks_page(bookmarks: DataFrame, articles: DataFrame, limit: int = 20, after: tuple | None = None) -> DataFrame:
    """The newest bookmarks of each user whose article is public, below an optional cursor."""
    rows = bookmarks
    if after is not None:
        t, i = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        rows = rows.filter((F.col("created_at") < t) | ((F.col("created_at") == t) & (F.col("article_id") < i)))
    public = articles.filter("status = 'accepted'").select(F.col("id").alias("article_id"), "title", "source_domain")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("article_id").desc()))
    return rows.join(public, "article_id").withColumn("rank", rank).filter(F.col("rank") <= limit)


def bookmark_merge(server: DataFrame, device: DataFrame, removals: DataFrame, articles: DataFrame) -> DataFrame:
    """Server and device bookmarks united after the device's pending removals.

    Removals act on the server list only; the device's copy of a bookmark keeps its own time, and
    only public articles are newly inserted on the server.
    """
    public = articles.filter("status = 'accepted'").select(F.col("id").alias("article_id"))
    kept = server.join(removals.select("user_id", "article_id"), ["user_id", "article_id"], "left_anti")
    both = device.withColumn("side", F.lit(0)).unionByName(kept.withColumn("side", F.lit(1)))
    known = kept.select("user_id", "article_id", F.lit(True).alias("on_server")).distinct()
    merged = both.groupBy("user_id", "article_id").agg(
        F.min_by("created_at", F.struct("side", "created_at")).alias("created_at"), F.min("side").alias("side")
    )
    return (
        merged.join(known, ["user_id", "article_id"], "left")
        .join(public.withColumn("public", F.lit(True)), "article_id", "left")
        .select(
            "user_id", "article_id", "created_at",
            F.when(F.col("side") == 0, "device").otherwise("server").alias("origin"),
            (F.coalesce("on_server", F.lit(False)) | F.coalesce("public", F.lit(False))).alias("stored"),
        )
    )


def recent_searches(log: DataFrame, keep: int = RECENT_SEARCHES) -> DataFrame:
    """Newest distinct searches (ignoring case) of each user from ``(user_id, seq, q)``."""
    trimmed = log.withColumn("q", F.trim("q")).filter(F.length("q") >= MIN_QUERY_CHARS)
    last = trimmed.groupBy("user_id", F.lower("q").alias("key")).agg(F.max(F.struct("seq", "q")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("m.seq").desc()))
    return last.withColumn("rank", rank).filter(F.col("rank") <= keep).select("user_id", "rank", "m.q")
