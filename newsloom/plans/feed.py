"""The home feed: a Latest section and one section per feed category, and its layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- fixed values ----------------------------------------------------------------------------
LATEST_SIZE, SECTION_SIZE = 10, 6
LATEST_ROWS, SECTION_ROWS, LEAD_CANDIDATES = 5, 3, 4
# ---------------------------------------------------------------------------------------------


def _order() -> list[Column]:
    return [F.col("published_at").desc(), F.col("id").desc()]


def feed_sections(articles: DataFrame, article_categories: DataFrame, categories: DataFrame) -> DataFrame:
    """``(niche_id, section_order, section, rank, id, published_at, image_url)`` of every niche.

    Both parts are per-group top-k: Spark keeps the best rows of each group before the shuffle,
    so a category with a third of all articles costs k rows per task. Empty sections do not
    appear.
    """
    public = articles.filter("status = 'accepted'").select("niche_id", "id", "published_at", "image_url")
    latest = public.withColumns({"section_order": F.lit(-1), "section": F.lit("latest")})
    feed = categories.filter("enabled AND is_feed_section").select(
        F.col("id").alias("category_id"), F.col("sort_order").cast("int").alias("section_order"), F.col("slug").alias("section")
    )
    links = article_categories.join(feed, "category_id").select(
        F.col("article_id").alias("id"), "section_order", "section"
    )

    def top(rows: DataFrame, size: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("niche_id", "section_order", "section").orderBy(*_order()))
        return rows.withColumn("rank", rank).filter(F.col("rank") <= size)

    columns = ["niche_id", "section_order", "section", "rank", "id", "published_at", "image_url"]
    return top(latest, LATEST_SIZE).select(*columns).unionByName(
        top(public.join(links, "id"), SECTION_SIZE).select(*columns)
    )


def home_layout(feed: DataFrame) -> DataFrame:
    """``(niche_id, place, kind, section, id)``: each article once, in its first section.

    The lead is the first Latest article with an image among the first four fresh ones, else the
    newest. A section shows its first rows *after* removing what is already on the page, so the
    sections of a niche are folded in order; a niche has at most 10 + 6 per category rows.
    """
    section = (
        feed.groupBy("niche_id", "section_order", "section")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.col("image_url").isNotNull().alias("pic")))).alias("items"))
    )
    niche = section.groupBy("niche_id").agg(
        F.array_sort(F.collect_list(F.struct("section_order", "section", "items"))).alias("sections")
    )
    row = "array<struct<kind:string,section:string,id:bigint>>"
    empty = F.struct(
        F.array().cast("array<bigint>").alias("shown"), F.array().cast(row).alias("rows")
    )

    def rows_of(items: Column, kind: str, name: Column) -> Column:
        return F.transform(items, lambda i: F.struct(F.lit(kind).alias("kind"), name.alias("section"), i.id.alias("id")))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.filter(s["items"], lambda i: ~F.array_contains(acc.shown, i.id))
        is_latest = s.section == "latest"
        head = F.slice(fresh, 1, LEAD_CANDIDATES)
        pictured = F.filter(head, lambda i: i.pic)
        lead = F.when(F.size(pictured) > 0, F.slice(pictured, 1, 1)).otherwise(F.slice(fresh, 1, 1))
        lead = F.when(is_latest, lead).otherwise(F.slice(fresh, 1, 0))
        lead_ids = F.transform(lead, lambda i: i.id)
        rest = F.filter(fresh, lambda i: ~F.array_contains(lead_ids, i.id))
        stories = F.slice(rest, F.lit(1), F.when(is_latest, LATEST_ROWS).otherwise(SECTION_ROWS))
        return F.struct(
            F.concat(acc.shown, lead_ids, F.transform(stories, lambda i: i.id)).alias("shown"),
            F.concat(acc.rows, rows_of(lead, "featured", s.section), rows_of(stories, "story", s.section)).alias("rows"),
        )

    folded = F.aggregate("sections", empty, step, lambda acc: acc.rows)
    return niche.select("niche_id", F.posexplode(folded).alias("place", "r")).select(
        "niche_id", (F.col("place") + 1).alias("place"), "r.kind", "r.section", "r.id"
    )
