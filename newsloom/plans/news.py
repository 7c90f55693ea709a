"""Reading accepted articles: lists, pages, detail, summaries, review views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import fold_phrase
from newsloom.functions.times import local_day, local_day_bounds
from newsloom.session import materialise

# --- fixed values ----------------------------------------------------------------------------
PAGE_DEFAULT, PAGE_MAX = 20, 50
RELATED_MAX, RELATED_POOL = 5, 20
COVERAGE_MAX = 20
SEARCH_WORDS_MAX = 8
# ---------------------------------------------------------------------------------------------
SUMMARY = ["id", "title", "description", "original_url", "source_name", "source_domain", "published_at", "image_url"]


def public_articles(articles: DataFrame, niche_id: int) -> DataFrame:
    return articles.filter((F.col("niche_id") == niche_id) & (F.col("status") == "accepted"))


def before_cursor(published_at, article_id: int) -> Column:
    """Row comparison ``(published_at, id) < cursor``."""
    t, i = F.lit(published_at).cast("timestamp"), F.lit(article_id)
    return (F.col("published_at") < t) | ((F.col("published_at") == t) & (F.col("id") < i))


def in_category(articles: DataFrame, article_categories: DataFrame, categories: DataFrame, slug: str) -> DataFrame:
    """Articles of one enabled category; nothing for an unknown or disabled one."""
    wanted = categories.filter((F.col("slug") == slug) & F.col("enabled")).select(F.col("id").alias("category_id"))
    members = article_categories.join(wanted, "category_id", "left_semi")
    return articles.join(members.select(F.col("article_id").alias("id")), "id", "left_semi")


def newest(df: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows newest first; planned as a distributed top-k."""
    return df.orderBy(F.col("published_at").desc(), F.col("id").desc()).limit(limit)


def categories_agg(article_categories: DataFrame, categories: DataFrame) -> DataFrame:
    """``(id, categories)``: enabled slugs of each article in display order."""
    shown = categories.filter("enabled").select(F.col("id").alias("category_id"), "slug", "sort_order")
    slugs = F.array_sort(F.collect_list(F.struct("sort_order", "slug")))
    return (
        article_categories.join(shown, "category_id")
        .groupBy(F.col("article_id").alias("id"))
        .agg(F.transform(slugs, lambda s: s.slug).alias("categories"))
    )


def summaries(articles: DataFrame, article_categories: DataFrame, categories: DataFrame) -> DataFrame:
    """Summary columns plus the category slugs; articles without any get an empty array."""
    grouped = categories_agg(article_categories, categories)
    return articles.select(*SUMMARY).join(grouped, "id", "left").withColumn(
        "categories", F.coalesce("categories", F.array().cast("array<string>"))
    )


def news_list(
    articles: DataFrame, article_categories: DataFrame, categories: DataFrame, niche_id: int,
    category: str | None = None, source: str | None = None, start=None, end=None, after: tuple | None = None,
    limit: int = PAGE_DEFAULT,
) -> DataFrame:
    """One page of summaries, newest first, with ``has_more`` on every row.

    Only the supplied filters enter the plan. One row more than the page is fetched to see
    whether another page follows; categories are collected for the page's rows only.
    """
    if not 1 <= limit <= PAGE_MAX:
        raise ValueError(f"limit must be 1 to {PAGE_MAX}")
    rows = public_articles(articles, niche_id)
    if source is not None:
        rows = rows.filter(F.col("source_domain") == source)
    if start is not None:
        rows = rows.filter(F.col("published_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col("published_at") < F.lit(end).cast("timestamp"))
    if after is not None:
        rows = rows.filter(before_cursor(*after))
    if category is not None:
        rows = in_category(rows, article_categories, categories, category)
    found = newest(rows.select(*SUMMARY), limit + 1)
    everyone = Window.partitionBy(F.lit(1))  # at most limit + 1 rows
    order = everyone.orderBy(F.col("published_at").desc(), F.col("id").desc())
    page = (
        found.withColumns({"position": F.row_number().over(order), "has_more": F.count("*").over(everyone) > limit})
        .filter(F.col("position") <= limit)
    )
    links = article_categories.join(F.broadcast(page.select(F.col("id").alias("article_id"))), "article_id", "left_semi")
    grouped = categories_agg(links, categories)
    return page.join(grouped, "id", "left").withColumn(
        "categories", F.coalesce("categories", F.array().cast("array<string>"))
    )


def by_local_day(articles: DataFrame, niche_id: int, day: str) -> DataFrame:
    """Accepted articles of one calendar day in the home time zone (a range on the raw column)."""
    start, end = local_day_bounds(day)
    return public_articles(articles, niche_id).filter((F.col("published_at") >= start) & (F.col("published_at") < end))


def all_pages(articles: DataFrame, limit: int = PAGE_DEFAULT) -> DataFrame:
    """Every article with the page it falls on when reading newest first.

    The global position comes from a range partitioning on the sort key plus the sizes of the
    partitions before, so no task ever holds more than its share and one hot hour is split too.
    """
    order = [F.col("published_at").desc(), F.col("id").desc()]
    parts = materialise(
        articles.select("id", "published_at").repartitionByRange(*order).withColumn("part", F.spark_partition_id()),
        "pages",
    )
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    # One row per partition: the running total is tiny.
    offsets = sizes.select(
        "part", (F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part")) - F.col("n")).alias("before")
    )
    position = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    return parts.join(offsets, "part").select(
        "id", "published_at", F.floor((position - 1) / limit).cast("long").alias("page"),
        ((position - 1) % limit + 1).cast("long").alias("position"),
    )


def title_words(query: str) -> list[str]:
    """Words a headline must contain; an empty list means no word filter."""
    return [w for w in fold_phrase(query).split(" ") if len(w) > 1][:SEARCH_WORDS_MAX]


def title_all_words(articles: DataFrame, query: str) -> DataFrame:
    for word in title_words(query):
        articles = articles.filter(F.contains(F.col("normalized_title"), F.lit(word)))
    return articles


def id_lookup_many(articles: DataFrame, ids: DataFrame) -> DataFrame:
    return articles.join(ids.select("id").distinct(), "id", "left_semi")


def also_reported_by(articles: DataFrame, limit: int = COVERAGE_MAX) -> DataFrame:
    """Earliest copy per other publisher of every accepted article, at most 20 in domain order."""
    heads = articles.filter("status = 'accepted'").select(
        F.col("id").alias("article_id"), F.col("source_domain").alias("own_domain")
    )
    copies = articles.filter(
        "status = 'duplicate' AND quality_status <> 'rejected' AND relevance_status <> 'irrelevant'"
    ).filter(F.col("duplicate_of_id").isNotNull())
    # Reduced per (article, publisher) before the join: a story with millions of copies shuffles
    # one row per publisher and task.
    first = copies.groupBy(F.col("duplicate_of_id").alias("article_id"), "source_domain").agg(
        F.min_by(
            F.struct("id", "title", "original_url", "source_name", "published_at"), F.struct("published_at", "id")
        ).alias("c")
    )
    rank = F.row_number().over(Window.partitionBy("article_id").orderBy("source_domain"))
    return (
        first.join(heads, "article_id")
        .filter(F.col("source_domain") != F.col("own_domain"))
        .withColumn("rank", rank)
        .filter(F.col("rank") <= limit)
        .select("article_id", "rank", "source_domain", "c.*")
    )


def article_detail(
    articles: DataFrame, article_categories: DataFrame, categories: DataFrame, niche_id: int, article_id: int
) -> DataFrame:
    """One accepted article with its categories and other publishers' coverage."""
    one = public_articles(articles, niche_id).filter(F.col("id") == article_id)
    extra = one.select("id", "language", "source_country", "author", "first_seen_at")
    coverage = (
        also_reported_by(articles.filter((F.col("id") == article_id) | (F.col("duplicate_of_id") == article_id)))
        .groupBy(F.col("article_id").alias("id"))
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("source_domain", F.col("id").alias("copy_id"), "title", "original_url", "source_name", "published_at")
                )
            ).alias("also_reported_by")
        )
    )
    links = article_categories.filter(F.col("article_id") == article_id)
    return summaries(one, links, categories).join(extra, "id").join(coverage, "id", "left")


def related_in_category(articles: DataFrame, article_categories: DataFrame, categories: DataFrame, niche_id: int) -> DataFrame:
    """For every article, the five newest others of its main (first) category.

    The newest twenty of each category are a table of at most 20 rows per category, so every
    article only meets one short array.
    """
    public = public_articles(articles, niche_id)
    shown = categories.filter("enabled").select(F.col("id").alias("category_id"), "slug", "sort_order")
    links = article_categories.join(shown, "category_id")
    member = public.select("id", "published_at").join(links.select(F.col("article_id").alias("id"), "slug"), "id")
    rank = F.row_number().over(Window.partitionBy("slug").orderBy(F.col("published_at").desc(), F.col("id").desc()))
    pool = (
        member.withColumn("r", rank).filter(F.col("r") <= RELATED_POOL)
        .groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x.id).alias("pool"))
    )
    main = links.groupBy(F.col("article_id").alias("id")).agg(F.min_by("slug", F.struct("sort_order", "slug")).alias("slug"))
    others = F.slice(F.filter("pool", lambda i: i != F.col("id")), 1, RELATED_MAX)
    return (
        public.select("id").join(main, "id").join(F.broadcast(pool), "slug")
        .select("id", "slug", F.posexplode(others).alias("rank", "related_id"))
        .withColumn("rank", F.col("rank") + 1)
    )


def day_grouped_feed(articles: DataFrame) -> DataFrame:
    """``(niche_id, day, id, kind)``: one heading row per local day, at its newest article.

    Reading newest first, a heading appears exactly where a day's newest article is, so a
    per-day maximum replaces a lag over one global order.
    """
    rows = articles.dropDuplicates(["niche_id", "id"]).withColumn("day", local_day(F.col("published_at")))
    stories = rows.select("niche_id", "day", "id", F.lit("story").alias("kind"))
    headings = rows.groupBy("niche_id", "day").agg(F.max(F.struct("published_at", "id")).alias("m")).select(
        "niche_id", "day", F.col("m.id").alias("id"), F.lit("day").alias("kind")
    )
    return headings.unionByName(stories)


def admin_article_list(
    articles: DataFrame, status: str | None = None, q: str | None = None, before_id: int | None = None, limit: int = 50
) -> DataFrame:
    rows = articles
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if q is not None:
        plain = q.lower().translate({ord(c): None for c in "%_\\"})
        rows = rows.filter(F.contains(F.lower("normalized_title"), F.lit(plain)))
    if before_id is not None:
        rows = rows.filter(F.col("id") < before_id)
    return rows.orderBy(F.col("id").desc()).limit(limit)


#: Copies that a review shows with an article, and a page of ``article_copies``.
COPIES_SHOWN = 20
_COPY = ["id", "title", "source_domain", "original_url", "duplicate_reason", "published_at"]


def review_article_view(articles: DataFrame, article_categories: DataFrame, categories: DataFrame, shown: int = COPIES_SHOWN) -> DataFrame:
    """Each article with its category assignments, the number of its copies and the first ``shown`` of them in id order.

    Spark keeps the first copies of each article per task before the shuffle; a story may have millions, and their
    pages are ``article_copies``.
    """
    names = categories.select(F.col("id").alias("category_id"), "slug")
    assigned = (
        article_categories.join(names, "category_id")
        .groupBy(F.col("article_id").alias("id"))
        .agg(F.array_sort(F.collect_list(F.struct("slug", "score", "assigned_by"))).alias("assigned"))
    )
    linked = articles.filter("duplicate_of_id IS NOT NULL")
    counts = linked.groupBy(F.col("duplicate_of_id").alias("id")).agg(F.count("*").alias("copies"))
    place = F.row_number().over(Window.partitionBy("duplicate_of_id").orderBy("id"))
    lists = (
        linked.select("duplicate_of_id", *_COPY).withColumn("place", place).filter(F.col("place") <= shown)
        .groupBy(F.col("duplicate_of_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*_COPY))).alias("first_copies"))
    )
    return articles.join(assigned, "id", "left").join(counts, "id", "left").join(lists, "id", "left").withColumn(
        "copies", F.coalesce("copies", F.lit(0).cast("long"))
    )


def article_copies(articles: DataFrame, asked: DataFrame | None = None, limit: int = COPIES_SHOWN) -> DataFrame:
    """A page of copies in id order for every asked article: ``asked`` is (article_id, after), ``after`` null for the first page.

    Without ``asked``, the first page of every article that has copies.
    """
    rows = articles.filter("duplicate_of_id IS NOT NULL").select(F.col("duplicate_of_id").alias("article_id"), *_COPY)
    if asked is not None:
        cursor = asked.select("article_id", F.col("after").alias("_after"))
        rows = rows.join(cursor, "article_id").filter(F.col("_after").isNull() | (F.col("id") > F.col("_after"))).drop("_after")
    place = F.row_number().over(Window.partitionBy("article_id").orderBy("id"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit)


def categories_public(categories: DataFrame) -> DataFrame:
    return categories.filter("enabled").orderBy("sort_order", "name")
