"""Lists, pages, detail, feeds and publishers over the stored article table."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import inputs as i
from newsloom.catalog.inputs import sql_stamp, stamp
from newsloom.session import materialise
from newsloom.plans import feed, maintenance, news, stats
from newsloom.functions.times import local_day

QUERIES, ORACLES = {}, {}
W = "WITH " + i.STORED_SQL + "\n"
NEWEST = "published_at DESC, id DESC"


def _stored(spark, sf):
    a = i.articles(spark, sf)
    return a, i.article_categories(a), i.categories(spark)


def _joined(c: str):
    return F.array_join(c, ",")


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("public_articles", W + f"SELECT id, title, {sql_stamp('published_at')} AS published_at FROM articles WHERE niche_id = 1 AND status = 'accepted'")
def _(spark, sf):
    a, _, _ = _stored(spark, sf)
    return news.public_articles(a, 1).select("id", "title", stamp(F.col("published_at")).alias("published_at"))


CATS = """(SELECT string_agg(c.slug, ',' ORDER BY c.sort_order) FROM article_categories ac JOIN categories c
           ON c.id = ac.category_id AND c.enabled WHERE ac.article_id = a.id)"""
LIST_CURSOR = ("2024-01-20 00:00:00", 400)


@query(
    "news_list",
    W + f"""SELECT id, title, source_domain, published_at, categories FROM (
  SELECT a.id, a.title, a.source_domain, {sql_stamp('a.published_at')} AS published_at, coalesce({CATS}, '') AS categories
  FROM articles a WHERE a.niche_id = 1 AND a.status = 'accepted'
    AND EXISTS (SELECT 1 FROM article_categories ac WHERE ac.article_id = a.id
                AND ac.category_id = (SELECT id FROM categories WHERE slug = 'politics' AND enabled))
    AND a.published_at >= TIMESTAMP '2024-01-02' AND a.published_at < TIMESTAMP '2024-02-01'
    AND (a.published_at, a.id) < (TIMESTAMP '{LIST_CURSOR[0]}', {LIST_CURSOR[1]})
  ORDER BY a.published_at DESC, a.id DESC LIMIT 20)""",
)
def _(spark, sf):
    a, ac, c = _stored(spark, sf)
    page = news.news_list(a, ac, c, 1, category="politics", start="2024-01-02", end="2024-02-01", after=LIST_CURSOR, limit=20)
    return page.select("id", "title", "source_domain", stamp(F.col("published_at")).alias("published_at"), _joined("categories").alias("categories"))


@query(
    "page_keyset",
    W + f"""SELECT id, CAST(floor((rn - 1) / 20) AS BIGINT) AS page, (rn - 1) % 20 + 1 AS position FROM (
  SELECT id, row_number() OVER (ORDER BY {NEWEST}) AS rn FROM articles WHERE niche_id = 1 AND status = 'accepted')""",
)
def _(spark, sf):
    a, _, _ = _stored(spark, sf)
    return news.all_pages(news.public_articles(a, 1), 20).select("id", "page", "position")


@query("id_lookup_many", W + "SELECT id, title FROM articles WHERE status = 'accepted' AND id IN (SELECT user_id * 6 + 1 FROM events)")
def _(spark, sf):
    a, _, _ = _stored(spark, sf)
    ids = i.changes(spark, sf).select(F.col("article_id").alias("id"))
    return news.id_lookup_many(a.filter("status = 'accepted'"), ids).select("id", "title")


@query("summary_projection", W + f"SELECT a.id, a.title, a.original_url, a.source_name, a.image_url, {sql_stamp('a.published_at')} AS published_at, coalesce({CATS}, '') AS categories FROM articles a WHERE a.status = 'accepted'")
def _(spark, sf):
    a, ac, c = _stored(spark, sf)
    s = news.summaries(a.filter("status = 'accepted'"), ac, c)
    return s.select("id", "title", "original_url", "source_name", "image_url", stamp(F.col("published_at")).alias("published_at"), _joined("categories").alias("categories"))


@query("categories_agg", W + """SELECT ac.article_id AS id, string_agg(c.slug, ',' ORDER BY c.sort_order) AS categories
FROM article_categories ac JOIN categories c ON c.id = ac.category_id AND c.enabled GROUP BY ac.article_id""")
def _(spark, sf):
    _, ac, c = _stored(spark, sf)
    return news.categories_agg(ac, c).select("id", _joined("categories").alias("categories"))


@query("categories_public", W + "SELECT c.slug, c.name, c.sort_order, count(ac.article_id) AS assigned FROM categories c LEFT JOIN article_categories ac ON ac.category_id = c.id WHERE c.enabled GROUP BY ALL")
def _(spark, sf):
    _, ac, c = _stored(spark, sf)
    n = ac.groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("assigned"))
    shown = news.categories_public(c).join(n, "id", "left")
    return shown.select("slug", "name", F.col("sort_order").cast("int").alias("sort_order"), F.coalesce("assigned", F.lit(0).cast("long")).alias("assigned"))


@query("by_ist_day", W + f"""SELECT strftime(published_at + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, count(*) AS n, min(id) AS first_id, max(id) AS last_id
FROM articles WHERE status = 'accepted' GROUP BY 1""")
def _(spark, sf):
    a, _, _ = _stored(spark, sf)
    day = F.date_format(local_day(F.col("published_at")), "yyyy-MM-dd").alias("day")
    return a.filter("status = 'accepted'").groupBy(day).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("by_ist_day_range", W + f"""SELECT id, {sql_stamp('published_at')} AS published_at FROM articles WHERE status = 'accepted'
AND published_at >= TIMESTAMP '2024-01-09 18:30:00' AND published_at < TIMESTAMP '2024-01-10 18:30:00'""")
def _(spark, sf):
    a, _, _ = _stored(spark, sf)
    return news.by_local_day(a, 1, "2024-01-10").select("id", stamp(F.col("published_at")).alias("published_at"))


@query("title_all_words", W + "SELECT id, title FROM articles WHERE status = 'accepted' AND normalized_title LIKE '%the%' AND normalized_title LIKE '%and%' AND normalized_title LIKE '%tion%'")
def _(spark, sf):
    a, _, _ = _stored(spark, sf)
    return news.title_all_words(a.filter("status = 'accepted'"), "The and, TION!").select("id", "title")


@query("admin_article_list", W + "SELECT id, title, status FROM articles WHERE status = 'pending_review' AND normalized_title LIKE '%th%' AND id < 900 ORDER BY id DESC LIMIT 50")
def _(spark, sf):
    a, _, _ = _stored(spark, sf)
    return news.admin_article_list(a, "pending_review", "TH%", 900).select("id", "title", "status")


@query(
    "also_reported_by",
    W + f"""SELECT article_id, rank, source_domain, id, {sql_stamp('published_at')} AS published_at FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY source_domain) AS rank FROM (
    SELECT d.duplicate_of_id AS article_id, d.source_domain, d.id, d.published_at,
           row_number() OVER (PARTITION BY d.duplicate_of_id, d.source_domain ORDER BY d.published_at, d.id) AS k
    FROM articles d JOIN articles r ON r.id = d.duplicate_of_id AND r.status = 'accepted'
    WHERE d.status = 'duplicate' AND d.source_domain <> r.source_domain AND d.quality_status <> 'rejected'
      AND d.relevance_status <> 'irrelevant') WHERE k = 1) WHERE rank <= 20""",
)
def _(spark, sf):
    a, _, _ = _stored(spark, sf)
    r = news.also_reported_by(a)
    return r.select("article_id", F.col("rank").cast("long").alias("rank"), "source_domain", "id", stamp(F.col("published_at")).alias("published_at"))


@query(
    "article_detail",
    W + f"""SELECT a.id, a.title, a.language, {sql_stamp('a.first_seen_at')} AS first_seen_at, coalesce({CATS}, '') AS categories,
  coalesce((SELECT string_agg(source_domain || ':' || cid, ',' ORDER BY source_domain) FROM (
     SELECT source_domain, cid FROM (
       SELECT d.source_domain, d.id AS cid, row_number() OVER (PARTITION BY d.source_domain ORDER BY d.published_at, d.id) AS k
       FROM articles d WHERE d.duplicate_of_id = a.id AND d.status = 'duplicate' AND d.source_domain <> a.source_domain
         AND d.quality_status <> 'rejected' AND d.relevance_status <> 'irrelevant') WHERE k = 1
     ORDER BY source_domain LIMIT 20)), '') AS coverage
FROM articles a WHERE a.id = 12 AND a.status = 'accepted'""",
)
def _(spark, sf):
    a, ac, c = _stored(spark, sf)
    d = news.article_detail(a, ac, c, 1, 12)
    pairs = F.transform("also_reported_by", lambda x: F.concat_ws(":", x.source_domain, x.copy_id.cast("string")))
    return d.select(
        "id", "title", "language", stamp(F.col("first_seen_at")).alias("first_seen_at"), _joined("categories").alias("categories"),
        F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("coverage"),
    )


@query(
    "review_article_view",
    W + """SELECT a.id, a.status,
  coalesce((SELECT string_agg(c.slug || ':' || ac.assigned_by, ',' ORDER BY c.slug) FROM article_categories ac JOIN categories c ON c.id = ac.category_id
            WHERE ac.article_id = a.id), '') AS assigned,
  (SELECT count(*) FROM articles d WHERE d.duplicate_of_id = a.id) AS copies,
  coalesce((SELECT string_agg(x.id || ' ' || x.source_domain || ' ' || x.original_url || ' ' || x.title, '|' ORDER BY x.id)
    FROM (SELECT *, row_number() OVER (PARTITION BY duplicate_of_id ORDER BY id) AS k FROM articles WHERE duplicate_of_id IS NOT NULL) x
    WHERE x.duplicate_of_id = a.id AND x.k <= 3), '') AS first_copies FROM articles a""",
)
def _(spark, sf):
    a, ac, c = _stored(spark, sf)
    v = news.review_article_view(a, ac, c, shown=3)
    pairs = F.transform("assigned", lambda x: F.concat_ws(":", x.slug, x.assigned_by))
    listed = F.transform("first_copies", lambda x: F.concat_ws(" ", x.id.cast("string"), x.source_domain, x.original_url, x.title))
    return v.select("id", "status", F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("assigned"), "copies",
                    F.coalesce(F.array_join(listed, "|"), F.lit("")).alias("first_copies"))


@query(
    "article_copies",
    W + """SELECT duplicate_of_id AS article_id, (k - 1) // 2 + 1 AS page, (k - 1) % 2 + 1 AS place, id, title FROM (
  SELECT *, row_number() OVER (PARTITION BY duplicate_of_id ORDER BY id) AS k FROM articles WHERE duplicate_of_id IS NOT NULL) WHERE k <= 6""",
)
def _(spark, sf):
    """Three pages of two copies for every article that has copies, each from where the one before ended."""
    a = _stored(spark, sf)[0]
    rows, asked = None, None
    for number in (1, 2, 3):
        page = materialise(news.article_copies(a, asked, 2), "copies")
        asked = page.groupBy("article_id").agg(F.max("id").alias("after"))
        part = page.select("article_id", F.lit(number).cast("long").alias("page"), F.col("place").cast("long").alias("place"), "id", "title")
        rows = part if rows is None else rows.unionByName(part)
    return rows


FEED = [(s[1], s[3]) for s in i.CATEGORY_ROWS if s[4] and s[5]]
SECTIONS_SQL = f"""feed AS (
  SELECT niche_id, -1 AS section_order, 'latest' AS section, rank, id, image_url FROM (
    SELECT *, row_number() OVER (PARTITION BY niche_id ORDER BY {NEWEST}) AS rank FROM articles WHERE status = 'accepted') WHERE rank <= 10
  UNION ALL
  SELECT niche_id, sort_order, slug, rank, id, image_url FROM (
    SELECT a.niche_id, c.sort_order, c.slug, a.id, a.image_url,
           row_number() OVER (PARTITION BY a.niche_id, c.slug ORDER BY a.published_at DESC, a.id DESC) AS rank
    FROM articles a JOIN article_categories ac ON ac.article_id = a.id
    JOIN categories c ON c.id = ac.category_id AND c.enabled AND c.is_feed_section
    WHERE a.status = 'accepted') WHERE rank <= 6)"""


@query("feed_sections", W + ", " + SECTIONS_SQL + " SELECT niche_id, section, rank, id FROM feed")
def _(spark, sf):
    f = feed.feed_sections(*_stored(spark, sf))
    return f.select(F.col("niche_id").cast("int").alias("niche_id"), "section", F.col("rank").cast("long").alias("rank"), "id")


def _layout_sql() -> str:
    """One CTE per section: what is left after the earlier ones, then its first rows."""
    ctes = [
        "lead AS (SELECT niche_id, id FROM (SELECT *, row_number() OVER (PARTITION BY niche_id ORDER BY CASE WHEN image_url IS NOT NULL AND rank <= 4 THEN 0 ELSE 1 END, rank) AS k FROM feed WHERE section = 'latest') WHERE k = 1)",
        "p0 AS (SELECT niche_id, 'latest' AS section, id, k FROM (SELECT *, row_number() OVER (PARTITION BY niche_id ORDER BY rank) AS k FROM feed WHERE section = 'latest' AND id NOT IN (SELECT id FROM lead)) WHERE k <= 5)",
    ]
    shown = "SELECT niche_id, id FROM lead UNION ALL SELECT niche_id, id FROM p0"
    for n, (slug, _) in enumerate(FEED, 1):
        ctes.append(
            f"p{n} AS (SELECT niche_id, section, id, k FROM (SELECT f.*, row_number() OVER (PARTITION BY niche_id ORDER BY rank) AS k FROM feed f "
            f"WHERE section = '{slug}' AND (niche_id, id) NOT IN ({shown})) WHERE k <= 3)"
        )
        shown += f" UNION ALL SELECT niche_id, id FROM p{n}"
    parts = " UNION ALL ".join(f"SELECT niche_id, {n} AS part, 'story' AS kind, section, id, k FROM p{n}" for n in range(len(FEED) + 1))
    return (
        ", ".join(ctes)
        + f", allrows AS (SELECT niche_id, -1 AS part, 'featured' AS kind, 'latest' AS section, id, 1 AS k FROM lead UNION ALL {parts}) "
        "SELECT niche_id, row_number() OVER (PARTITION BY niche_id ORDER BY part, k) AS place, kind, section, id FROM allrows"
    )


@query("home_layout", W + ", " + SECTIONS_SQL + ", " + _layout_sql())
def _(spark, sf):
    rows = feed.home_layout(feed.feed_sections(*_stored(spark, sf)))
    return rows.select(F.col("niche_id").cast("int").alias("niche_id"), F.col("place").cast("long").alias("place"), "kind", "section", "id")


@query(
    "day_grouped_feed",
    W + f""", days AS (SELECT id, published_at, strftime(published_at + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day FROM articles WHERE status = 'accepted'),
flagged AS (SELECT *, lag(day) OVER (ORDER BY {NEWEST}) AS prev FROM days)
SELECT day, id, 'story' AS kind FROM days UNION ALL SELECT day, id, 'day' AS kind FROM flagged WHERE prev IS NULL OR prev <> day""",
)
def _(spark, sf):
    a, _, _ = _stored(spark, sf)
    return news.day_grouped_feed(news.public_articles(a, 1)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "id", "kind")


@query(
    "related_in_category",
    W + """, pub AS (SELECT * FROM articles WHERE status = 'accepted'),
main AS (SELECT article_id AS id, slug FROM (SELECT ac.article_id, c.slug, row_number() OVER (PARTITION BY ac.article_id ORDER BY c.sort_order) AS k
   FROM article_categories ac JOIN categories c ON c.id = ac.category_id AND c.enabled) WHERE k = 1),
pool AS (SELECT * FROM (SELECT c.slug, p.id AS related_id, row_number() OVER (PARTITION BY c.slug ORDER BY p.published_at DESC, p.id DESC) AS r
   FROM pub p JOIN article_categories ac ON ac.article_id = p.id JOIN categories c ON c.id = ac.category_id AND c.enabled) WHERE r <= 20)
SELECT * FROM (SELECT p.id, m.slug, row_number() OVER (PARTITION BY p.id ORDER BY r) AS rank, related_id
  FROM pub p JOIN main m ON m.id = p.id JOIN pool ON pool.slug = m.slug AND related_id <> p.id) WHERE rank <= 5""",
)
def _(spark, sf):
    r = news.related_in_category(*_stored(spark, sf), 1)
    return r.select("id", "slug", F.col("rank").cast("long").alias("rank"), "related_id")


@query("articles_by_status", W + "SELECT status, count(*) AS n FROM articles GROUP BY 1")
def _(spark, sf):
    return stats.articles_by_status(i.articles(spark, sf))


@query("status_counts_wide", W + """SELECT count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'pending_review') AS pending_review,
count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'duplicate') AS duplicate FROM articles""")
def _(spark, sf):
    return stats.status_counts_wide(i.articles(spark, sf))


@query("sources_public", W + """SELECT s.domain, s.name, s.country, s.homepage_url, count(a.id) AS article_count FROM sources s
JOIN articles a ON a.source_id = s.id AND a.status = 'accepted' WHERE s.status <> 'blocked' GROUP BY ALL ORDER BY article_count DESC, s.name LIMIT 500""")
def _(spark, sf):
    return stats.sources_public(i.sources(spark, sf), i.articles(spark, sf), 1)


@query("sources_admin", W + """SELECT s.id, s.domain, s.status, s.trust_weight, (SELECT count(*) FROM articles a WHERE a.source_id = s.id AND a.status = 'accepted') AS accepted_articles
FROM sources s ORDER BY s.domain LIMIT 2000""")
def _(spark, sf):
    return stats.sources_admin(i.sources(spark, sf), i.articles(spark, sf)).select("id", "domain", "status", "trust_weight", "accepted_articles")


@query("source_rename", W + """SELECT a.id, coalesce(r.name, a.source_name) AS source_name FROM articles a
LEFT JOIN (SELECT id AS source_id, 'Renamed ' || country AS name FROM sources WHERE status = 'trusted' AND country IS NOT NULL) r ON r.source_id = a.source_id""")
def _(spark, sf):
    s = i.sources(spark, sf).filter("status = 'trusted' AND country IS NOT NULL")
    renames = s.select(F.col("id").alias("source_id"), F.concat(F.lit("Renamed "), "country").alias("name"))
    return maintenance.source_rename(i.articles(spark, sf), renames).select("id", "source_name")


@query("category_replace", W + """, computed AS (SELECT id AS article_id, 1 AS category_id, 3.0 AS score FROM articles WHERE status = 'accepted'),
processed AS (SELECT id AS article_id, manual_categories FROM articles WHERE status <> 'rejected'),
manual AS (SELECT * FROM article_categories WHERE assigned_by = 'manual')
SELECT article_id, category_id, score, assigned_by FROM manual
UNION ALL SELECT article_id, category_id, score, assigned_by FROM article_categories WHERE assigned_by = 'rule'
  AND article_id NOT IN (SELECT article_id FROM processed WHERE NOT manual_categories)
UNION ALL SELECT c.article_id, c.category_id, c.score, 'rule' FROM computed c JOIN processed p ON p.article_id = c.article_id AND NOT p.manual_categories
  WHERE NOT EXISTS (SELECT 1 FROM manual m WHERE m.article_id = c.article_id AND m.category_id = c.category_id)""")
def _(spark, sf):
    a, ac, _ = _stored(spark, sf)
    computed = a.filter("status = 'accepted'").select(F.col("id").alias("article_id"), F.lit(1).cast("smallint").alias("category_id"), F.lit(3.0).alias("score"))
    processed = a.filter("status <> 'rejected'").select(F.col("id").alias("article_id"), "manual_categories")
    return maintenance.category_replace(ac, computed, processed).withColumn("category_id", F.col("category_id").cast("int"))
