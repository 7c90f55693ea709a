"""The given tables seen as candidates, stored articles and ledgers, in Spark and in SQL.

Each view exists twice: as a DataFrame function and as a DuckDB CTE of the same name, so a query
and its oracle start from the same rows by independent code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import schemas
from newsloom.functions import text as t
from newsloom.session import use_utc

BASE_TIME = "2024-01-01 00:00:00"
_LONG_TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    use_utc(spark)
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return spread(df) if name in _LONG_TEXTS else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the scan has fewer tasks than cores.

    A given table is one file of one row group, hence one task however long its texts are. At
    scale a scan has more tasks than cores and is left alone: no shuffle is added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stamp(c: Column) -> Column:
    """Timestamps leave the queries as text, so no time zone or precision rule can differ."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def hours_after_base(n: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(BASE_TIME).cast("timestamp")) + n * 3600)


# --- DuckDB text macros ----------------------------------------------------------------------

_NAMED = "MAP {" + ", ".join(
    "'{}': '{}'".format(k, v.replace("'", "''")) for k, v in t.NAMED_ENTITIES.items()
) + "}"
_CODE = "regexp_extract(p, '^(#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z]+);', 1)"


def sql_decode(x: str) -> str:
    """One-pass entity decoding, written with DuckDB list functions."""
    number = (
        f"CASE WHEN regexp_matches({_CODE}, '^#[xX]0*[0-9a-fA-F]{{1,6}}$') "
        f"THEN CAST('0x' || regexp_extract({_CODE}, '^#[xX]0*([0-9a-fA-F]{{1,6}})$', 1) AS INTEGER) "
        f"WHEN regexp_matches({_CODE}, '^#0*[0-9]{{1,7}}$') THEN CAST(regexp_extract({_CODE}, '^#0*([0-9]{{1,7}})$', 1) AS INTEGER) END"
    )
    piece = (
        f"CASE WHEN {_CODE} LIKE '#%' THEN CASE WHEN ({number}) BETWEEN 1 AND 1114111 AND NOT ({number}) BETWEEN 55296 AND 57343 "
        f"THEN chr({number}) || substr(p, length({_CODE}) + 2) ELSE '&' || p END "
        f"WHEN {_NAMED}[lower({_CODE})] IS NOT NULL THEN {_NAMED}[lower({_CODE})] || substr(p, length({_CODE}) + 2) "
        f"ELSE '&' || p END"
    )
    return (
        f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {piece} END), '')"
    )


def sql_match(x: str, decode: bool = False) -> str:
    inner = sql_decode(x) if decode else x
    lowered = f"lower(strip_accents(coalesce({inner}, '')))"
    no_s = f"regexp_replace({lowered}, '[''’]s\\b', '', 'g')"
    return f"trim(regexp_replace({no_s}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


# --- candidates ------------------------------------------------------------------------------

def page_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages as provider candidates: link texts are the entities, one page per hour."""
    pages = table(spark, sf, "pages")
    links = F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    return pages.select(
        F.lit("gdelt-doc").alias("provider"),
        F.lit(None).cast("string").alias("provider_ref"),
        "url",
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("image_url"),
        F.lit(None).cast("string").alias("source_domain"),
        F.when(F.col("page_id") % 2 == 0, "India").alias("source_country"),
        F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("language"),
        F.lit(None).cast("string").alias("author"),
        F.date_format(hours_after_base(F.col("page_id")), "yyyyMMddHHmmss").alias("published_at"),
        F.array_join(links, " ; ").alias("entities"),
        F.when(F.col("page_id") % 4 != 0, (F.col("page_id") % 4).cast("int")).alias("matched_query_id"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
        F.lit(1).cast("smallint").alias("niche_id"),
        (F.col("page_id") % 10).alias("run_id"),
        F.col("page_id").alias("arrival"),
    )


PAGES_SQL = f"""
page_cand AS (
  SELECT page_id AS arrival, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
         CASE WHEN page_id % 2 = 0 THEN 'India' END AS source_country,
         regexp_extract(html, '<html lang="([a-z]*)"', 1) AS language,
         TIMESTAMP '{BASE_TIME}' + to_hours(page_id) AS published_at,
         array_to_string(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1), ' ; ') AS entities,
         CASE WHEN page_id % 4 <> 0 THEN CAST(page_id % 4 AS INTEGER) END AS matched_query_id,
         page_id % 10 AS run_id
  FROM pages)"""


def doc_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as unscored articles: headline = first line, description = the whole rest."""
    d = table(spark, sf, "documents")
    first = F.substring_index("text", "\n", 1)
    return d.select(
        (F.col("doc_id") + 1).alias("id"),
        F.lit(1).cast("smallint").alias("niche_id"),
        first.alias("title"),
        F.substring(F.col("text"), F.length(first) + 2, F.length("text")).alias("description"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/the-story/"), F.col("doc_id").cast("string")).alias("original_url"),
        F.concat_ws(" ; ", "source", F.substring_index(first, ".", 1), F.substring_index(first, " ", 2)).alias("entities"),
        "lang",
        "source",
        "n_chars",
        hours_after_base(F.col("doc_id")).alias("published_at"),
        F.array_compact(
            F.array(
                F.when(F.col("doc_id") % 3 == 0, F.lit(1)), F.when(F.col("doc_id") % 5 == 0, F.lit(2)),
                F.when(F.col("doc_id") % 7 == 0, F.lit(9)),
            )
        ).alias("matched_query_ids"),
    )


DOCS_SQL = f"""
doc_art AS (
  SELECT doc_id + 1 AS id, split_part(text, chr(10), 1) AS title,
         substr(text, length(split_part(text, chr(10), 1)) + 2) AS description,
         'https://' || source || '.example.org/' || lang || '/the-story/' || doc_id AS original_url,
         source || ' ; ' || split_part(split_part(text, chr(10), 1), '.', 1) || ' ; ' ||
           regexp_extract(split_part(text, chr(10), 1), '^[^ ]*( [^ ]*)?', 0) AS entities,
         lang, source, n_chars, doc_id,
         TIMESTAMP '{BASE_TIME}' + to_hours(doc_id) AS published_at
  FROM documents)"""


# --- configuration tables (rules are data) ---------------------------------------------------

CATEGORY_ROWS = [
    (1, "politics", "Politics", 10, True, True, 1.0),
    (2, "economy", "Economy", 20, True, True, 2.0),
    (3, "health", "Health", 30, True, True, 2.0),
    (4, "culture", "Culture", 40, True, True, 1.0),
    (5, "sports", "Sports", 50, False, True, 3.0),
    (6, "archive", "Archive", 60, True, False, 1.0),
    (7, "general", "General", 200, False, True, 1.0),
]
# (id, category_id, rule_type, pattern, fields, weight, enabled)
CATEGORY_RULE_ROWS = [
    (1, 1, "phrase", "the", ["title", "description", "url"], 1.0, True),
    (2, 1, "phrase", "of", ["title"], 0.5, True),
    (3, 2, "phrase", "and", ["title", "description"], 1.0, True),
    (4, 2, "phrase", "by the", ["title", "description"], 1.5, True),
    (5, 3, "phrase", "der", ["title"], 1.0, True),
    (6, 3, "regex", "(die|und) [a-z]+", ["title", "description"], 1.25, True),
    (7, 4, "phrase", "de la", ["title", "description"], 1.0, True),
    (8, 4, "phrase", "fr", ["url"], 1.0, True),
    (9, 5, "regex", "th[aeiou]nd", ["title"], 2.0, True),
    (10, 6, "phrase", "the", ["title"], 5.0, True),
    (11, 1, "phrase", "that", ["title"], 4.0, False),
]
QUERY_ROWS = [
    (1, 1, "first", True, 35.0), (2, 1, "second", True, 25.0), (3, 1, "third", False, 20.0), (4, 2, "other", True, 10.0),
]


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORY_ROWS, schemas.CATEGORY)


def category_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORY_RULE_ROWS, schemas.CATEGORY_RULE)


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERY_ROWS, "id INT, niche_id SMALLINT, name STRING, enabled BOOLEAN, weight DOUBLE")


def niches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "main")], "id SMALLINT, slug STRING")


def _values(rows) -> str:
    def lit(v) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        return "'" + v + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


CONFIG_SQL = f"""
categories AS (SELECT * FROM (VALUES {_values(CATEGORY_ROWS)})
  AS c(id, slug, name, sort_order, is_feed_section, enabled, min_score)),
queries AS (SELECT * FROM (VALUES {_values(QUERY_ROWS)}) AS q(id, niche_id, name, enabled, weight))"""


# --- stored articles -------------------------------------------------------------------------

def sources(spark: SparkSession, sf: str) -> DataFrame:
    """One publisher per document source; country from the nation table."""
    number = F.substring(F.col("source"), F.lit(4), F.length("source")).cast("int")
    nation = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("id"), F.initcap("n_name").alias("country"))
    distinct = table(spark, sf, "documents").select("source").distinct().withColumn("id", number + 1)
    return distinct.join(nation, "id", "left").select(
        "id", F.concat("source", F.lit(".example.org")).alias("domain"), F.concat(F.lit("Source "), "id").alias("name"), "country",
        F.when(F.col("id") % 7 == 0, "blocked").when(F.col("id") % 5 == 0, "trusted").otherwise("active").alias("status"),
        F.when(F.col("id") % 5 == 0, 5.0).otherwise(0.0).alias("trust_weight"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/")).alias("homepage_url"),
    )


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a stored article table: labels decide the status, repeated headlines are copies."""
    d = doc_articles(spark, sf)
    labels = table(spark, sf, "labels").select((F.col("doc_id") + 1).alias("id"), "quality", "toxic")
    judged = d.join(labels, "id", "left").withColumn(
        "own_status",
        F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 0, "pending_review").otherwise("accepted"),
    )
    # Aggregated before the join: a headline shared by a third of all rows is one row per task.
    heads = judged.filter("own_status <> 'rejected'").groupBy("title").agg(F.min("id").alias("head"))
    copy = (F.col("own_status") != "rejected") & (F.col("head") < F.col("id"))
    number = F.substring(F.col("source"), F.lit(4), F.length("source")).cast("int") + 1
    score = F.col("n_chars") % 10000 / 100.0
    seen = F.col("published_at") + F.expr("INTERVAL 30 MINUTES")
    return judged.join(heads, "title", "left").select(
        "id", "niche_id", number.alias("source_id"), F.concat(F.lit("Source "), number).alias("source_name"),
        F.concat("source", F.lit(".example.org")).alias("source_domain"), F.lit(None).cast("string").alias("source_country"),
        "title", t.match_text(F.col("title")).alias("normalized_title"), "description", "original_url",
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://img.example.org/"), F.col("id").cast("string"), F.lit(".jpg"))).alias("image_url"),
        F.col("lang").alias("language"), F.lit(None).cast("string").alias("author"), "published_at",
        seen.alias("first_seen_at"), seen.alias("created_at"),
        F.when(copy, "duplicate").otherwise(F.col("own_status")).alias("status"),
        score.alias("relevance_score"),
        F.when(score >= 20, "relevant").when(score >= 10, "review").otherwise("irrelevant").alias("relevance_status"),
        F.when(F.col("quality") == 0, "pending_review").otherwise("accepted").alias("quality_status"),
        F.when(copy, F.col("head")).alias("duplicate_of_id"),
        F.when(copy, "syndicated_same_title:1").alias("duplicate_reason"),
        F.when(F.col("id") % 11 == 0, "accepted").alias("manual_status"),
        (F.col("id") % 13 == 0).alias("manual_categories"),
        "matched_query_ids", F.create_map(F.lit("source"), F.col("source")).alias("provider_metadata"),
    )


ARTICLES_SQL = f"""{DOCS_SQL},
judged AS (
  SELECT d.*, l.quality, l.toxic,
         CASE WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 0 THEN 'pending_review' ELSE 'accepted' END AS own_status
  FROM doc_art d LEFT JOIN labels l ON l.doc_id = d.doc_id),
heads AS (SELECT title, min(id) AS head FROM judged WHERE own_status <> 'rejected' GROUP BY title),
articles AS (
  SELECT j.id, 1 AS niche_id, CAST(substr(source, 4) AS INTEGER) + 1 AS source_id,
         'Source ' || (CAST(substr(source, 4) AS INTEGER) + 1) AS source_name, source || '.example.org' AS source_domain,
         j.title, {sql_match('j.title', True)} AS normalized_title, description, original_url,
         CASE WHEN j.id % 3 = 0 THEN 'https://img.example.org/' || j.id || '.jpg' END AS image_url,
         lang AS language, published_at, published_at + INTERVAL 30 MINUTE AS first_seen_at,
         published_at + INTERVAL 30 MINUTE AS created_at,
         CASE WHEN own_status <> 'rejected' AND head < j.id THEN 'duplicate' ELSE own_status END AS status,
         (n_chars % 10000) / 100.0 AS relevance_score,
         CASE WHEN (n_chars % 10000) / 100.0 >= 20 THEN 'relevant' WHEN (n_chars % 10000) / 100.0 >= 10 THEN 'review'
              ELSE 'irrelevant' END AS relevance_status,
         CASE WHEN quality = 0 THEN 'pending_review' ELSE 'accepted' END AS quality_status,
         CASE WHEN own_status <> 'rejected' AND head < j.id THEN head END AS duplicate_of_id,
         CASE WHEN j.id % 11 = 0 THEN 'accepted' END AS manual_status, j.id % 13 = 0 AS manual_categories
  FROM judged j LEFT JOIN heads h ON h.title = j.title)"""

ASSIGNED_WORDS = [(1, "the"), (2, "and"), (3, "of"), (4, "de"), (5, "that"), (6, "by"), (7, "in")]


def article_categories(stored: DataFrame) -> DataFrame:
    """Stored assignments: one row per category whose word the headline contains."""
    words = stored.sparkSession.createDataFrame(ASSIGNED_WORDS, "category_id SMALLINT, word STRING")
    tokens = stored.select(F.col("id").alias("article_id"), F.explode(F.array_distinct(t.words(F.col("normalized_title")))).alias("word"))
    return tokens.join(words, "word").select(
        "article_id", "category_id", F.lit(2.0).alias("score"),
        F.when(F.col("article_id") % 9 == 0, "manual").otherwise("rule").alias("assigned_by"),
    )


STORED_SQL = f"""{ARTICLES_SQL}, {CONFIG_SQL},
article_categories AS (
  SELECT a.id AS article_id, w.category_id, 2.0 AS score, CASE WHEN a.id % 9 = 0 THEN 'manual' ELSE 'rule' END AS assigned_by
  FROM articles a JOIN (VALUES {_values(ASSIGNED_WORDS)}) AS w(category_id, word)
    ON contains(' ' || a.normalized_title || ' ', ' ' || w.word || ' ')),
sources AS (
  SELECT s.id, s.source || '.example.org' AS domain, 'Source ' || s.id AS name,
         upper(substr(n.n_name, 1, 1)) || lower(substr(n.n_name, 2)) AS country,
         CASE WHEN s.id % 7 = 0 THEN 'blocked' WHEN s.id % 5 = 0 THEN 'trusted' ELSE 'active' END AS status,
         CASE WHEN s.id % 5 = 0 THEN 5.0 ELSE 0.0 END AS trust_weight,
         'https://' || s.source || '.example.org/' AS homepage_url
  FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) + 1 AS id FROM documents) s
  LEFT JOIN nation n ON n.n_nationkey + 1 = s.id)"""


# --- ledgers from events ---------------------------------------------------------------------

def runs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    fetched = F.floor("value").cast("int")
    kind = F.when(F.col("event_type") == "purchase", "backfill").when(F.col("event_type") == "error", "manual").otherwise("scheduled")
    return e.select(
        (F.col("event_id") + 1).alias("id"), F.lit(1).cast("smallint").alias("niche_id"),
        F.when(F.col("user_id") % 5 != 0, (F.col("user_id") % 5).cast("int")).alias("query_id"), kind.alias("kind"),
        F.when(F.col("event_type").isin("click", "view"), "gdelt-doc").otherwise("gdelt-gkg").alias("provider"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("value") >= 5, "succeeded").otherwise("running").alias("status"),
        fetched.alias("fetched"), F.floor(F.col("value") / 2).cast("int").alias("accepted"),
        F.floor(F.col("value") / 4).cast("int").alias("pending"), F.floor(F.col("value") / 8).cast("int").alias("rejected"),
        F.floor(F.col("value") / 16).cast("int").alias("duplicates"), F.floor(F.col("value") / 32).cast("int").alias("existing"),
        F.floor(F.col("value") / 64).cast("int").alias("invalid"),
        F.col("ts").alias("started_at"),
        F.timestamp_micros(F.unix_micros("ts") + fetched.cast("long") * 1000000).alias("finished_at"),
        F.floor(F.col("value") * 1000).cast("int").alias("duration_ms"),
    )


RUNS_SQL = """
runs AS (
  SELECT event_id + 1 AS id, CASE WHEN user_id % 5 <> 0 THEN CAST(user_id % 5 AS INTEGER) END AS query_id,
         CASE event_type WHEN 'purchase' THEN 'backfill' WHEN 'error' THEN 'manual' ELSE 'scheduled' END AS kind,
         CASE WHEN event_type IN ('click', 'view') THEN 'gdelt-doc' ELSE 'gdelt-gkg' END AS provider,
         CASE WHEN event_type = 'error' THEN 'failed' WHEN value >= 5 THEN 'succeeded' ELSE 'running' END AS status,
         CAST(floor(value) AS INTEGER) AS fetched, CAST(floor(value / 2) AS INTEGER) AS accepted,
         CAST(floor(value / 4) AS INTEGER) AS pending, CAST(floor(value / 8) AS INTEGER) AS rejected,
         CAST(floor(value / 16) AS INTEGER) AS duplicates, CAST(floor(value / 32) AS INTEGER) AS existing,
         CAST(floor(value / 64) AS INTEGER) AS invalid,
         ts AS started_at, ts + to_seconds(CAST(floor(value) AS INTEGER)) AS finished_at,
         CAST(floor(value * 1000) AS INTEGER) AS duration_ms
  FROM events),
clock AS (SELECT max(started_at) AS now FROM runs)"""


def latest(runs_df: DataFrame, column: str = "started_at") -> DataFrame:
    """Cross-joinable single row with the ledger's last instant as ``now``."""
    return runs_df.agg(F.max(column).alias("now"))


def with_now(df: DataFrame, column: str = "started_at") -> DataFrame:
    """Adds the table's own last instant as ``now``: a one-row aggregate, broadcast."""
    return df.join(F.broadcast(latest(df, column)), F.lit(True))


def changes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        (F.col("event_id") + 1).alias("id"), (F.col("user_id") * 6 + 1).alias("article_id"), F.col("ts").alias("created_at"),
        F.when(F.col("event_type").isin("purchase", "signup", "error"), F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("processed_at"),
        F.least(F.floor(F.col("value") / 5), F.lit(12)).cast("smallint").alias("attempts"),
        F.when(F.col("value") >= 50, "rejected by mapping").alias("last_error"),
    )


CHANGES_SQL = """
changes AS (
  SELECT event_id + 1 AS id, user_id * 6 + 1 AS article_id, ts AS created_at,
         CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN ts + INTERVAL 1 HOUR END AS processed_at,
         CAST(least(floor(value / 5), 12) AS SMALLINT) AS attempts,
         CASE WHEN value >= 50 THEN 'rejected by mapping' END AS last_error
  FROM events)"""


def bookmarks(spark: SparkSession, sf: str, kind: str = "purchase") -> DataFrame:
    """Events of one type as bookmarks: the first time a user marked an article."""
    e = table(spark, sf, "events").filter(F.col("event_type") == kind)
    return e.groupBy("user_id", F.floor(F.col("value") * 10 + 1).cast("long").alias("article_id")).agg(F.min("ts").alias("created_at"))


def bookmarks_sql(name: str, kind: str = "purchase") -> str:
    return f"""
{name} AS (SELECT user_id, CAST(floor(value * 10 + 1) AS BIGINT) AS article_id, min(ts) AS created_at
  FROM events WHERE event_type = '{kind}' GROUP BY ALL)"""


def backfills(spark: SparkSession, sf: str) -> DataFrame:
    """One backfill per local week of events and per event type."""
    e = table(spark, sf, "events")
    week = F.date_trunc("week", "ts")
    g = e.groupBy("event_type", week.alias("week")).agg(F.min("ts").alias("range_start"), F.max("ts").alias("range_end"), F.count("*").alias("n"))
    number = F.datediff("week", F.lit("2023-12-25")) / 7
    code = F.array_position(F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"])), F.col("event_type"))
    return g.select(
        (number * 10 + code).cast("int").alias("id"), F.lit(1).cast("smallint").alias("niche_id"), "range_start", "range_end",
        F.when(code == 1, "doc").when(code == 2, "gkg").otherwise("auto").alias("strategy"),
        F.when(code == 5, "cancelled").otherwise("running").alias("status"),
        F.col("range_end").alias("completed_at"),
    )


def slices(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    code = F.array_position(F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"])), F.col("event_type"))
    number = F.datediff(F.date_trunc("week", "ts"), F.lit("2023-12-25")) / 7
    status = F.when(F.col("value") >= 60, "failed").when(F.col("value") >= 40, "skipped").when(
        (F.col("value") < 0.05) & (F.col("user_id") % 2 == 0), "pending"
    ).otherwise("done")
    return e.select(
        (F.col("event_id") + 1).alias("id"), (number * 10 + code).cast("int").alias("backfill_id"), F.lit("gdelt-gkg").alias("provider"),
        F.lit(None).cast("int").alias("query_id"), F.col("ts").alias("slice_start"), status.alias("status"),
        F.least(F.floor("value"), F.lit(60)).cast("smallint").alias("attempts"), F.floor("value").cast("int").alias("matched"),
    )


BACKFILLS_SQL = """
coded AS (SELECT *, CAST(date_diff('day', DATE '2023-12-25', CAST(date_trunc('week', ts) AS DATE)) / 7 * 10 +
                         list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS INTEGER) AS backfill_id,
                 list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS code FROM events),
backfills AS (
  SELECT backfill_id AS id, 1 AS niche_id, min(ts) AS range_start, max(ts) AS range_end,
         CASE code WHEN 1 THEN 'doc' WHEN 2 THEN 'gkg' ELSE 'auto' END AS strategy,
         CASE code WHEN 5 THEN 'cancelled' ELSE 'running' END AS status, max(ts) AS completed_at
  FROM coded GROUP BY backfill_id, code),
slices AS (
  SELECT event_id + 1 AS id, backfill_id, ts AS slice_start,
         CASE WHEN value >= 60 THEN 'failed' WHEN value >= 40 THEN 'skipped'
              WHEN value < 0.05 AND user_id % 2 = 0 THEN 'pending' ELSE 'done' END AS status,
         CAST(least(floor(value), 60) AS SMALLINT) AS attempts, CAST(floor(value) AS INTEGER) AS matched
  FROM coded)"""


def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Failed events as given-up jobs; those of some users are resolved a day later."""
    e = table(spark, sf, "events").filter("event_type = 'error'")
    return e.select((F.col("event_id") + 1).alias("id"), F.lit("ingest").alias("queue"), F.col("ts").alias("failed_at"),
                    F.when(F.col("user_id") % 3 > 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("resolved_at"))


def audit(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases and signups as administrative acts, set back by their value in weeks."""
    e = table(spark, sf, "events").filter("event_type IN ('purchase', 'signup')")
    back = F.timestamp_seconds(F.unix_timestamp("ts") - F.floor("value") * 7 * 86400)
    return e.select((F.col("event_id") + 1).alias("id"), F.col("event_type").alias("action"), back.alias("created_at"))


AUDIT_SQL = """
dead_letters AS (SELECT event_id + 1 AS id, CASE WHEN user_id % 3 > 0 THEN ts + INTERVAL 1 DAY END AS resolved_at FROM events WHERE event_type = 'error'),
audit AS (SELECT event_id + 1 AS id, date_trunc('second', ts) - to_days(CAST(floor(value) AS INTEGER) * 7) AS created_at FROM events WHERE event_type IN ('purchase', 'signup'))"""
