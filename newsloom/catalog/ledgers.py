"""Runs, change feed, backfills, retention and bookmarks, read from the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.catalog import inputs as i
from newsloom.catalog.inputs import sql_stamp, stamp
from newsloom.functions import times
from newsloom.plans import backfill, bookmarks, indexing, maintenance, stats
from newsloom.plans.store import Store, Table, by_hash
from newsloom.session import scratch_dir

QUERIES, ORACLES = {}, {}
RUNS = "WITH " + i.RUNS_SQL + "\n"
CHANGES = "WITH " + i.CHANGES_SQL + "\n"
BACKFILLS = "WITH " + i.BACKFILLS_SQL + "\n"
STORED = "WITH " + i.STORED_SQL + ", " + i.CHANGES_SQL + "\n"


def now_column():
    return F.col("now")



def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _runs(spark, sf):
    return i.with_now(i.runs(spark, sf))


@query("runs_24h", RUNS + "SELECT provider, status, count(*) AS n FROM runs, clock WHERE started_at > now - INTERVAL 24 HOUR GROUP BY ALL")
def _(spark, sf):
    return stats.runs_24h(_runs(spark, sf), now_column())


@query("run_outcomes_24h", RUNS + "".join(
    f"{'UNION ALL ' if k else ''}SELECT '{c}' AS outcome, CAST(coalesce(sum({c}), 0) AS BIGINT) AS n FROM runs, clock WHERE started_at > now - INTERVAL 24 HOUR "
    for k, c in enumerate(stats.OUTCOMES)))
def _(spark, sf):
    return stats.run_outcomes(_runs(spark, sf), now_column())


@query("ingestion_summary", RUNS + """SELECT provider, kind, count(*) AS runs, count(*) FILTER (WHERE status = 'failed') AS failed,
CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(pending) AS BIGINT) AS pending, CAST(sum(rejected) AS BIGINT) AS rejected,
CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(sum(existing) AS BIGINT) AS existing, round(avg(duration_ms)) AS avg_duration_ms
FROM runs, clock WHERE started_at > now - INTERVAL 24 HOUR GROUP BY ALL""")
def _(spark, sf):
    return stats.ingestion_summary(_runs(spark, sf), now_column())


@query("last_success_age", RUNS + """SELECT coalesce(epoch_us(max(now)) - epoch_us(max(finished_at)), -1000000) / 1000000.0 AS age_seconds
FROM runs, (SELECT max(finished_at) AS now FROM runs) WHERE status = 'succeeded' AND kind = 'scheduled'""")
def _(spark, sf):
    runs = i.runs(spark, sf)
    good = i.with_now(runs, "finished_at").filter("status = 'succeeded' AND kind = 'scheduled'")
    # ``now`` is the ledger's own last instant, so it travels with the rows.
    return good.agg(F.max("finished_at").alias("last"), F.max("now").alias("now")).select(
        F.coalesce(times.seconds_between(now_column(), F.col("last")), F.lit(-1.0)).alias("age_seconds")
    )


@query("run_history", RUNS + ", " + i.CONFIG_SQL + f"""SELECT r.id, r.provider, r.status, q.name AS query_name, {sql_stamp('r.started_at')} AS started_at
FROM runs r LEFT JOIN queries q ON q.id = r.query_id WHERE r.status = 'failed' ORDER BY r.id DESC LIMIT 100""")
def _(spark, sf):
    h = stats.run_history(i.runs(spark, sf), i.queries(spark), "failed", 100)
    return h.select("id", "provider", "status", "query_name", stamp(F.col("started_at")).alias("started_at"))


@query("outbox_status", CHANGES + f"""SELECT count(*) FILTER (WHERE attempts < 10) AS pending, count(*) FILTER (WHERE attempts >= 10) AS failed,
{sql_stamp('min(created_at)')} AS oldest FROM changes WHERE processed_at IS NULL""")
def _(spark, sf):
    s = stats.outbox_status(i.changes(spark, sf))
    return s.select("pending", "failed", stamp(F.col("oldest")).alias("oldest"))


@query("outbox_retry", CHANGES + """SELECT CASE WHEN processed_at IS NULL AND attempts >= 10 THEN 0 ELSE attempts END AS attempts,
processed_at IS NULL AS open, count(*) AS n, count(CASE WHEN NOT (processed_at IS NULL AND attempts >= 10) THEN last_error END) AS errors FROM changes GROUP BY 1, 2""")
def _(spark, sf):
    r = indexing.outbox_retry(i.changes(spark, sf))
    return r.groupBy(F.col("attempts").cast("int").alias("attempts"), F.col("processed_at").isNull().alias("open")).agg(
        F.count("*").alias("n"), F.count("last_error").alias("errors"))


DOCS = """, docs AS (SELECT a.id, 'main' AS niche, a.title, a.source_domain, a.language, a.relevance_score, a.original_url AS url, a.published_at,
  coalesce((SELECT string_agg(c.slug, ',' ORDER BY c.sort_order) FROM article_categories ac JOIN categories c
            ON c.id = ac.category_id AND c.enabled WHERE ac.article_id = a.id), '') AS categories
  FROM articles a WHERE a.status = 'accepted')
"""


def _docs(spark, sf, **retention):
    a = i.articles(spark, sf)
    return indexing.search_documents(a, i.niches(spark), i.article_categories(a), i.categories(spark), **retention)


def _doc_columns(d):
    return d.select("id", "niche", "title", "source_domain", "language", "relevance_score", "url", stamp(F.col("published_at")).alias("published_at"),
                    F.array_join("categories", ",").alias("categories"))


DOC_COLS = f"id, niche, title, source_domain, language, relevance_score, url, {sql_stamp('published_at')} AS published_at, categories"


@query("sink_search_docs", STORED + DOCS + f"SELECT {DOC_COLS} FROM docs WHERE published_at >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY")
def _(spark, sf):
    now = F.lit("2024-02-15").cast("timestamp")
    return _doc_columns(_docs(spark, sf, now=now, retention_days=30))


@query("rebuild_index", STORED + DOCS + f"""SELECT 'doc' AS part, id, categories AS detail FROM docs
UNION ALL SELECT 'replay', id, CAST(article_id AS VARCHAR) FROM changes WHERE id > (SELECT CAST(max(id) / 2 AS BIGINT) FROM changes)""")
def _(spark, sf):
    ch = i.changes(spark, sf)
    middle = ch.agg(F.round(F.max("id") / 2).cast("long")).first()[0]
    docs, replay = indexing.rebuild_index(_docs(spark, sf), ch, middle)
    return docs.select(F.lit("doc").alias("part"), "id", F.array_join("categories", ",").alias("detail")).unionByName(
        replay.select(F.lit("replay").alias("part"), "id", F.col("article_id").cast("string").alias("detail")))


WANTED = ", wanted AS (SELECT DISTINCT article_id AS id FROM changes WHERE processed_at IS NULL AND attempts < 10)\n"


@query("outbox_project", STORED + DOCS + WANTED + f"SELECT {DOC_COLS} FROM docs WHERE id IN (SELECT id FROM wanted)")
def _(spark, sf):
    upserts, _ = indexing.outbox_project(i.changes(spark, sf), _docs(spark, sf))
    return _doc_columns(upserts)


@query("outbox_deletes", STORED + DOCS + WANTED + "SELECT id FROM wanted WHERE id NOT IN (SELECT id FROM docs)")
def _(spark, sf):
    return indexing.outbox_project(i.changes(spark, sf), _docs(spark, sf))[1]


@query("index_drift", STORED + """, indexed AS (SELECT DISTINCT article_id AS id FROM changes), acc AS (SELECT id FROM articles WHERE status = 'accepted')
SELECT (SELECT count(*) FROM acc) AS accepted, (SELECT count(*) FROM indexed) AS indexed,
(SELECT count(*) FROM acc WHERE id NOT IN (SELECT id FROM indexed)) AS missing, (SELECT count(*) FROM indexed WHERE id NOT IN (SELECT id FROM acc)) AS stale""")
def _(spark, sf):
    indexed = i.changes(spark, sf).select(F.col("article_id").alias("id")).distinct()
    return stats.index_drift(i.articles(spark, sf), indexed)


@query("sources_upsert", STORED + """, seen AS (SELECT source_domain AS domain, CASE WHEN id % 3 = 0 THEN 'Land ' || (id % 4) END AS country, id AS arrival FROM articles),
known AS (SELECT * FROM sources WHERE status <> 'trusted'),
f AS (SELECT domain, arg_min(country, arrival) FILTER (WHERE country IS NOT NULL) AS seen_country FROM seen GROUP BY domain)
SELECT coalesce(k.domain, f.domain) AS domain, coalesce(k.name, f.domain) AS name, coalesce(k.country, f.seen_country) AS country,
coalesce(k.status, 'active') AS status, coalesce(k.trust_weight, 0.0) AS trust_weight FROM known k FULL JOIN f ON f.domain = k.domain""")
def _(spark, sf):
    known = i.sources(spark, sf).filter("status <> 'trusted'")
    seen = i.articles(spark, sf).select(
        F.col("source_domain").alias("domain"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("Land "), (F.col("id") % 4).cast("string"))).alias("country"),
        F.col("id").alias("arrival"))
    return maintenance.sources_upsert(known, seen).select("domain", "name", "country", "status", "trust_weight")


CLOCK = "TIMESTAMP '2024-03-10'"


RETENTION_SQL = STORED + ", " + i.RUNS_SQL + ", " + i.BACKFILLS_SQL + ", " + i.AUDIT_SQL + f"""
, gone AS (SELECT 'rejected' AS class, 'articles' AS t, id FROM articles WHERE status = 'rejected' AND manual_status IS NULL AND created_at < {CLOCK} - INTERVAL 30 DAY
    AND id NOT IN (SELECT duplicate_of_id FROM articles WHERE duplicate_of_id IS NOT NULL)
  UNION ALL SELECT 'duplicates', 'articles', id FROM articles WHERE status = 'duplicate' AND manual_status IS NULL AND created_at < {CLOCK} - INTERVAL 60 DAY
  UNION ALL SELECT 'changes', 'changes', id FROM changes WHERE processed_at < {CLOCK} - INTERVAL 7 DAY
  UNION ALL SELECT 'runs', 'runs', id FROM runs WHERE started_at < {CLOCK} - INTERVAL 90 DAY
  UNION ALL SELECT 'slices', 'slices', id FROM slices WHERE status IN ('done', 'skipped')
    AND backfill_id IN (SELECT id FROM backfills WHERE status IN ('completed', 'cancelled') AND completed_at < {CLOCK} - INTERVAL 30 DAY)
  UNION ALL SELECT 'dead_letters', 'dead_letters', id FROM dead_letters WHERE resolved_at < {CLOCK} - INTERVAL 30 DAY
  UNION ALL SELECT 'audit', 'audit', id FROM audit WHERE created_at < {CLOCK} - INTERVAL 365 DAY),
classes AS (SELECT unnest(['rejected', 'duplicates', 'changes', 'runs', 'slices', 'dead_letters', 'audit']) AS class),
held AS (SELECT 'articles' AS t, id FROM articles UNION ALL SELECT 'changes', id FROM changes UNION ALL SELECT 'runs', id FROM runs UNION ALL SELECT 'slices', id FROM slices
  UNION ALL SELECT 'dead_letters', id FROM dead_letters UNION ALL SELECT 'audit', id FROM audit)
"""


def retained_tables(spark, sf):
    make = {"articles": i.articles, "changes": i.changes, "runs": i.runs, "slices": i.slices, "dead_letters": i.dead_letters, "audit": i.audit}
    return {name: make[name](spark, sf) for name in maintenance.RETAINED}


@query("retention", RETENTION_SQL + f"""SELECT class, (SELECT count(*) FROM gone g WHERE g.class = c.class) AS n FROM classes c
UNION ALL SELECT 'provider_metadata', count(*) FROM articles WHERE created_at < {CLOCK} - INTERVAL 30 DAY""")
def _(spark, sf):
    now = F.lit("2024-03-10").cast("timestamp")
    return maintenance.retention_counts(retained_tables(spark, sf), i.backfills(spark, sf), now)


@query("retention_applied", RETENTION_SQL + f"""SELECT t AS name, id, t = 'articles' AND NOT (SELECT a.created_at < {CLOCK} - INTERVAL 30 DAY FROM articles a WHERE a.id = h.id) AS has_metadata
FROM held h WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.t = h.t AND g.id = h.id)""")
def _(spark, sf):
    """Six tables stored in buckets, one retention run over them, delivered twice; every row that is left."""
    now = F.lit("2024-03-10").cast("timestamp")
    tables = retained_tables(spark, sf)
    kept = Store(spark, f"{scratch_dir(spark)}/newsloom-retained-{uuid.uuid4().hex}", {name: Table(df.schema, ("id",), by_hash("id")) for name, df in tables.items()})
    kept.commit(0, lambda: tables)
    for _ in range(2):
        maintenance.apply_retention(kept, 1, i.backfills(spark, sf), now)
    rows = None
    for name in maintenance.RETAINED:
        left = kept.current(name)
        metadata = F.col("provider_metadata").isNotNull() if name == "articles" else F.lit(False)
        part = left.select(F.lit(name).alias("name"), "id", metadata.alias("has_metadata"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("retained_articles", STORED + f"""SELECT id, status, NOT created_at < {CLOCK} - INTERVAL 30 DAY AS has_metadata FROM articles a
WHERE NOT (status = 'duplicate' AND manual_status IS NULL AND created_at < {CLOCK} - INTERVAL 60 DAY)
AND NOT (status = 'rejected' AND manual_status IS NULL AND created_at < {CLOCK} - INTERVAL 30 DAY
         AND NOT EXISTS (SELECT 1 FROM articles d WHERE d.duplicate_of_id = a.id))""")
def _(spark, sf):
    now = F.lit("2024-03-10").cast("timestamp")
    kept = maintenance.retained_articles(i.articles(spark, sf), now)
    return kept.select("id", "status", F.col("provider_metadata").isNotNull().alias("has_metadata"))


@query("retained_slices", BACKFILLS + """SELECT s.backfill_id, s.status, count(*) AS n FROM slices s WHERE NOT (s.status IN ('done', 'skipped') AND s.backfill_id IN (
SELECT id FROM backfills WHERE status IN ('completed', 'cancelled') AND completed_at < TIMESTAMP '2024-02-20' - INTERVAL 30 DAY)) GROUP BY ALL""")
def _(spark, sf):
    now = F.lit("2024-02-20").cast("timestamp")
    kept = maintenance.retained_slices(i.slices(spark, sf), i.backfills(spark, sf), now)
    return kept.groupBy("backfill_id", "status").agg(F.count("*").alias("n"))


# --- windows and slots -----------------------------------------------------------------------

@query("parse_feed_timestamp", f"""SELECT event_id, {sql_stamp('ts')} AS parsed, {sql_stamp("time_bucket(INTERVAL 15 MINUTE, ts)")} AS slot FROM events""")
def _(spark, sf):
    e = i.table(spark, sf, "events")
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).when(k == 1, F.date_format("ts", "yyyyMMddHHmmss")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    parsed = e.select("event_id", times.parse_feed_timestamp(text).alias("t"))
    return parsed.select("event_id", stamp(F.col("t")).alias("parsed"), stamp(times.slot_start(F.col("t"))).alias("slot"))


@query("overlap_windows", """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM (
SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS s FROM events, range(6) AS r(k)) GROUP BY 1""")
def _(spark, sf):
    return backfill.overlap_windows(i.table(spark, sf, "events")).select(stamp(F.col("start")).alias("window_start"), "n")


@query("cycle_bucket", RUNS + f"""SELECT query_id, {sql_stamp("time_bucket(INTERVAL 30 MINUTE, started_at)")} AS cycle, count(*) AS runs, count(*) > 1 AS repeated FROM runs GROUP BY 1, 2""")
def _(spark, sf):
    return stats.cycle_buckets(i.runs(spark, sf)).withColumn("cycle", stamp(F.col("cycle")))


@query("split_full_windows", "WITH s AS (SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS e FROM events), "
       "g AS (SELECT e, unnest([10800, 5400, 2700, 1350]) AS seconds FROM s) "
       "SELECT strftime(make_timestamp((e // seconds) * seconds * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, seconds, count(*) AS n, seconds <= 1800 AS truncated "
       "FROM g GROUP BY e // seconds, seconds HAVING count(*) >= 25")
def _(spark, sf):
    w = backfill.split_full_windows(i.table(spark, sf, "events"), "ts", 25)
    return w.withColumn("window_start", stamp(F.col("window_start")))


@query("gkg_slots", BACKFILLS + f"""SELECT id AS backfill_id, {sql_stamp('s')} AS slice_start, {sql_stamp('s + INTERVAL 15 MINUTE')} AS slice_end FROM (
SELECT id, range_end, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, range_start), range_end, INTERVAL 15 MINUTE)) AS s FROM backfills) WHERE s < range_end""")
def _(spark, sf):
    s = backfill.gkg_slots(i.backfills(spark, sf).select(F.col("id").alias("backfill_id"), "range_start", "range_end"))
    return s.select("backfill_id", stamp(F.col("slice_start")).alias("slice_start"), stamp(F.col("slice_end")).alias("slice_end"))


PLAN = ", " + i.CONFIG_SQL + f""", nowt AS (SELECT TIMESTAMP '2024-04-05' AS now),
r AS (SELECT id, niche_id, strategy, range_start, least(range_end, now) AS range_end, now FROM backfills, nowt),
plan AS (
  SELECT id AS backfill_id, 'gdelt-gkg' AS provider, NULL AS query_id, s AS slice_start, s + INTERVAL 15 MINUTE AS slice_end FROM (
    SELECT id, range_end, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, range_start), range_end, INTERVAL 15 MINUTE)) AS s
    FROM r WHERE strategy <> 'doc') WHERE s < range_end
  UNION ALL
  SELECT d.id, 'gdelt-doc', q.id, s, least(s + INTERVAL 1 DAY, range_end) FROM (
    SELECT id, niche_id, range_end, unnest(generate_series(f, range_end, INTERVAL 1 DAY)) AS s FROM (
      SELECT *, CASE WHEN strategy = 'doc' THEN range_start ELSE greatest(range_start, now - INTERVAL 85 DAY) END AS f
      FROM r WHERE strategy <> 'gkg') WHERE f < range_end) d
  JOIN queries q ON q.niche_id = d.niche_id AND q.enabled WHERE s < range_end)
"""


def _plan(spark, sf):
    return backfill.backfill_plan(i.backfills(spark, sf), i.queries(spark), F.lit("2024-04-05").cast("timestamp"))


@query("backfill_plan", BACKFILLS + PLAN + f"SELECT backfill_id, provider, query_id, {sql_stamp('slice_start')} AS slice_start, {sql_stamp('slice_end')} AS slice_end FROM plan")
def _(spark, sf):
    p = _plan(spark, sf)
    return p.select("backfill_id", "provider", "query_id", stamp(F.col("slice_start")).alias("slice_start"), stamp(F.col("slice_end")).alias("slice_end"))


@query("slot_gaps", BACKFILLS + PLAN + f""", landed AS (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS slice_start FROM events WHERE value < 8)
SELECT backfill_id, {sql_stamp('slice_start')} AS slice_start FROM plan p WHERE provider = 'gdelt-gkg'
AND NOT EXISTS (SELECT 1 FROM landed l WHERE l.slice_start = p.slice_start)""")
def _(spark, sf):
    landed = i.table(spark, sf, "events").filter("value < 8").select(
        F.lit("gdelt-gkg").alias("provider"), F.lit(None).cast("int").alias("query_id"), times.slot_start(F.col("ts")).alias("slice_start")).distinct()
    gaps = backfill.slot_gaps(_plan(spark, sf).filter("provider = 'gdelt-gkg'"), landed)
    return gaps.select("backfill_id", stamp(F.col("slice_start")).alias("slice_start"))


@query("backfill_progress", BACKFILLS + """SELECT b.id, b.strategy, count(s.id) FILTER (WHERE s.status = 'done') AS done, count(s.id) FILTER (WHERE s.status = 'skipped') AS skipped,
count(s.id) FILTER (WHERE s.status = 'failed') AS failed, count(s.id) FILTER (WHERE s.status IN ('pending', 'running')) AS remaining,
CAST(coalesce(sum(s.matched), 0) AS BIGINT) AS matched FROM backfills b LEFT JOIN slices s ON s.backfill_id = b.id GROUP BY ALL""")
def _(spark, sf):
    p = backfill.backfill_progress(i.backfills(spark, sf), i.slices(spark, sf))
    return p.select("id", "strategy", "done", "skipped", "failed", "remaining", "matched")


@query("slice_rollup", BACKFILLS + """SELECT b.id, CASE WHEN b.status = 'running' AND NOT EXISTS (SELECT 1 FROM slices s WHERE s.backfill_id = b.id AND s.status IN ('pending', 'running'))
THEN CASE WHEN EXISTS (SELECT 1 FROM slices s WHERE s.backfill_id = b.id AND s.status = 'failed') THEN 'failed' ELSE 'completed' END ELSE b.status END AS status FROM backfills b""")
def _(spark, sf):
    return backfill.slice_rollup(i.backfills(spark, sf), i.slices(spark, sf)).select("id", "status")


@query("resumable_backfills", BACKFILLS + """SELECT DISTINCT s.backfill_id FROM slices s JOIN backfills b ON b.id = s.backfill_id
WHERE s.status = 'failed' AND s.attempts - 25 < 40 AND b.status IN ('running', 'failed')""")
def _(spark, sf):
    s = i.slices(spark, sf).withColumn("attempts", (F.col("attempts") - 25).cast("smallint"))
    return backfill.resumable(s, i.backfills(spark, sf))


@query("slice_state", """WITH ev AS (SELECT user_id AS slice_id, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'cancel' ELSE CASE WHEN value < 10 THEN 'throttled' ELSE 'retry' END END AS event FROM events),
last_e AS (SELECT slice_id, arg_max(event, seq) AS e, max(seq) AS s FROM ev WHERE event <> 'cancel' GROUP BY 1),
last_c AS (SELECT slice_id, max(seq) AS c FROM ev WHERE event = 'cancel' GROUP BY 1),
n AS (SELECT slice_id, count(*) FILTER (WHERE event = 'start') - count(*) FILTER (WHERE event = 'throttled') AS a FROM ev GROUP BY 1)
SELECT n.slice_id, CASE WHEN coalesce(c > coalesce(s, -1), false) AND coalesce(e, 'retry') IN ('retry', 'throttled', 'failed') THEN 'skipped'
  ELSE CASE coalesce(e, 'retry') WHEN 'start' THEN 'running' WHEN 'done' THEN 'done' WHEN 'failed' THEN 'failed' ELSE 'pending' END END AS status,
greatest(a, 0) AS attempts FROM n LEFT JOIN last_e USING (slice_id) LEFT JOIN last_c USING (slice_id)""")
def _(spark, sf):
    kind = F.col("event_type")
    event = F.when(kind == "view", "start").when(kind == "click", "done").when(kind == "error", "failed").when(kind == "purchase", "cancel").when(
        F.col("value") < 10, "throttled").otherwise("retry")
    ev = i.table(spark, sf, "events").select(F.col("user_id").alias("slice_id"), F.col("event_id").alias("seq"), event.alias("event"))
    return backfill.slice_state(ev)


@query("batch_counts", """SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'view') AS accepted, count(*) FILTER (WHERE event_type = 'click') AS pending,
count(*) FILTER (WHERE event_type = 'error') AS rejected, count(*) FILTER (WHERE event_type = 'signup') AS duplicates,
count(*) FILTER (WHERE event_type = 'purchase' AND value < 20) AS existing, count(*) FILTER (WHERE event_type = 'purchase' AND value >= 20) AS invalid FROM events GROUP BY 1""")
def _(spark, sf):
    kind = F.col("event_type")
    outcome = F.when(kind == "view", "accepted").when(kind == "click", "pending_review").when(kind == "error", "rejected").when(
        kind == "signup", "duplicate").when(F.col("value") < 20, "existing").otherwise("invalid")
    return stats.batch_counts(i.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), outcome.alias("outcome")))


# --- set operations and users ----------------------------------------------------------------

@query("query_ids_merge", RUNS + """SELECT k.run_key, string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY query_id) AS query_ids FROM (
SELECT DISTINCT r.duration_ms % 100 AS run_key, query_id FROM runs r WHERE query_id IN (1, 2, 3, 4)) k GROUP BY 1""")
def _(spark, sf):
    known = i.queries(spark).select(F.col("id").alias("query_id"))
    r = i.runs(spark, sf).join(F.broadcast(known), "query_id", "left_semi")
    merged = r.groupBy((F.col("duration_ms") % 100).alias("run_key")).agg(F.array_sort(F.collect_set("query_id")).alias("ids"))
    return merged.select("run_key", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("query_ids"))


@query("bookmark_count", "WITH " + i.bookmarks_sql("b") + " SELECT user_id, count(*) AS n, greatest(5000 - count(*), 0) AS room FROM b GROUP BY 1")
def _(spark, sf):
    return bookmarks.bookmark_count(i.bookmarks(spark, sf))


@query("bookmarks_page", STORED + ", " + i.bookmarks_sql("b") + f"""SELECT user_id, article_id, title, rank, {sql_stamp('created_at')} AS created_at FROM (
SELECT b.*, a.title, row_number() OVER (PARTITION BY user_id ORDER BY b.created_at DESC, article_id DESC) AS rank
FROM b JOIN articles a ON a.id = b.article_id AND a.status = 'accepted' WHERE (b.created_at, b.article_id) < (TIMESTAMP '2024-01-25', 0)) WHERE rank <= 5""")
def _(spark, sf):
    p = bookmarks.bookmarks_page(i.bookmarks(spark, sf), i.articles(spark, sf), 5, ("2024-01-25", 0))
    return p.select("user_id", "article_id", "title", F.col("rank").cast("long").alias("rank"), stamp(F.col("created_at")).alias("created_at"))


@query("bookmark_merge", STORED + ", " + i.bookmarks_sql("server") + ", " + i.bookmarks_sql("device", "signup") + ", " + i.bookmarks_sql("removed", "error") + f""",
kept AS (SELECT * FROM server s WHERE NOT EXISTS (SELECT 1 FROM removed r WHERE r.user_id = s.user_id AND r.article_id = s.article_id)),
m AS (SELECT coalesce(d.user_id, k.user_id) AS user_id, coalesce(d.article_id, k.article_id) AS article_id, coalesce(d.created_at, k.created_at) AS created_at,
  CASE WHEN d.user_id IS NOT NULL THEN 'device' ELSE 'server' END AS origin, k.user_id IS NOT NULL AS had
  FROM device d FULL JOIN kept k ON k.user_id = d.user_id AND k.article_id = d.article_id)
SELECT user_id, article_id, {sql_stamp('created_at')} AS created_at, origin,
  had OR article_id IN (SELECT id FROM articles WHERE status = 'accepted') AS stored FROM m""")
def _(spark, sf):
    m = bookmarks.bookmark_merge(i.bookmarks(spark, sf), i.bookmarks(spark, sf, "signup"), i.bookmarks(spark, sf, "error"), i.articles(spark, sf))
    return m.select("user_id", "article_id", stamp(F.col("created_at")).alias("created_at"), "origin", "stored")


@query("recent_searches", """WITH log AS (SELECT conv_id % 20 AS user_id, conv_id * 1000 + turn AS seq, trim(text) AS q FROM conversations WHERE role = 'user'),
d AS (SELECT user_id, lower(q) AS k, max(seq) AS seq, arg_max(q, seq) AS q FROM log WHERE length(q) >= 2 GROUP BY 1, 2)
SELECT user_id, rank, q FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rank FROM d) WHERE rank <= 8""")
def _(spark, sf):
    log = i.table(spark, sf, "conversations").filter("role = 'user'").select(
        (F.col("conv_id") % 20).alias("user_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("q"))
    return bookmarks.recent_searches(log).withColumn("rank", F.col("rank").cast("long"))
