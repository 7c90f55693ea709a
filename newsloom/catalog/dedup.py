"""Duplicate detection over the documents and a reworded copy of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import inputs as i
from newsloom.catalog.inputs import sql_match
from newsloom.catalog.texts import sql_truncate
from newsloom.functions import text as t
from newsloom.operators import dedup

QUERIES, ORACLES = {}, {}
ANCHOR = r"\band\b"


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def headlines(spark, sf):
    """Provisional articles: each document, and later a syndicated rewording of its headline."""
    d = i.doc_articles(spark, sf)
    k = F.col("id") % 6
    again = d.withColumns(
        {
            "title": F.when(k == 0, F.concat("title", F.lit(" 7"))).when(k == 1, F.concat("title", F.lit(" again"))).when(k == 2, F.concat(F.lit("And "), "title"))
            .when(k == 3, F.regexp_replace("title", "^[^ ]* ", "")).when(k == 4, F.concat("title", F.lit(" 12 x"))).otherwise(F.col("title")),
            "id": F.col("id") + 10000000,
            "source": F.when(k == 5, F.col("source")).otherwise("wire"),
            "published_at": F.col("published_at") + F.expr("INTERVAL 5 HOURS"),
        }
    )
    # Headlines have the length the normaliser gives them.
    headline = t.truncate_words(F.col("title"), t.TITLE_MAX)
    both = d.unionByName(again).withColumn("normalized_title", t.match_text(headline))
    return both.select(
        "id", "niche_id", "normalized_title", t.sha256_hex(F.col("normalized_title")).alias("title_hash"),
        F.concat("source", F.lit(".example.org")).alias("source_domain"), "published_at",
        F.when(F.col("id") % 4 == 0, "pending_review").otherwise("accepted").alias("status"),
    )


ROWS_SQL = f"""WITH RECURSIVE {i.DOCS_SQL},
again AS (SELECT id + 10000000 AS id, CASE id % 6 WHEN 0 THEN title || ' 7' WHEN 1 THEN title || ' again' WHEN 2 THEN 'And ' || title
    WHEN 3 THEN regexp_replace(title, '^[^ ]* ', '') WHEN 4 THEN title || ' 12 x' ELSE title END AS title,
  CASE WHEN id % 6 = 5 THEN source ELSE 'wire' END AS source, published_at + INTERVAL 5 HOUR AS published_at FROM doc_art),
h AS (SELECT id, {sql_match(sql_truncate(300, 'title'), True)} AS nt, source || '.example.org' AS dom, published_at AS ts, CASE WHEN id % 4 = 0 THEN 'pending_review' ELSE 'accepted' END AS status
  FROM (SELECT id, title, source, published_at FROM doc_art UNION ALL SELECT * FROM again)),
g AS (SELECT *, list_distinct(flatten(list_transform(list_filter(string_split(nt, ' '), lambda w: w <> ''),
    lambda w: list_transform(range(1, length(w) + 2), lambda k: substr('  ' || w || ' ', k, 3))))) AS tri,
  array_to_string(list_sort(list_distinct(regexp_extract_all(nt, '\\b[0-9]+\\b'))), ' ') AS nums, regexp_matches(nt, '{ANCHOR}') AS anch FROM h)
"""
_SIM = "CAST(len(list_intersect(a.tri, b.tri)) / nullif(len(a.tri) + len(b.tri) - len(list_intersect(a.tri, b.tri)), 0) AS FLOAT)"
_OK = "NOT (a.nums <> '' AND b.nums <> '' AND a.nums <> b.nums) AND NOT (a.anch AND NOT b.anch)"
PAIRS_SQL = ROWS_SQL + f""", raw AS (SELECT a.id, b.id AS y, a.nt = b.nt AS exact, CASE WHEN a.nt = b.nt THEN 1.0::FLOAT ELSE coalesce({_SIM}, 0) END AS sim, {_OK} AS guard,
    a.dom, b.dom AS ydom, a.status, b.status AS ystatus, length(a.nt) AS len
  FROM g a JOIN g b ON b.id < a.id AND b.ts BETWEEN a.ts - INTERVAL 36 HOUR AND a.ts + INTERVAL 36 HOUR AND (b.status = 'accepted' OR a.status = 'pending_review')
    AND (a.nt = b.nt OR (len(a.tri) >= 0.75 * len(b.tri) AND len(b.tri) >= 0.75 * len(a.tri)))),
edges AS (SELECT *, exact OR guard AS ok FROM raw WHERE exact OR (sim >= 0.75 AND len >= 30))
"""


def _greedy(edges: str) -> str:
    """Sequential reading: rows with candidates in id order, carrying the copies found so far."""
    return f""", per AS (SELECT id, row_number() OVER (ORDER BY id) AS k, list({{'y': y, 'ok': ok, 'exact': exact, 'sim': sim, 'same': dom = ydom, 'ys': ystatus}} ORDER BY exact DESC, sim DESC, y) AS es
  FROM {edges} GROUP BY id),
st AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS dups
  UNION ALL SELECT p.k, CASE WHEN len(list_filter(list_filter(p.es, lambda e: NOT list_contains(s.dups, e.y))[1:5], lambda e: e.ok)) > 0 THEN list_append(s.dups, p.id) ELSE s.dups END
  FROM st s JOIN per p ON p.k = s.k + 1),
fin AS (SELECT dups FROM st ORDER BY k DESC LIMIT 1),
top AS (SELECT p.id, list_filter(p.es, lambda e: NOT list_contains(f.dups, e.y))[1:5] AS best, list_contains(f.dups, p.id) AS is_dup FROM per p, fin f),
hit AS (SELECT id, list_filter(best, lambda e: e.ok)[1] AS e FROM top WHERE is_dup)
"""


_RESULT = """SELECT id, e.y AS duplicate_of_id, CASE WHEN e.exact THEN CASE WHEN e.same THEN 'same_title_same_source' ELSE 'syndicated_same_title' END
  ELSE CASE WHEN e.same THEN 'near_duplicate_same_source' ELSE 'syndicated_near_duplicate' END END AS reason,
  CASE WHEN e.exact THEN 1.0::DOUBLE ELSE floor(e.sim::DOUBLE * 1000 + 0.5) / 1000 END AS similarity FROM hit"""


@query("trigram_similarity", ROWS_SQL + f"SELECT a.id, round(coalesce({_SIM}, 0)::DOUBLE, 5) AS sim FROM g a JOIN g b ON b.id = a.id + 10000000")
def _(spark, sf):
    h = headlines(spark, sf).withColumn("grams", t.trigrams(F.col("normalized_title")))
    a, b = h.select("id", "grams"), h.select((F.col("id") - 10000000).alias("id"), F.col("grams").alias("other"))
    sim = F.when(F.size("grams") + F.size("other") > 0, t.jaccard(F.col("grams"), F.col("other"))).otherwise(0.0)
    return a.join(b, "id").select("id", F.round(sim.cast("double"), 5).alias("sim"))


@query("fuzzy_guards", ROWS_SQL + f"SELECT a.id, {_OK} AS forward, {_OK.replace('a.', '_.').replace('b.', 'a.').replace('_.', 'b.')} AS backward FROM g a JOIN g b ON b.id = a.id + 10000000")
def _(spark, sf):
    h = headlines(spark, sf)
    a, b = h.select("id", "normalized_title"), h.select((F.col("id") - 10000000).alias("id"), F.col("normalized_title").alias("other"))
    first, second = F.col("normalized_title"), F.col("other")
    return a.join(b, "id").select("id", dedup.guards(first, second, ANCHOR).alias("forward"), dedup.guards(second, first, ANCHOR).alias("backward"))


@query("dedup_near_title", ROWS_SQL + f""", cells AS (SELECT DISTINCT nt, tri, nums, anch, CAST(floor(epoch(ts) / 129600) AS BIGINT) AS bkt FROM g)
SELECT DISTINCT a.nt AS title, b.nt AS other, round({_SIM}::DOUBLE, 5) AS sim, {_OK} AS ok FROM cells a JOIN cells b ON b.bkt BETWEEN a.bkt - 1 AND a.bkt + 1 AND a.nt <> b.nt
  AND len(a.tri) >= 0.75 * len(b.tri) AND len(b.tri) >= 0.75 * len(a.tri)
WHERE length(a.nt) >= 30 AND {_SIM} >= 0.75""")
def _(spark, sf):
    cells = dedup.title_cells(headlines(spark, sf))
    names = cells.select("title_hash", "normalized_title").distinct()
    p = dedup.title_pairs(cells, ANCHOR)
    return (p.join(names.withColumnRenamed("normalized_title", "title"), "title_hash")
            .join(names.select(F.col("title_hash").alias("other_hash"), F.col("normalized_title").alias("other")), "other_hash")
            .select("title", "other", F.round(F.col("sim").cast("double"), 5).alias("sim"), "ok"))


@query("dedup_exact_title", PAIRS_SQL + ", ex AS (SELECT * FROM edges WHERE exact)" + _greedy("ex") + _RESULT)
def _(spark, sf):
    return dedup.assign_duplicates(headlines(spark, sf), ANCHOR, near=False)


@query("dedup_assign", PAIRS_SQL + _greedy("edges") + _RESULT)
def _(spark, sf):
    return dedup.assign_duplicates(headlines(spark, sf), ANCHOR)


@query("dedup_top5", PAIRS_SQL + _greedy("edges") + "SELECT id, place, best[place].y AS other_id, best[place].ok AS ok FROM (SELECT id, best, unnest(range(1, len(best) + 1)) AS place FROM top)")
def _(spark, sf):
    rows, adjacency, reps = dedup.settle(headlines(spark, sf), ANCHOR)
    r = dedup.ranked_candidates(rows, adjacency, reps)
    return r.select("id", F.col("place").cast("long").alias("place"), "other_id", "ok")


@query("dedup_status_scope", PAIRS_SQL + _greedy("edges") + "SELECT g.status, hit.e.ys AS rep_status, count(*) AS n FROM hit JOIN g ON g.id = hit.id GROUP BY 1, 2")
def _(spark, sf):
    h = headlines(spark, sf)
    d = dedup.assign_duplicates(h, ANCHOR).select("id", "duplicate_of_id")
    reps = h.select(F.col("id").alias("duplicate_of_id"), F.col("status").alias("rep_status"))
    return d.join(h.select("id", "status"), "id").join(reps, "duplicate_of_id").groupBy("status", "rep_status").agg(F.count("*").alias("n"))


LINKS_SQL = f"""WITH {i.STORED_SQL},
links AS (SELECT id, duplicate_of_id, id % 2 = 0 AS fuzzy, CASE WHEN id % 5 = 0 THEN 'and ' ELSE '' END || normalized_title || CASE WHEN id % 3 = 0 THEN ' 41' ELSE '' END AS nt FROM articles),
sts AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'rejected' ELSE status END AS status FROM articles)
"""


def _links(spark, sf):
    """Stored articles with some links fuzzy, some headlines edited and some representatives gone."""
    a = i.articles(spark, sf)
    title = F.concat(F.when(F.col("id") % 5 == 0, "and ").otherwise(""), "normalized_title", F.when(F.col("id") % 3 == 0, " 41").otherwise(""))
    return a.withColumns({
        "normalized_title": title, "status": F.when(F.col("id") % 4 == 0, "rejected").otherwise(F.col("status")),
        "duplicate_reason": F.when(F.col("id") % 2 == 0, "syndicated_near_duplicate:0.8").otherwise("syndicated_same_title:1"),
    })


@query("dup_recheck", LINKS_SQL + """SELECT l.id, l.duplicate_of_id, s.status IN ('accepted', 'pending_review') AND (NOT l.fuzzy OR (
  NOT (regexp_matches(l.nt, '\\b[0-9]') AND regexp_matches(r.nt, '\\b[0-9]') AND list_sort(list_distinct(regexp_extract_all(l.nt, '\\b[0-9]+\\b'))) <> list_sort(list_distinct(regexp_extract_all(r.nt, '\\b[0-9]+\\b'))))
  AND NOT (regexp_matches(l.nt, '\\band\\b') AND NOT regexp_matches(r.nt, '\\band\\b')))) AS keep
FROM links l JOIN links r ON r.id = l.duplicate_of_id JOIN sts s ON s.id = r.id""")
def _(spark, sf):
    return dedup.dup_recheck(_links(spark, sf), ANCHOR)


@query("rep_cascade", LINKS_SQL + "SELECT a.id, a.duplicate_of_id FROM articles a JOIN sts s ON s.id = a.duplicate_of_id WHERE s.status = 'rejected'")
def _(spark, sf):
    a = _links(spark, sf)
    return dedup.rep_cascade(a, a.filter("status = 'rejected'")).select("id", "duplicate_of_id")
