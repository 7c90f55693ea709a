"""Normalisation, relevance, categories, quality and statuses over pages and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.catalog import inputs as i
from newsloom.catalog.inputs import sql_match
from newsloom.catalog.texts import _SEP, CANON, sql_clean, sql_truncate, url_variants
from newsloom.functions.rules import RelevanceConfig, Rule, occurrences
from newsloom.functions import text as t
from newsloom.operators import categories, quality, relevance, sightings
from newsloom.operators.normalize import normalize
from newsloom.plans.store import Store, Table, by_hash, sink
from newsloom.session import materialise, scratch_dir

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- normalise -------------------------------------------------------------------------------

def _names_source(s: str) -> str:
    return (f"(length({s}) BETWEEN 4 AND 40 AND (contains(stem, {s}) OR contains({s}, stem) OR len(list_filter(long_labels, lambda l: contains({s}, l))) > 0 "
            f"OR {s} IN ('news', 'latestnews', 'indianews', 'breakingnews', 'topnews')))")


# The headline loses the name of its publisher and is cut at 300 characters, as ``normalize`` says.
NORM_SQL = CANON.replace("WITH v AS", "WITH " + i.PAGES_SQL + ", v AS") + f""",
titled AS (SELECT c.*, p.arrival, p.run_id, p.source_country, p.matched_query_id, p.entities, p.language AS lang, {sql_clean('p.title')} AS display
  FROM canon c JOIN page_cand p ON p.arrival = c.page_id),
cut AS (SELECT *, string_split_regex(display, '{_SEP}') AS segs, string_split(site, '.')[1:-2] AS labels FROM titled),
named AS (SELECT *, regexp_replace(array_to_string(labels, ''), '[^a-z0-9]', '', 'g') AS stem,
  list_transform(list_filter(labels, lambda l: length(l) >= 4 AND l NOT IN ('www', 'news', 'amp')), lambda l: regexp_replace(l, '[^a-z0-9]', '', 'g')) AS long_labels,
  regexp_replace(lower(segs[-1]), '[^a-z0-9]', '', 'g') AS s1, regexp_replace(lower(coalesce(segs[-2], '')), '[^a-z0-9]', '', 'g') AS s2,
  trim(regexp_replace(substr(display, 1, length(display) - length(segs[-1])), '{_SEP}$', '')) AS h1 FROM cut),
short AS (SELECT *, {_names_source('s1')} AS n1, {_names_source('s2')} AS n2,
  trim(regexp_replace(substr(h1, 1, length(h1) - length(coalesce(segs[-2], ''))), '{_SEP}$', '')) AS h2 FROM named),
stripped AS (SELECT *, CASE WHEN len(segs) < 2 THEN display WHEN len(segs) >= 3 AND n2 THEN CASE WHEN length(h2) >= 10 THEN h2 ELSE display END
  WHEN n1 AND length(h1) >= 10 THEN h1 ELSE display END AS whole FROM short),
headed AS (SELECT *, {sql_truncate(300, 'whole')} AS headline FROM stripped),
norm AS (SELECT *, sha256(canonical) AS url_hash, {sql_match('headline', True)} AS normalized_title FROM headed)
"""


def variant_candidates(spark, sf):
    """Page candidates once per URL variant, arriving variant by variant."""
    v = url_variants(spark, sf).select(F.col("page_id").alias("arrival"), "variant", F.col("url").alias("v_url"))
    p = i.page_candidates(spark, sf).join(v, "arrival").withColumn("url", F.col("v_url"))
    return p.withColumns(
        {"arrival": F.col("variant") * 1000000 + F.col("arrival"), "run_id": F.col("variant").cast("long")}
    ).drop("variant", "v_url")


@query("normalize_candidates", NORM_SQL + """SELECT variant * 1000000 + arrival AS arrival, canonical AS canonical_url, original AS original_url, site AS source_domain,
CASE WHEN headline = '' THEN 'missing_title' END AS reason, headline AS title, normalized_title, source_country,
CASE WHEN lang IN ('en', 'ta') THEN lang WHEN length(lang) BETWEEN 1 AND 3 THEN lang ELSE 'und' END AS language FROM norm""")
def _(spark, sf):
    n = normalize(variant_candidates(spark, sf))
    return n.select("arrival", "canonical_url", "original_url", "source_domain", "reason", "title", "normalized_title", "source_country", "language")


@query("dedup_url", NORM_SQL + "SELECT url_hash, min(variant * 1000000 + arrival) AS arrival, count(*) AS sightings FROM norm WHERE display <> '' GROUP BY 1")
def _(spark, sf):
    n = normalize(variant_candidates(spark, sf)).filter("reason IS NULL")
    firsts = sightings.dedup_url(n)
    return firsts.select("url_hash", "arrival", "sightings")


@query("sightings_merge", NORM_SQL + """SELECT url_hash, string_agg(CAST(q AS VARCHAR), ',' ORDER BY q) AS query_ids FROM (
SELECT DISTINCT url_hash, CASE WHEN (matched_query_id + variant) % 5 > 0 THEN (matched_query_id + variant) % 5 END AS q FROM norm
WHERE display <> '') WHERE q IN (1, 2, 3, 4) GROUP BY 1""")
def _(spark, sf):
    known = F.col("matched_query_id") + F.floor(F.col("arrival") / 1000000).cast("int")
    c = variant_candidates(spark, sf).withColumn("matched_query_id", F.when(known % 5 > 0, known % 5))
    merged = sightings.merged_queries(normalize(c).filter("reason IS NULL"), i.queries(spark).select("id"))
    ids = F.transform("matched_query_ids", lambda x: x.cast("string"))
    return merged.filter(F.size("matched_query_ids") > 0).select("url_hash", F.array_join(ids, ",").alias("query_ids"))


# --- relevance -------------------------------------------------------------------------------

RULES = [
    Rule("article", "phrase", "the", 10.0),
    Rule("linking", "phrase", "and|that", 6.0, ("title", "description")),
    Rule("shape", "regex", r"\bth[a-z]+tion\b", 8.0, ("title", "description")),
    Rule("near", "proximity", "the", 12.0, ("title", "description"), "of|by the", 3),
    Rule("romance", "phrase", "de la", -15.0, ("title", "description")),
    Rule("section", "phrase", "fr", -5.0, ("url",)),
    Rule("publisher", "phrase", "src3", 20.0, ("entities",)),
]
CONFIG = RelevanceConfig(50.0, 30.0, r"\b(that|der|que)\b", country_boosts={"kenya": 3.0, "india": 4.0})
WEIGHTS = {1: 35.0, 2: 25.0, 3: 20.0, 4: 10.0}


def scored_input(spark, sf):
    """Documents joined with their publisher (country fallback and trust)."""
    s = i.sources(spark, sf).select(F.regexp_replace("domain", r"\.example\.org$", "").alias("source"), F.col("country").alias("source_country"), "trust_weight", F.col("status").alias("source_status"))
    return i.doc_articles(spark, sf).join(s, "source")


def _pad(x: str) -> str:
    return f"(' ' || replace({x}, ' ', '  ') || ' ')"


def sql_phrase(x: str, phrases: list[str]) -> str:
    one = [f"(length({_pad(x)}) - length(replace({_pad(x)}, '{_pad_literal(p)}', ''))) // {len(_pad_literal(p))}" for p in phrases]
    return "(" + " + ".join(one) + ")"


def _pad_literal(p: str) -> str:
    return " " + p.replace(" ", "  ") + " "




SEG_SQL = f"""WITH {i.STORED_SQL},
seg AS (SELECT d.id, d.doc_id, d.source, {sql_match('d.title', True)} AS title, {sql_match('d.description', True)} AS description,
  {sql_match("regexp_replace(original_url, '^https://[^/]*', '')")} AS url, d.entities, s.country, s.trust_weight,
  list_filter([CASE WHEN d.doc_id % 3 = 0 THEN 35.0 END, CASE WHEN d.doc_id % 5 = 0 THEN 25.0 END], lambda w: w IS NOT NULL) AS weights
  FROM doc_art d JOIN sources s ON s.domain = d.source || '.example.org'),
ent AS (SELECT id, list_filter(list_transform(string_split(entities, ';'), lambda e: {sql_match('e')}), lambda e: e <> '') AS names FROM doc_art)
"""


@query("field_segments", SEG_SQL + "SELECT s.id, s.title, sha256(s.description) AS description, s.url, array_to_string(e.names, '|') AS names FROM seg s JOIN ent e ON e.id = s.id")
def _(spark, sf):
    s = relevance.field_segments(scored_input(spark, sf))
    return s.select("id", F.col("seg_title").alias("title"), t.sha256_hex(F.col("seg_description")).alias("description"), F.col("seg_url").alias("url"), F.array_join("seg_entities", "|").alias("names"))


@query("rule_phrase", SEG_SQL + f"SELECT id, {sql_phrase('title', ['the'])} AS in_title, {sql_phrase('description', ['and', 'that'])} AS in_text FROM seg")
def _(spark, sf):
    s = relevance.field_segments(scored_input(spark, sf))
    return s.select("id", occurrences(RULES[0], F.col("seg_title")).cast("long").alias("in_title"), occurrences(RULES[1], F.col("seg_description")).cast("long").alias("in_text"))


@query("rule_regex", SEG_SQL + "SELECT id, least(len(regexp_extract_all(description, '\\bth[a-z]+tion\\b')), 101) AS n, least(len(regexp_extract_all(description, 't')), 101) AS capped FROM seg")
def _(spark, sf):
    s = relevance.field_segments(scored_input(spark, sf))
    return s.select("id", occurrences(RULES[2], F.col("seg_description")).cast("long").alias("n"), occurrences(Rule("t", "regex", "t", 1.0), F.col("seg_description")).cast("long").alias("capped"))


NEAR_SQL = """, w AS (SELECT id, field, string_split(txt, ' ') AS w FROM (SELECT id, 'title' AS field, title AS txt FROM seg UNION ALL SELECT id, 'description', description FROM seg)),
pos AS (SELECT id, field, unnest(w) AS tok, generate_subscripts(w, 1) AS p FROM w),
b AS (SELECT id, field, p AS s, p AS e FROM pos WHERE tok = 'of' UNION ALL
  SELECT x.id, x.field, x.p, y.p FROM pos x JOIN pos y ON y.id = x.id AND y.field = x.field AND y.p = x.p + 1 WHERE x.tok = 'by' AND y.tok = 'the'),
a AS (SELECT id, field, p FROM pos WHERE tok = 'the'),
near AS (SELECT a.id, a.field, count(DISTINCT a.p) AS n FROM a JOIN b ON b.id = a.id AND b.field = a.field AND (b.s - a.p BETWEEN 1 AND 3 OR a.p - b.e BETWEEN 1 AND 3) GROUP BY 1, 2)
"""


@query("rule_proximity", SEG_SQL + NEAR_SQL + "SELECT s.id, coalesce((SELECT n FROM near WHERE near.id = s.id AND field = 'title'), 0) AS in_title, coalesce((SELECT n FROM near WHERE near.id = s.id AND field = 'description'), 0) AS in_text FROM seg s")
def _(spark, sf):
    s = relevance.field_segments(scored_input(spark, sf))
    return s.select("id", occurrences(RULES[3], F.col("seg_title")).cast("long").alias("in_title"), occurrences(RULES[3], F.col("seg_description")).cast("long").alias("in_text"))


def _hits() -> str:
    """One row per (article, rule, field) with its count, by independent SQL for each rule."""
    parts = []
    for n, (name, phrases, fields) in enumerate([
        ("article", ["the"], ["title", "description", "url"]), ("linking", ["and", "that"], ["title", "description"]),
        ("romance", ["de la"], ["title", "description"]), ("section", ["fr"], ["url"]),
    ]):
        order = {"article": 1, "linking": 2, "romance": 5, "section": 6}[name]
        parts += [f"SELECT id, {order} AS k, '{f}' AS field, {sql_phrase(f, phrases)} AS n FROM seg" for f in fields]
    parts += [f"SELECT id, 3 AS k, '{f}' AS field, least(len(regexp_extract_all({f}, '\\bth[a-z]+tion\\b')), 101) AS n FROM seg" for f in ("title", "description")]
    parts.append("SELECT id, 4 AS k, field, n FROM near")
    parts += [f"SELECT id, {k} AS k, 'entities' AS field, CAST(list_sum(list_transform(names, lambda e: {sql_phrase('e', [p])})) AS BIGINT) AS n FROM ent" for k, p in ((1, "the"), (7, "src3"))]
    return " UNION ALL ".join(parts)


SCORE_SQL = SEG_SQL + NEAR_SQL + f""", hits AS (SELECT * FROM ({_hits()}) WHERE n > 0),
contrib AS (SELECT h.id, h.k, sum(n) AS n, r.weight * max(CASE field WHEN 'title' THEN 1.0::DOUBLE WHEN 'description' THEN 0.7::DOUBLE WHEN 'url' THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END)
    * (1 + least(sum(n) - 1, 3) * 0.1::DOUBLE) AS c, r.name
  FROM hits h JOIN (VALUES {", ".join(f"({k}, '{r.name}', {r.weight}::DOUBLE)" for k, r in enumerate(RULES, 1))}) AS r(k, name, weight) ON r.k = h.k GROUP BY h.id, h.k, r.weight, r.name),
extra AS (
  SELECT id, 8 AS k, len(weights) AS n, list_max(weights)::DOUBLE AS c, 'provider-query-match' AS name FROM seg WHERE len(weights) > 0
  UNION ALL SELECT id, 9, len(weights), 5.0, 'multiple-query-match' FROM seg WHERE len(weights) > 1
  UNION ALL SELECT id, 10, 1, CASE lower(country) WHEN 'kenya' THEN 3.0 ELSE 4.0 END, 'source-country:' || lower(country) FROM seg WHERE lower(country) IN ('kenya', 'india')
  UNION ALL SELECT id, 11, 1, trust_weight, 'source-trust' FROM seg WHERE trust_weight <> 0),
allsig AS (SELECT id, k, CAST(n AS BIGINT) AS n, CAST(c AS DOUBLE) AS c, name FROM contrib UNION ALL SELECT id, k, n, c, name FROM extra),
anchored AS (SELECT s.id, len(s.weights) > 0 OR regexp_matches(s.title, '\\b(that|der|que)\\b') OR regexp_matches(s.description, '\\b(that|der|que)\\b')
  OR regexp_matches(s.url, '\\b(that|der|que)\\b') OR len(list_filter(e.names, lambda x: regexp_matches(x, '\\b(that|der|que)\\b'))) > 0 AS anchor FROM seg s JOIN ent e ON e.id = s.id),
scored AS (SELECT a.id, a.anchor, floor(greatest(0, least(100, coalesce(t.total, 0))) * 100 + 0.5) / 100 AS score
  FROM anchored a LEFT JOIN (SELECT id, list_reduce(list_prepend(0.0::DOUBLE, list(c ORDER BY k)), lambda x, y: x + y) AS total FROM allsig GROUP BY id) t ON t.id = a.id)
"""


def scored(spark, sf):
    return relevance.score_relevance(scored_input(spark, sf), RULES, WEIGHTS, CONFIG)


@query("rule_contribution", SCORE_SQL + "SELECT id, name AS rule, n, floor(c * 100 + 0.5) / 100 AS contribution FROM contrib")
def _(spark, sf):
    names = [r.name for r in RULES]
    # An outer explode: from a plain one Spark infers a filter on the whole score, and computes every rule again for it.
    s = scored(spark, sf).select("id", F.explode_outer("relevance_signals").alias("s")).select("id", "s.rule", F.col("s.count").cast("long").alias("n"), "s.contribution")
    return s.filter(F.col("rule").isin(*names))


@query("relevance_signals", SCORE_SQL + """SELECT s.id, coalesce((SELECT string_agg(name || ':' || n, ',' ORDER BY k) FROM allsig a WHERE a.id = s.id), '') || CASE WHEN s.anchor THEN '' ELSE ',anchor-missing:0' END AS signals FROM scored s""")
def _(spark, sf):
    s = scored(spark, sf)
    text = F.array_join(F.transform("relevance_signals", lambda x: F.concat_ws(":", x.rule, x["count"].cast("string"))), ",")
    lonely = F.when(text == "anchor-missing:0", ",anchor-missing:0").otherwise(text)
    return s.select("id", lonely.alias("signals"))


@query("relevance_score", SCORE_SQL + """SELECT id, score, CASE WHEN NOT anchor THEN 'irrelevant' WHEN score >= 50 THEN 'relevant' WHEN score >= 30 THEN 'review' ELSE 'irrelevant' END AS status FROM scored""")
def _(spark, sf):
    return scored(spark, sf).select("id", F.col("relevance_score").alias("score"), F.col("relevance_status").alias("status"))


@query("anchor_check", SCORE_SQL + "SELECT id, anchor FROM anchored")
def _(spark, sf):
    s = relevance.field_segments(scored_input(spark, sf))
    w = relevance.query_weight_list(F.col("matched_query_ids"), WEIGHTS)
    return s.select("id", relevance.anchor_check(w, CONFIG).alias("anchor"))


@query("provider_evidence", SEG_SQL + "SELECT id, len(weights) AS matched, coalesce(list_max(weights), 0)::DOUBLE + CASE WHEN len(weights) > 1 THEN 5 ELSE 0 END AS points FROM seg")
def _(spark, sf):
    w = relevance.query_weight_list(F.col("matched_query_ids"), WEIGHTS)
    points = [F.coalesce(s.raw, F.lit(0.0)) for s in relevance.provider_evidence(w, CONFIG)]
    return i.doc_articles(spark, sf).select("id", F.size(w).cast("long").alias("matched"), (points[0] + points[1]).alias("points"))


@query("country_trust_boost", SEG_SQL + "SELECT id, (CASE lower(country) WHEN 'kenya' THEN 3.0 WHEN 'india' THEN 4.0 ELSE 0.0 END + trust_weight)::DOUBLE AS points FROM seg")
def _(spark, sf):
    parts = relevance.country_trust_boost(F.col("source_country"), F.col("trust_weight"), CONFIG)
    return scored_input(spark, sf).select("id", (F.coalesce(parts[0].raw, F.lit(0.0)) + F.coalesce(parts[1].raw, F.lit(0.0))).alias("points"))


# --- categories ------------------------------------------------------------------------------

def _category_hits() -> str:
    factor = {"title": 2, "description": 1, "url": 1}
    parts = []
    for rid, cid, kind, pattern, fields, weight, on in i.CATEGORY_RULE_ROWS:
        if on and cid != 6:
            for f in fields:
                test = f"regexp_matches({f}, '{pattern}')" if kind == "regex" else f"contains(' ' || {f} || ' ', ' {pattern} ')"
                parts.append(f"SELECT id, {rid} AS rule_id, {cid} AS category_id, {weight} * {factor[f]} AS p FROM seg WHERE {test}")
    return " UNION ALL ".join(parts)


CATEGORY_SQL = SEG_SQL + f""", pts AS (SELECT id, category_id, sum(p) AS s FROM (SELECT id, rule_id, category_id, max(p) AS p FROM ({_category_hits()}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
kept AS (SELECT p.id AS article_id, c.slug, floor(s * 100 + 0.5) / 100 AS score FROM pts p JOIN categories c ON c.id = p.category_id AND c.enabled WHERE s >= c.min_score)
"""


@query("category_scores", CATEGORY_SQL + "SELECT article_id, slug, score::DOUBLE AS score FROM kept UNION ALL SELECT id, 'general', 0.0::DOUBLE FROM seg WHERE id NOT IN (SELECT article_id FROM kept)")
def _(spark, sf):
    c = categories.classify(i.doc_articles(spark, sf), i.categories(spark), i.category_rules(spark))
    return c.select("article_id", "slug", "score")


# --- quality and status ----------------------------------------------------------------------

def quality_input(spark, sf):
    """Documents with the defects the checks look for, made from their own columns."""
    a = scored_input(spark, sf)
    k = F.col("id") % 23
    title = (F.when(k == 1, F.concat("title", F.lit("!!! casino"))).when(k == 2, F.upper("title")).when(k == 3, F.concat(F.lit("новости сегодня из города "), F.substring("title", 1, 10)))
             .when(k == 4, F.repeat(F.concat("title", F.lit(" ")), 12)).when(k == 5, F.substring("title", 1, 12)).otherwise(F.col("title")))
    url = (F.when(k == 6, F.concat(F.lit("https://"), "source", F.lit(".example.org/"))).when(k == 7, F.concat(F.lit("https://"), "source", F.lit(".example.org/tags/"), "lang"))
           .when(k == 8, F.lit("nope")).otherwise(F.col("original_url")))
    years = F.when(k == 9, F.col("published_at") - F.expr("INTERVAL 30 YEARS")).when(k == 10, F.col("published_at") + F.expr("INTERVAL 90 YEARS")).otherwise(F.col("published_at"))
    domain = F.when(k == 11, F.concat("source", F.lit(".xyz"))).otherwise(F.concat("source", F.lit(".example.org")))
    return a.select("id", title.alias("title"), url.alias("original_url"), years.alias("published_at"), domain.alias("source_domain"), F.col("lang").alias("language"), "source_status",
                    "source_country", "trust_weight", "matched_query_ids", "entities", "description").withColumn("normalized_title", t.match_text(F.col("title")))


QUALITY_SQL = f"""WITH {i.STORED_SQL},
q AS (SELECT d.id, d.lang, s.status AS source_status, d.id % 23 AS k,
  CASE d.id % 23 WHEN 1 THEN title || '!!! casino' WHEN 2 THEN upper(replace(title, 'ß', 'ss')) WHEN 3 THEN 'новости сегодня из города ' || substr(title, 1, 10) WHEN 4 THEN repeat(title || ' ', 12)
    WHEN 5 THEN substr(title, 1, 12) ELSE title END AS title,
  CASE d.id % 23 WHEN 6 THEN 'https://' || d.source || '.example.org/' WHEN 7 THEN 'https://' || d.source || '.example.org/tags/' || lang WHEN 8 THEN 'nope' ELSE original_url END AS url,
  CASE d.id % 23 WHEN 9 THEN published_at - INTERVAL 30 YEAR WHEN 10 THEN published_at + INTERVAL 90 YEAR ELSE published_at END AS published_at,
  CASE d.id % 23 WHEN 11 THEN 'xyz' ELSE 'org' END AS tld FROM doc_art d JOIN sources s ON s.domain = d.source || '.example.org'),
l AS (SELECT *, regexp_replace(title, '[^\\p{{L}}]', '', 'g') AS letters, {sql_match('title', True)} AS words FROM q),
r AS (SELECT id, source_status, list_filter([CASE WHEN source_status = 'blocked' THEN 'source_blocked' END, CASE WHEN lang <> 'en' THEN 'language_' || lang END,
    CASE WHEN published_at < TIMESTAMP '2000-01-01' THEN 'timestamp_too_old' END, CASE WHEN published_at > TIMESTAMP '2030-01-01 01:00:00' THEN 'timestamp_in_future' END,
    CASE WHEN length(title) < 15 OR len(list_filter(string_split(words, ' '), lambda w: w <> '')) < 3 THEN 'title_too_short' END,
    CASE WHEN regexp_matches(title, '(?i)\\b({quality.SPAM_TERMS})\\b') THEN 'spam_title' END,
    CASE WHEN length(letters) > 0 AND length(regexp_replace(letters, '[^A-Za-zÀ-ɏ]', '', 'g')) / length(letters) < 0.6 THEN 'title_not_english_script' END,
    CASE WHEN k = 8 THEN 'invalid_url' WHEN k = 6 THEN 'homepage_url' END], lambda x: x IS NOT NULL) AS hard,
  list_filter([CASE WHEN length(title) > 290 THEN 'title_very_long' END,
    CASE WHEN length(letters) >= 20 AND letters = upper(letters) AND regexp_matches(letters, '[A-Z]') THEN 'title_all_caps' END,
    CASE WHEN regexp_matches(title, '[!?]{{3,}}') THEN 'excessive_punctuation' END, CASE WHEN tld = 'xyz' THEN 'suspicious_tld_xyz' END,
    CASE WHEN k = 7 THEN 'non_article_url' END], lambda x: x IS NOT NULL) AS soft FROM l),
quality AS (SELECT id, CASE WHEN len(hard) > 0 THEN 'rejected' WHEN len(soft) > 0 AND source_status <> 'trusted' THEN 'pending_review' ELSE 'accepted' END AS quality_status,
  array_to_string(hard || soft, ',') AS reasons FROM r)
"""


def judged(spark, sf):
    return quality.assess_quality(quality_input(spark, sf), F.lit("2030-01-01").cast("timestamp"))


@query("quality_checks", QUALITY_SQL + "SELECT id, quality_status, reasons FROM quality")
def _(spark, sf):
    return judged(spark, sf).select("id", "quality_status", F.array_join("quality_reasons", ",").alias("reasons"))


STATUS_SQL = QUALITY_SQL + """, st AS (SELECT a.id, CASE WHEN a.relevance_status = 'irrelevant' OR q.quality_status = 'rejected' THEN 'rejected' WHEN a.duplicate_of_id IS NOT NULL THEN 'duplicate'
  WHEN a.relevance_status = 'review' OR q.quality_status = 'pending_review' THEN 'pending_review' ELSE 'accepted' END AS status FROM articles a JOIN quality q ON q.id = a.id)
"""


def decided(spark, sf):
    stored = i.articles(spark, sf).select("id", "relevance_status", "duplicate_of_id")
    joined = judged(spark, sf).select("id", "quality_status").join(stored, "id")
    return joined.withColumn("status", quality.decide_status(F.col("relevance_status"), F.col("quality_status"), F.col("duplicate_of_id").isNotNull()))


@query("decide_status", STATUS_SQL + "SELECT id, status FROM st")
def _(spark, sf):
    return decided(spark, sf).select("id", "status")


@query("manual_override", STATUS_SQL + """, ov AS (SELECT doc_id + 1 AS id, CASE WHEN quality = 1 AND toxic = 0 THEN 'accepted' ELSE 'rejected' END AS manual_status FROM labels)
SELECT st.id, coalesce(ov.manual_status, st.status) AS status, ov.manual_status FROM st LEFT JOIN ov ON ov.id = st.id""")
def _(spark, sf):
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accepted").otherwise("rejected")
    ov = i.table(spark, sf, "labels").select((F.col("doc_id") + 1).alias("id"), verdict.alias("manual_status"))
    return quality.apply_overrides(decided(spark, sf), ov).select("id", "status", "manual_status")


# --- the whole pipeline ----------------------------------------------------------------------

@query("sink_articles", NORM_SQL + """, old AS (SELECT DISTINCT url_hash FROM norm WHERE variant < 3 AND arrival % 3 <> 0 AND display <> '')
SELECT url_hash, min(variant * 1000000 + arrival) AS arrival FROM norm WHERE display <> '' AND url_hash NOT IN (SELECT url_hash FROM old) GROUP BY 1""")
def _(spark, sf):
    """Two batches into one table: early sightings, then all of them, the second one delivered twice."""
    n = normalize(variant_candidates(spark, sf)).filter("reason IS NULL").select("niche_id", "url_hash", "arrival")
    n = materialise(n, "sightings")
    early = (F.col("arrival") < 3000000) & (F.col("arrival") % 1000000 % 3 != 0)
    table = Table(n.schema, ("niche_id", "url_hash"), by_hash("niche_id", "url_hash"))
    kept = Store(spark, f"{scratch_dir(spark)}/newsloom-sink-{uuid.uuid4().hex}", {"articles": table})
    for number, rows in enumerate([n.filter(early), n, n]):
        sink(kept, "articles", min(number, 1), rows, "arrival")
    return kept.rows("articles").filter("batch = 1").select("url_hash", "arrival")


def setup(spark):
    from newsloom.plans.pipeline import Setup

    return Setup(
        [*RULES, Rule("lead", "regex", r"\b(the|und|de)\b", 40.0, ("title",))], WEIGHTS, CONFIG, i.categories(spark), i.category_rules(spark), ["en", "fr", "de"]
    )


_STREAMED = {}


def streamed(spark, sf):
    """Every URL variant of all pages, landed as three files (the first variant, the second, all others) and streamed file by file; a
    batch delivered again, and a compaction in between. One run serves all queries of a session over the same tables."""
    from newsloom.streaming import ingest

    run = (spark.sparkContext.applicationId, sf)
    if run in _STREAMED:
        return _STREAMED[run]
    root = f"{scratch_dir(spark)}/newsloom-stream-{uuid.uuid4().hex}"
    now, s = F.lit("2025-01-01").cast("timestamp"), setup(spark)
    c = materialise(variant_candidates(spark, sf), "stream-input")
    for number in range(3):
        c.filter(F.least("run_id", F.lit(2)) == number).coalesce(1).write.mode("append").parquet(f"{root}/landing")
        ingest.stream_ingest(spark, f"{root}/landing", root, f"{root}/checkpoint", s, now, files_per_batch=1).awaitTermination()
        if number == 1:
            ingest.compact(spark, root)
    ingest.store_batch(root, s, now)(c.filter("run_id = 1"), 1)  # delivered again
    _STREAMED[run] = root
    return root


@query("stream_ingest", NORM_SQL + """, good AS (SELECT *, variant * 1000000 + arrival AS arrived FROM norm WHERE display <> ''),
firsts AS (SELECT url_hash, min(arrived) AS id FROM good GROUP BY 1),
every AS (SELECT g.url_hash, f.id, string_agg(DISTINCT CAST(matched_query_id AS VARCHAR), ',' ORDER BY CAST(matched_query_id AS VARCHAR)) AS queries, count(DISTINCT least(variant, 2)) AS batches
  FROM good g JOIN firsts f USING (url_hash) GROUP BY ALL)
SELECT id, url_hash, coalesce(queries, '') AS queries, batches FROM every""")
def _(spark, sf):
    """The identities that the stream has stored: first sighting, merged evidence, and in how many batches each was written."""
    from newsloom.streaming import ingest

    kept = ingest.store(spark, streamed(spark, sf))
    # Rows of all batches are read from the batches themselves; the compacted base holds only current ones.
    number = kept._names("_commits")
    rows = None
    for n in number:
        part = spark.read.parquet(f"{kept.root}/articles/store_kind=delta/store_batch={n}").select("id")
        rows = part if rows is None else rows.unionByName(part)
    written = rows.groupBy("id").agg(F.count("*").alias("batches"))
    ids = F.array_join(F.array_sort(F.transform(F.coalesce("matched_query_ids", F.array().cast("array<int>")), lambda q: q.cast("string"))), ",")
    return kept.current("articles").select("id", "url_hash", ids.alias("queries")).join(written, "id")


@query("stream_outcomes", NORM_SQL + """, good AS (SELECT *, variant * 1000000 + arrival AS arrived FROM norm),
firsts AS (SELECT url_hash, min(arrived) AS id FROM good WHERE display <> '' GROUP BY 1)
SELECT variant AS run_id, CASE WHEN display = '' THEN 'invalid' WHEN f.id = g.arrived THEN 'new' ELSE 'existing' END AS outcome, count(*) AS n
FROM good g LEFT JOIN firsts f ON f.url_hash = g.url_hash GROUP BY ALL""")
def _(spark, sf):
    """Outcomes of all batches; what a new article was judged to be counts as new."""
    from newsloom.streaming import ingest

    rows = ingest.read_outcomes(spark, streamed(spark, sf))
    kind = F.when(F.col("outcome").isin("existing", "invalid"), F.col("outcome")).otherwise("new")
    return rows.groupBy("run_id", kind.alias("outcome")).agg(F.count("*").alias("n"))


@query("stream_statuses")
def _(spark, sf):
    """The stored article table after the stream."""
    from newsloom.streaming import ingest

    a = ingest.current(spark, streamed(spark, sf), "articles")
    return a.select("id", "status", "duplicate_of_id", "relevance_score", "relevance_status", "quality_status", "canonical_url")


@query("rescore_all")
def _(spark, sf):
    """All pages curated in one batch, then rescored under stricter rules."""
    from newsloom import schemas
    from newsloom.plans import pipeline
    from newsloom.streaming.ingest import _CATEGORIES

    now, s = F.lit("2025-01-01").cast("timestamp"), setup(spark)
    empty = pipeline.State(*(spark.createDataFrame([], x) for x in (schemas.ARTICLE, _CATEGORIES, schemas.SOURCE)))
    out = pipeline.process(i.page_candidates(spark, sf), empty, s, now)
    s.rules = s.rules[:-1]
    done = pipeline.rescore(pipeline.State(out["articles"], out["article_categories"], out["sources"]), s, now)
    return done["counts"]
