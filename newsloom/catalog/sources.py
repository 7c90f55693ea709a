"""Provider formats written out from the pages table and read back as candidates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.catalog import inputs as i
from newsloom.session import materialise, scratch_dir
from newsloom.sources import candidates, doc_json, gkg

QUERIES, ORACLES = {}, {}
ANCHOR = r"\b(the|und|de)\b"


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def archive_lines(spark, sf):
    """Each page as one 27-column archive line (column ``value``)."""
    p = i.page_candidates(spark, sf)
    names = F.split("entities", " ; ")
    person = F.array_join(F.slice(names, 1, 2), ";")
    location = F.concat(F.lit("4#"), F.coalesce(F.try_element_at(names, F.lit(3)), F.lit("")), F.lit("#IN#IN25#1#2#3"))
    every = F.array_join(F.transform(names, lambda n: F.concat(n, F.lit(",12"))), ";")
    columns = [F.lit("")] * gkg.COLUMNS
    columns[gkg.RECORD_ID] = F.concat("published_at", F.lit("-"), F.col("arrival").cast("string"))
    columns[gkg.DATE] = F.col("published_at")
    columns[gkg.SOURCE_NAME] = F.lit("feed.example.org")
    columns[gkg.DOCUMENT_URL] = F.when(F.col("arrival") % 17 == 0, F.lit("ftp://x")).otherwise(F.col("url"))
    columns[gkg.THEMES] = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(18)), lambda k: F.concat(F.lit("T"), k.cast("string"))), ";")
    columns[gkg.LOCATIONS] = location
    columns[gkg.PERSONS] = person
    columns[gkg.ORGANIZATIONS] = F.lit("News Desk; ;Wire")
    columns[gkg.ALL_NAMES] = every
    columns[gkg.EXTRAS] = F.when(F.col("arrival") % 13 == 0, F.lit("<PAGE_LINKS>x</PAGE_LINKS>")).otherwise(
        F.concat(F.lit("<PAGE_LINKS>x</PAGE_LINKS><PAGE_TITLE>"), F.regexp_replace("title", "[\t\n]", " "), F.lit("</PAGE_TITLE>")))
    short = F.concat_ws("\t", *columns[:20])
    line = F.when(F.col("arrival") % 19 == 0, short).otherwise(F.concat_ws("\t", *columns))
    return p.select("arrival", F.concat(line, F.lit("\r")).alias("value"))


def archive_files(spark, sf):
    """The archive lines as landed gzip files."""
    path = f"{scratch_dir(spark)}/newsloom-archive-{uuid.uuid4().hex}"
    archive_lines(spark, sf).select("value").write.option("compression", "gzip").text(path)
    return path


def answer_files(spark, sf):
    """Every answer as a landed file of its own, in a folder named after its number."""
    path = f"{scratch_dir(spark)}/newsloom-answers-{uuid.uuid4().hex}"
    answers(spark, sf).write.partitionBy("file").text(path)
    return path


def query_of_file():
    return (F.regexp_extract("file", "file=([0-9]+)", 1).cast("long") % 10).cast("int")


NAMES_SQL = f"""WITH {i.PAGES_SQL},
n AS (SELECT *, string_split(entities, ' ; ') AS names FROM page_cand),
persons AS (SELECT *, list_filter(list_transform(string_split(array_to_string(names[1:2], ';'), ';'), lambda e: trim(split_part(e, ',', 1))), lambda e: e <> '') AS persons FROM n),
k AS (SELECT *, persons || ['News Desk', 'Wire']
   || list_filter(list_transform(string_split(coalesce(names[3], ''), ';'), lambda e: trim(e)), lambda e: e <> '')
   || list_filter(list_transform(string_split(array_to_string(list_transform(names, lambda e: e || ',12'), ';'), ';'), lambda e: trim(split_part(e, ',', 1))), lambda e: e <> '') AS every
  FROM persons)
"""


@query("gkg_names", NAMES_SQL + "SELECT arrival, array_to_string(persons, '|') AS persons, len(every) AS all_names FROM k WHERE arrival % 19 <> 0")
def _(spark, sf):
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = archive_lines(spark, sf).select("arrival", f.alias("f")).filter(F.size("f") >= gkg.COLUMNS)
    persons = gkg.name_list(F.col("f")[gkg.PERSONS])
    every = F.concat(persons, gkg.name_list(F.col("f")[gkg.ORGANIZATIONS]), gkg.name_list(F.col("f")[gkg.LOCATIONS], 1), gkg.name_list(F.col("f")[gkg.ALL_NAMES]))
    return rows.select("arrival", F.array_join(persons, "|").alias("persons"), F.size(every).cast("long").alias("all_names"))


@query("gkg_page_title", NAMES_SQL + f"""SELECT arrival, CASE WHEN arrival % 13 <> 0 AND trim({i.sql_decode("regexp_replace(title, '[\t\n]', ' ', 'g')")}) <> ''
THEN trim({i.sql_decode("regexp_replace(title, '[\t\n]', ' ', 'g')")}) END AS title FROM k WHERE arrival % 19 <> 0""")
def _(spark, sf):
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = archive_lines(spark, sf).select("arrival", f.alias("f")).filter(F.size("f") >= gkg.COLUMNS)
    return rows.select("arrival", gkg.page_title(F.col("f")[gkg.EXTRAS]).alias("title"))


_TITLE = "trim(" + i.sql_decode("regexp_replace(title, '[\t\n]', ' ', 'g')") + ")"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '\\?([^#]*)', 1)"


@query("scan_gkg", NAMES_SQL + f""", lines AS (SELECT *, array_to_string(names[1:2], ';') AS person_text FROM k),
raw AS (SELECT *, concat(title, ' ', url, ' ', entities) AS raw_line FROM lines)
SELECT arrival AS record, url, {_TITLE} AS title,
  array_to_string(list_filter(list_transform(range(1, len(every) + 1), lambda j: CASE WHEN list_position(every, every[j]) = j THEN every[j] END), lambda e: e IS NOT NULL), ' ; ') AS entities,
  'T1;T2;T3;T4;T5;T6;T7;T8;T9;T10;T11;T12;T13;T14;T15' AS themes
FROM raw WHERE arrival % 19 <> 0 AND arrival % 17 <> 0 AND arrival % 13 <> 0 AND {_TITLE} <> ''
  AND regexp_matches(raw_line || ' {{x}}', '(?i){ANCHOR}')
  AND regexp_matches({i.sql_match(_TITLE, True)} || ' ' || {i.sql_match(_PATH + " || ' ?' || " + _QUERY)} || ' ' || {i.sql_match("array_to_string(persons, ' ; ')")}, '{ANCHOR}')""")
def _(spark, sf):
    found = gkg.scan_gkg(spark, archive_files(spark, sf), ANCHOR).candidates
    record = F.substring_index("provider_ref", "-", -1).cast("long").alias("record")
    return found.select(record, "url", "title", "entities", F.col("metadata")["themes"].alias("themes"))


_LINE = """concat_ws(' ', CASE WHEN arrival % 17 = 0 THEN 'ftp://x' ELSE url END, person_text, coalesce(names[3], ''),
  CASE WHEN arrival % 19 <> 0 THEN entities END, CASE WHEN arrival % 19 <> 0 AND arrival % 13 <> 0 THEN title END)"""


@query("scan_gkg_counts", NAMES_SQL + f""", lines AS (SELECT *, array_to_string(names[1:2], ';') AS person_text FROM k),
sorted AS (SELECT CASE WHEN NOT regexp_matches({_LINE}, '(?i){ANCHOR}') THEN 'filtered' WHEN arrival % 19 = 0 THEN 'short' WHEN arrival % 17 = 0 THEN 'no_url'
  WHEN arrival % 13 = 0 OR {_TITLE} = '' THEN 'no_title'
  WHEN regexp_matches({i.sql_match(_TITLE, True)} || ' ' || {i.sql_match(_PATH + " || ' ?' || " + _QUERY)} || ' ' || {i.sql_match("array_to_string(persons, ' ; ')")}, '{ANCHOR}') THEN 'kept' ELSE 'off_topic' END AS outcome FROM lines)
SELECT 'lines' AS outcome, count(*) AS n FROM sorted UNION ALL SELECT 'corrupt', count(*) FROM sorted WHERE outcome = 'short'
UNION ALL SELECT o, (SELECT count(*) FROM sorted WHERE outcome = o) FROM (SELECT unnest({gkg.OUTCOMES!r}) AS o)""")
def _(spark, sf):
    """Lines read, dropped and kept, counted while the candidates are written; corrupt lines are read back by themselves."""
    scan = gkg.scan_gkg(spark, archive_files(spark, sf), ANCHOR)
    materialise(scan.candidates, "scanned")
    counts = spark.createDataFrame(list(scan.counts().items()), "outcome string, n long")
    return counts.unionByName(scan.corrupt.agg(F.count("*").alias("n")).select(F.lit("corrupt").alias("outcome"), "n"))


def answers(spark, sf):
    """Ten JSON answers for every 500 pages, one per fetch window; some items and answers are bad. The last digit of an answer's
    number is its window, whatever the number of pages."""
    p = i.page_candidates(spark, sf)
    item = F.struct(
        F.when(F.col("arrival") % 11 != 0, F.col("url")).alias("url"),
        F.when(F.col("arrival") % 7 == 0, F.lit(" ")).otherwise(F.col("title")).alias("title"),
        F.when(F.col("arrival") % 5 == 0, F.lit("2024")).otherwise(F.col("published_at")).alias("seendate"),
        F.lit("").alias("socialimage"), F.lit("feed.example.org").alias("domain"), F.lit("English").alias("language"),
        F.col("source_country").alias("sourcecountry"),
    )
    w = F.floor(F.col("arrival") / 500) * 10 + F.col("run_id")
    body = p.groupBy(w.alias("file")).agg(F.to_json(F.struct(F.collect_list(item).alias("articles"))).alias("body"))
    k = F.col("file") % 10
    value = F.when(k == 3, "Your query was too short.").when(k == 4, "{}").when(k == 5, '{"articles": 5}').when(
        k == 6, F.concat(F.lit("\n"), F.regexp_replace("body", '"English"', '"Eng\tlish"'))).when(k == 7, "").when(
        k == 8, '{"status": "ok"}').when(k == 9, '{"articles": [').otherwise(F.col("body"))
    return body.select("file", value.alias("value"))


ITEMS_SQL = f"""WITH {i.PAGES_SQL},
p AS (SELECT *, arrival % 10 AS k, arrival % 11 <> 0 AND arrival % 7 <> 0 AND arrival % 5 <> 0 AND trim(title) <> '' AS good FROM page_cand)
"""


@query("scan_doc_json", ITEMS_SQL + "SELECT url, title, source_country, CAST(arrival % 10 AS INTEGER) AS query_id FROM p WHERE k IN (0, 1, 2, 6) AND good")
def _(spark, sf):
    found, _ = doc_json.scan_doc_json(spark, answer_files(spark, sf), query_of_file())
    return found.select("url", "title", "source_country", F.col("matched_query_id").alias("query_id"))


@query("scan_doc_json_counts", ITEMS_SQL + """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN good THEN 'ok' ELSE 'skipped' END AS outcome FROM p WHERE k IN (0, 1, 2, 6)
UNION ALL SELECT outcome FROM (SELECT DISTINCT k, arrival // 500 AS w, CASE WHEN k IN (4, 7, 8) THEN 'empty' WHEN k = 3 THEN 'rejected' ELSE 'malformed' END AS outcome
  FROM p WHERE k NOT IN (0, 1, 2, 6))) GROUP BY 1""")
def _(spark, sf):
    return doc_json.scan_doc_json(spark, answer_files(spark, sf), query_of_file())[1]


@query("candidates_union", ITEMS_SQL + """SELECT 'gdelt-doc' AS provider, count(*) AS n, count(source_country) AS countries, 0 AS entities FROM p WHERE k IN (0, 1, 2, 6) AND good
UNION ALL SELECT 'pages', count(*), count(source_country), count(nullif(entities, '')) FROM p""")
def _(spark, sf):
    items = doc_json.answer_items(answers(spark, sf)).withColumn("query_id", F.lit(1))
    pages = i.page_candidates(spark, sf).withColumn("provider", F.lit("pages"))
    both = candidates.candidates_union(doc_json.to_candidates(items), pages)
    return both.groupBy("provider").agg(F.count("*").alias("n"), F.count("source_country").alias("countries"), F.count("entities").alias("entities"))


@query("window_url_distinct", f"""WITH {i.PAGES_SQL}, v AS (SELECT run_id, regexp_replace(url, '[?#].*$', '') AS url, arrival FROM page_cand
  UNION ALL SELECT run_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[0-9]+/?$', ''), arrival + 100000 FROM page_cand)
SELECT run_id, url, min(arrival) AS arrival FROM v GROUP BY 1, 2""")
def _(spark, sf):
    p = i.page_candidates(spark, sf).withColumn("url", F.regexp_replace("url", "[?#].*$", ""))
    stems = p.withColumns({"url": F.regexp_replace("url", "[0-9]+/?$", ""), "arrival": F.col("arrival") + 100000})
    return candidates.window_url_distinct(p.unionByName(stems), "run_id").select("run_id", "url", "arrival")
