"""Text and URL expressions over whole pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import inputs as i
from newsloom.catalog.inputs import sql_decode, sql_match
from newsloom.functions import text as t
from newsloom.functions import url as u
from newsloom.operators.normalize import normalize_language, strip_source_suffix

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


VARIANTS = 6


def url_variants(spark, sf):
    """Every page URL with tracking, AMP, mobile, index and casing variants of itself."""
    p = i.table(spark, sf, "pages").select("page_id", "url")
    base, frag = F.regexp_replace("url", "[?#].*$", ""), F.lit("#x")
    forms = F.array(
        F.col("url"),
        F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_source=a&b=2&a=1&fbclid=9")),
        F.concat(base, F.lit("/amp/"), frag),
        F.regexp_replace("url", "://", "://m."),
        F.concat(base, F.lit("/index.html")),
        F.concat(F.lit("HTTPS://WWW.Amp."), F.regexp_replace("url", "^[a-z]+://", "")),
    )
    return p.select("page_id", F.posexplode(forms).alias("variant", "url"))


URLS = """WITH v AS (
  SELECT page_id, 0 AS variant, url FROM pages
  UNION ALL SELECT page_id, 1, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=a&b=2&a=1&fbclid=9' FROM pages
  UNION ALL SELECT page_id, 2, regexp_replace(url, '[?#].*$', '') || '/amp/#x' FROM pages
  UNION ALL SELECT page_id, 3, regexp_replace(url, '://', '://m.') FROM pages
  UNION ALL SELECT page_id, 4, regexp_replace(url, '[?#].*$', '') || '/index.html' FROM pages
  UNION ALL SELECT page_id, 5, 'HTTPS://WWW.Amp.' || regexp_replace(url, '^[a-z]+://', '') FROM pages),
parts AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
  CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END AS path,
  list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '') AS params FROM v),
"""
_TRACK = "(lower(split_part(p, '=', 1)) IN (" + ", ".join(f"'{x}'" for x in u.TRACKING_PARAMS) + ") OR regexp_matches(lower(split_part(p, '=', 1)), '^(" + "|".join(u.TRACKING_PREFIXES) + ")'))"
_STRIP = "host"
for _ in range(4):
    _STRIP = f"regexp_replace({_STRIP}, '^(www|m|amp|mobile)\\.([^.]+\\.[^.]+.*)$', '\\2')"
CANON = URLS + f"""canon AS (SELECT page_id, variant, url, host, {_STRIP} AS site,
  {_STRIP} || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '/{{2,}}', '/', 'g'), '(?i)/amp/?$', '/'), '(?i)/amp/', '/'),
    '(?i)\\.amp(\\.html?)?$', '\\1'), '(?i)/index\\.(html?|php)$', '/'), '/+$', '')
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(list_transform(kept, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)), '&') ELSE '' END AS canonical,
  scheme || '://' || host || path || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS original
  FROM (SELECT *, list_filter(params, lambda p: NOT {_TRACK}) AS kept FROM parts))
"""


@query("canonical_url", CANON + "SELECT page_id, variant, canonical FROM canon")
def _(spark, sf):
    return url_variants(spark, sf).select("page_id", "variant", u.canonical_url(F.col("url")).alias("canonical"))


@query("clean_original_url", CANON + "SELECT page_id, variant, original FROM canon")
def _(spark, sf):
    return url_variants(spark, sf).select("page_id", "variant", u.clean_original_url(F.col("url")).alias("original"))


@query("strip_host_prefix", CANON + "SELECT page_id, variant, site FROM canon")
def _(spark, sf):
    return url_variants(spark, sf).select("page_id", "variant", u.canonical_host(F.col("url")).alias("site"))


@query("sha256_hex", CANON + "SELECT page_id, variant, sha256(canonical) AS url_hash FROM canon")
def _(spark, sf):
    return url_variants(spark, sf).select("page_id", "variant", t.sha256_hex(u.canonical_url(F.col("url"))).alias("url_hash"))


@query("url_match_text", URLS + f"x AS (SELECT page_id, variant, {sql_match('''url_decode(path) || ' ?' || array_to_string(params, '&')''')} AS words FROM parts) SELECT * FROM x")
def _(spark, sf):
    return url_variants(spark, sf).select("page_id", "variant", u.url_match_text(F.col("url")).alias("words"))


def doubtful_urls(spark, sf):
    p = i.table(spark, sf, "pages").select("page_id", "url")
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    forms = F.array(
        F.col("url"), F.concat(F.lit("ftp://"), rest), F.concat(F.lit("http://user:pw@"), rest),
        F.concat(F.regexp_extract("url", "^[a-z]+://[^/]*", 0), F.lit(":8080/x")),
        F.concat(F.lit("http://localhost/"), rest), F.concat(F.lit("http://10.0.0."), (F.col("page_id") % 250).cast("string"), F.lit("/x")),
        F.concat(F.lit("https://intra.corp/"), rest), F.concat("url", F.repeat(F.lit("a"), 2048)), rest,
    )
    return p.select("page_id", F.posexplode(forms).alias("variant", "url"))


DOUBTFUL = """WITH r AS (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS rest FROM pages), d AS (
SELECT page_id, unnest([url, 'ftp://' || rest, 'http://user:pw@' || rest, regexp_extract(url, '^[a-z]+://[^/]*', 0) || ':8080/x', 'http://localhost/' || rest,
  'http://10.0.0.' || (page_id % 250) || '/x', 'https://intra.corp/' || rest, url || repeat('a', 2048), rest]) AS url,
  unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS variant FROM r),
j AS (SELECT page_id, variant, url, CASE WHEN NOT regexp_matches(url, '^[a-z]+:') THEN 'unparseable URL' WHEN NOT regexp_matches(url, '^https?:') THEN 'unsupported scheme'
  WHEN regexp_matches(url, '^https?://[^/]*@') THEN 'credentials in URL' WHEN NOT regexp_matches(url, '^https?://[^/:]*\\.') THEN 'host is not a public domain'
  WHEN regexp_matches(url, '^https?://[0-9.]+(:[0-9]+)?/') THEN 'IP address host' WHEN regexp_matches(url, '^https?://[^/:]*\\.(local|corp|test|example)[/:]') THEN 'non-public host'
  WHEN regexp_matches(url, '^https?://[^/]*:8080') THEN 'non-standard port' WHEN length(url) > 2048 THEN 'URL too long' END AS reason FROM d)
"""


@query("public_url_check", DOUBTFUL + "SELECT page_id, variant, reason FROM j")
def _(spark, sf):
    return doubtful_urls(spark, sf).select("page_id", "variant", u.public_url_reason(F.col("url")).alias("reason"))


@query("image_url_check", DOUBTFUL + "SELECT page_id, variant, CASE WHEN reason IS NULL THEN url END AS image_url FROM j")
def _(spark, sf):
    return doubtful_urls(spark, sf).select("page_id", "variant", u.image_url_or_null(F.col("url")).alias("image_url"))


@query("decode_entities", f"SELECT page_id, sha256({sql_decode('html')}) AS decoded FROM pages")
def _(spark, sf):
    return i.table(spark, sf, "pages").select("page_id", t.sha256_hex(t.decode_entities(F.col("html"))).alias("decoded"))


def sql_clean(x: str) -> str:
    """Display cleaning with RE2: two passes stand in for the look-ahead between initials."""
    s = f"regexp_replace({sql_decode(x)}, '[\\x{{0000}}-\\x{{001f}}\\x{{007f}}-\\x{{009f}}\\x{{200b}}-\\x{{200f}}\\x{{2028}}\\x{{2029}}\\x{{feff}}]', ' ', 'g')"
    s = f"trim(regexp_replace(regexp_replace({s}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
    for pattern, by in (
        ("\\s+([.,;:!?%)\\]}])", "\\1"), ("([(\\[{])\\s+", "\\1"),
        ("(?i)([A-Za-z0-9_])\\s*([''’])\\s*(s|t|re|ve|ll|d|m)\\b", "\\1\\2\\3"),
        ("\\b([A-Z])\\.\\s([A-Z]\\.)", "\\1.\\2"), ("\\b([A-Z])\\.\\s([A-Z]\\.)", "\\1.\\2"), ("\\s*([–—])\\s*", " \\1 "),
    ):
        s = f"regexp_replace({s}, '{pattern}', '{by}', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


@query("clean_display_text", f"""SELECT doc_id AS id, 'document' AS kind, sha256({sql_clean('text')}) AS cleaned FROM documents
UNION ALL SELECT page_id, 'page', sha256({sql_clean('html')}) FROM pages""")
def _(spark, sf):
    d = i.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), "text")
    p = i.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), F.col("html").alias("text"))
    return d.unionByName(p).select("id", "kind", t.sha256_hex(t.clean_display_text(F.col("text"))).alias("cleaned"))


@query("match_text", f"SELECT doc_id, sha256({sql_match('text', True)}) AS words FROM documents")
def _(spark, sf):
    return i.table(spark, sf, "documents").select("doc_id", t.sha256_hex(t.match_text(F.col("text"))).alias("words"))


def sql_truncate(limit: int, x: str = "text") -> str:
    cut = f"substr({x}, 1, {limit - 1})"
    last = f"({limit - 1} - strpos(reverse({cut}), ' '))"
    return (f"CASE WHEN length({x}) > {limit} THEN rtrim(CASE WHEN strpos(reverse({cut}), ' ') > 0 AND {last} > {limit} * 0.6 "
            f"THEN substr({cut}, 1, {last}) ELSE {cut} END, ' ' || chr(10) || chr(9) || chr(13)) || '…' ELSE {x} END")


@query("truncate_words", f"SELECT doc_id, {sql_truncate(300)} AS title, sha256({sql_truncate(4000)}) AS long_text FROM documents")
def _(spark, sf):
    d = i.table(spark, sf, "documents")
    return d.select("doc_id", t.truncate_words(F.col("text"), 300).alias("title"), t.sha256_hex(t.truncate_words(F.col("text"), 4000)).alias("long_text"))


_SEP = "\\s+[|\\-–—:]\\s+"
DECORATED = f"""WITH d AS (SELECT doc_id, source || doc_id % 7 || 'post.example.org' AS domain, split_part(text, chr(10), 1) || CASE doc_id % 6
    WHEN 0 THEN ' - ' || source || doc_id % 7 || 'post' WHEN 1 THEN ' | News Today' WHEN 2 THEN ' – Breaking News | a slogan of words' WHEN 3 THEN ' : ' || upper(source) || ' example'
    WHEN 4 THEN ' - Elsewhere - ' || source ELSE '' END AS title FROM documents),
s AS (SELECT *, string_split_regex(title, '{_SEP}') AS segs, regexp_replace(replace(substr(domain, 1, length(domain) - 4), '.', ''), '[^a-z0-9]', '', 'g') AS stem,
  list_filter(string_split(substr(domain, 1, length(domain) - 4), '.'), lambda l: length(l) >= 4 AND l NOT IN ('www', 'news', 'amp')) AS labels FROM d),
k AS (SELECT *, regexp_replace(lower(segs[-1]), '[^a-z0-9]', '', 'g') AS s1, regexp_replace(lower(coalesce(segs[-2], '')), '[^a-z0-9]', '', 'g') AS s2 FROM s),
n AS (SELECT *, length(s1) BETWEEN 4 AND 40 AND (contains(stem, s1) OR contains(s1, stem) OR len(list_filter(labels, lambda l: contains(s1, l))) > 0 OR s1 IN ('news', 'latestnews', 'indianews', 'breakingnews', 'topnews')) AS n1,
  length(s2) BETWEEN 4 AND 40 AND (contains(stem, s2) OR contains(s2, stem) OR len(list_filter(labels, lambda l: contains(s2, l))) > 0 OR s2 IN ('news', 'latestnews', 'indianews', 'breakingnews', 'topnews')) AS n2,
  trim(regexp_replace(substr(title, 1, length(title) - length(segs[-1])), '{_SEP}$', '')) AS h1 FROM k),
h AS (SELECT *, trim(regexp_replace(substr(h1, 1, length(h1) - length(coalesce(segs[-2], ''))), '{_SEP}$', '')) AS h2 FROM n)
SELECT doc_id, CASE WHEN len(segs) < 2 THEN title WHEN len(segs) >= 3 AND n2 THEN CASE WHEN length(h2) >= 10 THEN h2 ELSE title END
  WHEN n1 THEN CASE WHEN length(h1) >= 10 THEN h1 ELSE title END ELSE title END AS headline FROM h"""


@query("strip_source_suffix", DECORATED)
def _(spark, sf):
    d = i.table(spark, sf, "documents")
    k, number = F.col("doc_id") % 6, (F.col("doc_id") % 7).cast("string")
    tail = (F.when(k == 0, F.concat(F.lit(" - "), "source", number, F.lit("post"))).when(k == 1, " | News Today")
            .when(k == 2, " – Breaking News | a slogan of words").when(k == 3, F.concat(F.lit(" : "), F.upper("source"), F.lit(" example")))
            .when(k == 4, F.concat(F.lit(" - Elsewhere - "), "source")).otherwise(""))
    rows = d.select("doc_id", F.concat(F.substring_index("text", "\n", 1), tail).alias("title"), F.concat("source", number, F.lit("post.example.org")).alias("domain"))
    return rows.select("doc_id", strip_source_suffix(F.col("title"), F.col("domain")).alias("headline"))


@query("normalize_language", """WITH l AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' English ' WHEN 1 THEN 'TAM' WHEN 2 THEN lang WHEN 3 THEN 'Martian' END AS lang FROM documents)
SELECT doc_id, CASE WHEN lang IS NULL THEN 'und' WHEN lower(trim(lang)) IN ('english', 'eng', 'en') THEN 'en' WHEN lower(trim(lang)) IN ('tamil', 'tam', 'ta') THEN 'ta'
WHEN length(trim(lang)) <= 3 THEN lower(trim(lang)) ELSE 'und' END AS language FROM l""")
def _(spark, sf):
    k = F.col("doc_id") % 5
    lang = F.when(k == 0, " English ").when(k == 1, "TAM").when(k == 2, F.col("lang")).when(k == 3, "Martian")
    return i.table(spark, sf, "documents").select("doc_id", normalize_language(lang).alias("language"))
