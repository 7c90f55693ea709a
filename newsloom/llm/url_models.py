"""URL filter: host rules, then the likelihood ratio of two character models.

URLs that a rule decides are the examples: accepted and rejected ones each train a variable-order Markov model
of characters (contexts of up to ``ORDER`` characters, Witten-Bell smoothing from the longest known context down to
a uniform law). A URL that no rule fits is judged by the difference of the log-likelihoods per character; its
cutoff is calibrated on a fifth of the examples that the models do not see.

Counts are aggregated over all URLs before the shuffle. Distinct (context, character) events are scored once and
joined to the URLs' events; tables of counts are broadcast only while they have few rows, otherwise joined by
shuffle. Nothing but a histogram of scores with steps of 0.01 comes to the driver.

Rules and models read host and path only. Scheme, query and fragment are left out, because the rules that label the examples
do not look at them; URLs that differ only there get one verdict.

Defined cases: a null URL or one without "://" has an empty host and path and no rule; its text for the models
is empty and only the end is scored; without examples of both kinds the cutoff is 0; repeated rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import broadcast_if_small, stored

ORDER = 4
#: Characters that the uniform law at the end of the smoothing shares its mass among.
ALPHABET = 256
#: Rows up to which a count table is broadcast.
MODEL_ROWS = 200_000
START, END = "\x02", "\x03"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# --- fixed values: the rules (host, path, verdict) --------------------------------------------
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
# ---------------------------------------------------------------------------------------------


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where there is no "://"."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(known, url.substr(F.instr(url, "://") + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def events(text: str) -> str:
    """SQL for the array of (context and character) of a text: up to ORDER characters before each, and the end."""
    marked = f"concat(repeat('{START}', {ORDER}), {text}, '{END}')"
    return f"transform(sequence(1, length({text}) + 1), i -> substring({marked}, i, {ORDER + 1}))"


def counts(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (class, event) rows: per gram of 1 .. ORDER + 1 characters its counts, per context its totals and kinds."""
    grams = (examples.groupBy("class", "event").agg(F.count("*").alias("n"))
             .select("class", "n", F.explode(F.expr(f"transform(sequence(1, {ORDER + 1}), k -> right(event, k))")).alias("gram")))
    gram = stored(grams.groupBy("gram").agg(*[F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(f"n_{c}") for c in ("allow", "block")]),
                  "url-grams")
    context = stored(gram.groupBy(F.expr("left(gram, length(gram) - 1)").alias("context"))
                     .agg(*[F.sum(f"n_{c}").alias(f"all_{c}") for c in ("allow", "block")], *[F.count_if(F.col(f"n_{c}") > 0).alias(f"kinds_{c}") for c in ("allow", "block")]),
                     "url-contexts")
    return gram, context


def event_scores(wanted: DataFrame, gram: DataFrame, context: DataFrame) -> DataFrame:
    """event and its log-likelihood difference (accepted less rejected)."""
    levels = wanted.select("event", F.explode(F.expr(f"transform(sequence(1, {ORDER + 1}), k -> named_struct('k', k, 'gram', right(event, k)))")).alias("x"))
    levels = levels.select("event", "x.k", "x.gram", F.expr("left(x.gram, length(x.gram) - 1)").alias("context"))
    found = (levels.join(broadcast_if_small(context, MODEL_ROWS), "context").join(broadcast_if_small(gram, MODEL_ROWS), "gram", "left")
             .na.fill(0, ["n_allow", "n_block"]))
    steps = found.groupBy("event").agg(F.sort_array(F.collect_list(F.struct("k", *[f"{a}_{c}" for c in ("allow", "block") for a in ("n", "all", "kinds")]))).alias("s"))
    chance = lambda c: F.expr(f"aggregate(s, 1D / {ALPHABET}, (p, x) -> if(x.all_{c} = 0, p, (x.n_{c} + x.kinds_{c} * p) / (x.all_{c} + x.kinds_{c})))")
    seen = steps.select("event", (F.log(chance("allow")) - F.log(chance("block"))).alias("difference"))
    return seen


def cutoff(scored: DataFrame) -> float:
    """The score (in steps of 0.01) that separates held-out examples best: share of accepted ones at or above it less
    that of rejected ones; of equal ones the middle."""
    bins = sorted((r["bin"], r["allow"], r["block"]) for r in scored.groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(
        F.count_if(F.col("class") == "allow").alias("allow"), F.count_if(F.col("class") == "block").alias("block")).collect())
    allow, block = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not allow or not block:
        return 0.0
    best, low, high, a, b = -1.0, 0, 0, 0, 0
    for at, here_a, here_b in bins:
        gain = (allow - a) / allow - (block - b) / block  # if the cutoff is this bin's lower end
        if gain > best + 1e-12:
            best, low, high = gain, last if a or b else at, at
        a, b, last = a + here_a, b + here_b, at + 1
    return (low + high) / 200


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict and the model's score (accepted less rejected, per character) of every row."""
    host, path = parts(F.col(url))
    first = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = stored(first.select("*", name.alias("rule"), verdict.alias("ruled"), F.concat("host", "path").alias("body"),
                               F.monotonically_increasing_id().alias("row")), "url-rows")
    test = F.pmod(F.xxhash64("body"), F.lit(5)) == 4
    known = rows.where("ruled is not null")
    examples = known.where(~test).select(F.col("ruled").alias("class"), F.explode(F.expr(events("body"))).alias("event"))
    gram, context = counts(examples)
    said = rows.select("row", F.explode(F.expr(events("body"))).alias("event")).groupBy("row", "event").agg(F.count("*").alias("n"))
    scores = stored(event_scores(rows.select(F.explode(F.expr(events("body"))).alias("event")).distinct(), gram, context), "url-events")
    # An event whose last character follows no known context, not even the empty one, occurs only without examples.
    score = (said.join(broadcast_if_small(scores, MODEL_ROWS), "event").groupBy("row")
             .agg((F.sum(F.col("n") * F.col("difference")) / F.sum("n")).alias("score")))
    judged = stored(rows.join(score, "row", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "url-scores")
    limit = cutoff(judged.where(F.col("ruled").isNotNull() & test).withColumn("class", F.col("ruled")))
    return judged.select(F.col("key").alias(key), "host", "path", "rule",
                         F.coalesce("ruled", F.when(F.col("score") >= limit, "allow").otherwise("block")).alias("verdict"), "score")
