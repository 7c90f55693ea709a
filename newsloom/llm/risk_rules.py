"""Quality rules whose cutoffs are certified: native columns only.

Each rule rejects texts whose statistic lies above a cutoff. Candidate cutoffs are fixed in advance. For every
stratum (language) the labelled good rows tell how many good ones a cutoff rejects; the exact binomial tail
P(Bin(n, a) <= k) must not exceed the error level, which is divided by the number of strata and statistics.
Cutoffs of one statistic are tested from the loosest on, and testing ends at the first that fails, so no further
division is needed. With confidence 1 - ``DELTA``, over all strata at once, at most ``ALPHA`` of the good rows
of a stratum are rejected. Among certified cutoffs the one that removes most bad rows for its good rows is used.
A stratum with too few labelled good rows gets no certified cutoff and rejects nothing by the method.

One pass over the texts makes fixed-width statistics, which are stored; labels are joined to those. Counts
are aggregated per task before the shuffle; a stratum may hold any share of the rows.

Defined cases: a null text has no words and fails the base rules; a null stratum is a stratum of its own;
labels that are null or contradict each other for a key are not used; repeated rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import broadcast_if_small, stored

#: Good rows that may be rejected per stratum, error level over everything, and how many bad rows one good row is worth.
ALPHA, DELTA, WORTH = 0.02, 0.05, 5
#: Candidate cutoffs, loosest first.
SHARES = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03]
CUTOFFS = {"symbol_share": SHARES, "line_share": SHARES, "repeat_share": SHARES, "capital_share": SHARES,
           "word_length": [40, 30, 25, 20, 16, 14, 12, 11, 10]}
# --- fixed values: the base rules -----------------------------------------------------------
BLANKS, SYMBOLS, WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = " \t\n\x0b\x0c\r", "#*$%&|<>", 8, 20, 30
# ---------------------------------------------------------------------------------------------


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Base counts and statistics of every row, with its key and stratum."""
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(body, F.lit(BLANKS))
    first = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+")).alias("words"),
        F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("lines"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}+", ""))).alias("capitals"))
    n = F.size("words")
    second = first.select(
        "key", "stratum", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        "capitals", F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.expr(f"transform(slice(words, 1, size(words) - {WINDOW - 1}), (w, i) -> xxhash64(slice(words, i + 1, {WINDOW})))"))
        .alias("windows"))
    # Only texts in which a window stands twice are sorted: (window, place) pairs, then the places that have an equal neighbour.
    third = second.withColumn("sorted", F.expr(
        "if(size(array_distinct(windows)) < size(windows), sort_array(transform(windows, (x, i) -> struct(x as x, i as i))), null)"))
    fourth = third.withColumn("places", F.expr(
        "sort_array(transform(filter(sequence(0, size(sorted) - 1), k -> (k > 0 and sorted[k].x = sorted[greatest(k - 1, 0)].x)"
        " or (k < size(sorted) - 1 and sorted[k].x = sorted[least(k + 1, size(sorted) - 1)].x)), k -> sorted[k].i))"))
    repeats = F.when(F.col("sorted").isNull(), F.lit(0)).otherwise(F.expr(
        f"aggregate(places, named_struct('n', 0, 'end', 0), (a, p) -> named_struct('n', a.n + p + {WINDOW} - greatest(a.end, p), 'end', p + {WINDOW}), a -> a.n)"))
    share = lambda part, whole: F.coalesce(F.col(part) / F.when(F.col(whole) > 0, F.col(whole)), F.lit(0.0))
    return fourth.withColumn("n_repeat_words", repeats.cast("long")).select(
        "key", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("capitals", "word_chars").alias("capital_share"),
        share("word_chars", "n_words").alias("word_length"))


def binomial_tail(n: Column, k: Column, a: float) -> Column:
    """P(Bin(n, a) <= k), exact; 1 where k is not below its mean (no cutoff is certified there)."""
    term = F.expr(f"""aggregate(sequence(0L, k), named_struct('l', n * ln(1 - {a}D), 's', 0D),
        (z, i) -> named_struct('l', z.l + ln((n - i) / (i + 1D)) + ln({a}D / (1 - {a}D)), 's', z.s + exp(z.l)), z -> z.s)""")
    return F.when(k >= n * a, F.lit(1.0)).otherwise(term)


def certified(measures: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
              alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and the cutoff of every statistic (null: none), from the labelled rows."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
             .agg(F.min(label).alias("good"), F.max(label).alias("high")).where("good = high").select("key", "good"))
    rows = measures.join(known, "key")
    tests = [F.struct(F.lit(name).alias("name"), F.lit(float(c)).alias("cutoff"),
                      F.count_if((F.col("good") == 1) & (F.col(name) > c)).alias("k"),
                      F.count_if((F.col("good") == 0) & (F.col(name) > c)).alias("bad")) for name, cs in CUTOFFS.items() for c in cs]
    counted = stored(rows.groupBy("stratum").agg(F.count_if(F.col("good") == 1).alias("n"), F.array(*tests).alias("tests")), "risk-counts")
    strata = max(counted.count(), 1)
    level, share = delta / (strata * len(CUTOFFS)), alpha / len(CUTOFFS)
    judged = (counted.select("stratum", "n", F.explode("tests").alias("t")).select("stratum", "n", "t.*")
              .withColumn("p", binomial_tail(F.col("n"), F.col("k"), share)))
    # Rejections grow along the cutoffs of a statistic, and p with them: those before the first failure are those that pass.
    best = (judged.where(F.col("p") <= level).withColumn("worth", F.col("bad") - F.lit(WORTH) * F.col("k"))
            .groupBy("stratum", "name").agg(F.max(F.struct("worth", "cutoff")).alias("best")))
    return best.groupBy("stratum").pivot("name", list(CUTOFFS)).agg(F.first("best.cutoff")).select(
        "stratum", *[F.col(n).alias(f"cut_{n}") for n in CUTOFFS])


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Base counts, base_failed, the rules that reject (``rejected_by``) and kept, for every row."""
    measures = stored(measured(docs, key, text, stratum), "risk-statistics")
    cuts = broadcast_if_small(stored(certified(measures, labels, key), "risk-cutoffs"))
    failed = F.concat_ws(",", *[F.when(F.col(n) > F.col(f"cut_{n}"), F.lit(n)) for n in CUTOFFS])
    return (measures.join(cuts, "stratum", "left").withColumn("rejected_by", failed)
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))
            .select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"))
