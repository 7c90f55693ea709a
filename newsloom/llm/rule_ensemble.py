"""Quality classifier: a sparse ensemble of rules.

Statistics of every text are native columns, computed in one pass and stored. Shallow trees are grown on a
bounded sample of labelled rows; every path from a root is a conjunctive rule; a lasso logistic fit keeps
few of them; the kept rules are compiled into one column expression, so scoring has no Python.

Only the sample of labelled rows (``SAMPLE_ROWS`` at most, the rows with the smallest hash of the key) comes
to the driver. Labels serve the fit only: the score is a function of the text alone.

Defined cases: a null text counts as empty; empty texts are scored by the same rules; a key with
contradicting labels, a null label or a null key is not learned from; without both classes the score is the
smoothed share of label 1; repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import BROADCAST_ROWS, broadcast_if_small, stored

#: Bound of the labelled rows that are fitted, and size of the ensemble.
SAMPLE_ROWS, TREES, DEPTH, MIN_LEAF = 20_000, 40, 3, 8
PENALTIES = (0.03, 0.01, 0.003, 0.001)
ACCEPT = 0.7

STATISTICS = ["log_chars", "word_chars", "symbols", "marks", "bars", "capitals", "digits", "line_ends", "repeated_words", "repeated_lines", "long_words"]


def statistics(text: Column) -> dict[str, Column]:
    """Native statistics of a text, all finite, from its words and lines."""
    body = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(body), F.lit(1)).cast("double")
    without = lambda gone: (F.length(body) - F.length(F.translate(body, gone, ""))) / chars
    return {
        "log_chars": F.log1p(F.length(body).cast("double")),
        "symbols": without("#*$%&<>@^~={}[]\\"), "marks": without("!?"), "bars": without("|"), "digits": without("0123456789"),
        "line_ends": without("\n"),
        "capitals": (F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}+", ""))) / chars,
        "words": F.filter(F.split(F.lower(body), r"[^\p{L}\p{N}]+"), lambda w: w != ""),
        "lines": F.filter(F.split(body, "\n"), lambda w: F.trim(w) != ""),
    }


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """``key`` and the statistics of every row; with ``whole`` also the row itself, as a struct, and a number."""
    extra = {"_row": F.struct(*[docs[f"`{c}`"] for c in docs.columns])} if whole else {}
    first = docs.select(F.col(key).alias(key), *[c.alias(n) for n, c in extra.items()], *[c.alias(n) for n, c in statistics(F.col(text)).items()])
    n, lines = F.size("words"), F.size("lines")
    share = lambda part, whole: F.coalesce(part / F.when(whole > 0, whole), F.lit(0.0)).cast("double")
    second = first.select(
        key, *extra, *[c for c in STATISTICS if c in first.columns],
        share(F.length(F.array_join("words", "")), n).alias("word_chars"),
        share(n - F.size(F.array_distinct("words")), n).alias("repeated_words"),
        share(lines - F.size(F.array_distinct("lines")), lines).alias("repeated_lines"),
        share(F.size(F.filter("words", lambda w: F.length(w) > 14)), n).alias("long_words"))
    # The number keeps filters above the last projection, so that no rule computes a statistic again.
    number = [F.monotonically_increasing_id().alias("_number")] if whole else []
    return second.select(key, *extra, *STATISTICS, *number)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above?, cut)."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, cut in self.tests:
            out &= (x[:, j] > cut) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for j, above, cut in self.tests:
            c = F.col(STATISTICS[j])
            out = out & ((c > cut) if above else (c <= cut))
        return out


def split(x: np.ndarray, y: np.ndarray, columns: np.ndarray) -> tuple[int, float] | None:
    """The cut that lowers Gini impurity most, with enough rows on both sides."""
    best, found, n = 1e-9, None, len(y)
    whole = y.mean() * (1 - y.mean())
    for j in columns:
        order = np.argsort(x[:, j], kind="stable")
        v, ones = x[order, j], np.cumsum(y[order])
        k = np.arange(1, n)
        left, right = ones[:-1] / k, (ones[-1] - ones[:-1]) / (n - k)
        gain = whole - (k * left * (1 - left) + (n - k) * right * (1 - right)) / n
        gain[(v[1:] == v[:-1]) | (k < MIN_LEAF) | (n - k < MIN_LEAF)] = 0
        if len(gain) and gain[i := int(gain.argmax())] > best:
            best, found = gain[i], (int(j), float((v[i] + v[i + 1]) / 2))
    return found


def paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, tests: tuple = ()) -> list[Rule]:
    """Grow one tree; every node below the root is a rule."""
    columns = rng.choice(x.shape[1], (x.shape[1] + 1) // 2, replace=False)
    if len(tests) == DEPTH or len(y) < 2 * MIN_LEAF or (cut := split(x, y, columns)) is None:
        return []
    out = []
    for above in (True, False):
        side, mine = (x[:, cut[0]] > cut[1]) == above, (*tests, (cut[0], above, cut[1]))
        out += [Rule(tuple(sorted(mine))), *paths(x[side], y[side], rng, mine)]
    return out


def lasso(r: np.ndarray, ones: np.ndarray, zeros: np.ndarray, penalty: float, start: np.ndarray | None = None,
          rounds: int = 300, still: float = 1e-4) -> np.ndarray:
    """Offset and logistic weights with an L1 penalty, by accelerated proximal gradient from ``start``, until no weight
    moves by ``still``. Row k of ``r`` stands for ``ones[k]`` rows of label 1 and ``zeros[k]`` of label 0."""
    a = np.column_stack([np.ones(len(r), np.float32), r])
    rows, n = ones + zeros, max(float(ones.sum() + zeros.sum()), 1.0)
    # The largest eigenvalue of the weighted Gram matrix, a little over what power iteration finds.
    v = np.ones(a.shape[1], np.float32)
    for _ in range(20):
        v = a.T @ (rows * (a @ v))
        size = float(np.linalg.norm(v))
        v /= max(size, 1e-9)
    step = 4 * n / max(1.1 * size, 1e-9)
    w = z = np.zeros(a.shape[1]) if start is None else start
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ z.astype(np.float32), -30, 30).astype(float)))
        new = z - step * (a.T @ (rows * p - ones).astype(np.float32)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z = new + (before - 1) / t * (new - w)
        moved, w = np.abs(new - w).max(), new
        if moved < still:
            break
    return w


@dataclass(frozen=True)
class Ensemble:
    base: float
    weights: tuple[float, ...]
    rules: tuple[Rule, ...]

    def column(self) -> Column:
        total = F.lit(self.base)
        for w, rule in zip(self.weights, self.rules, strict=True):
            total = total + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 8) -> Ensemble:
    """Rules of many small trees, then the largest lasso penalty whose loss on every fifth row is within a
    standard error of the least, refitted on all rows."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(np.log(share / (1 - share))), (), ())
    rng = np.random.default_rng(seed)
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        rows = rng.choice(len(y), max(len(y) // 2, min(len(y), 50)), replace=False)
        rules |= dict.fromkeys(paths(x[rows], y[rows], rng))
    if not rules:
        return Ensemble(float(np.log(y.mean() / (1 - y.mean()))), (), ())
    # Rules that hold for the same rows are one, and so are rows for which the same rules hold.
    held, kept = {}, []
    for rule in rules:
        bits = np.packbits(rule.holds(x)).tobytes()
        if bits not in held:
            held[bits] = None
            kept.append(rule)
    packed = np.array([np.frombuffer(bits, np.uint8) for bits in held])
    columns = np.unpackbits(packed, axis=1, count=len(y)).T
    patterns, of = np.unique(np.packbits(columns, axis=1), axis=0, return_inverse=True)
    r = np.unpackbits(patterns, axis=1, count=len(kept)).astype(np.float32)
    tally = lambda rows: np.bincount(of.ravel()[rows], minlength=len(r)).astype(np.float32)
    test = np.arange(len(y)) % 5 == 4
    ones, zeros, test_ones, test_zeros = (tally(rows) for rows in (~test & (y == 1), ~test & (y == 0), test & (y == 1), test & (y == 0)))
    losses, w = [], None
    for penalty in PENALTIES:  # from few rules to many, each from the weights before
        w = lasso(r, ones, zeros, penalty, w)
        s = np.clip(w[0] + r @ w[1:], -30, 30)
        each = np.repeat(np.concatenate([np.log1p(np.exp(-s)), np.log1p(np.exp(s))]), np.concatenate([test_ones, test_zeros]).astype(int))
        losses.append((float(each.mean()), float(each.std()) / max(len(each), 1) ** 0.5) if len(each) else (0.0, 0.0))
    best = min(losses)
    b, *w = lasso(r, ones + test_ones, zeros + test_zeros, next(p for p, x in zip(PENALTIES, losses, strict=True) if x[0] <= sum(best)))
    order = [i for i in np.argsort(-np.abs(w)) if abs(w[i]) > 1e-6]
    return Ensemble(float(b), tuple(float(w[i]) for i in order), tuple(kept[i] for i in order))


def remainder(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4


def learn(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_rows: int = SAMPLE_ROWS) -> Ensemble:
    """Fit on labelled rows outside the held-out quarter (remainder 2).

    The rows with the least hashes of their keys are fitted: a threshold computed from the count of labelled keys leaves a few more
    than ``max_rows`` of them in all, whatever the number of tasks. Of several texts of one key the least statistics are taken.
    """
    known = stored(labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key)
                   .agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low = high")
                   .where(remainder(F.col(key)) != 2).select(key, F.col("low").alias("label")), "quality-known")
    spread = 1 << 40
    share = min(1.0, 1.05 * max_rows / max(known.count(), 1) + 1e-6)
    place = F.pmod(F.xxhash64(key), F.lit(spread))
    chosen = known.where(place < share * spread)
    rows = (stats.join(broadcast_if_small(chosen, 2 * max_rows), key).groupBy(key, "label").agg(F.min(F.struct(*STATISTICS)).alias("s"))
            .orderBy(place, key).limit(max_rows).select(F.col("label").cast("double").alias("label"), "s.*").toArrow())
    data = np.column_stack([c.to_numpy() for c in rows.columns]) if rows.num_rows else np.zeros((0, len(STATISTICS) + 1))
    return fit(data[:, 1:], data[:, 0])


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, score and predicted for every row."""
    stats = stored(measured(docs, key, text), "quality-statistics")
    model = learn(stats, labels, key)
    return (stats.select(key, F.coalesce(remainder(F.col(key)) == 2, F.lit(False)).alias("held_out"), model.column().alias("score"))
            .withColumn("predicted", (F.col("score") >= ACCEPT).cast("int")))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows predicted good, unchanged: each is judged by its own text, whatever its key is or how often it stands."""
    known = stored(labels.where(F.col("quality").isin(0, 1) & F.col(key).isNotNull()).select(key).distinct(), "quality-labelled")
    some = docs.join(F.broadcast(known), key, "left_semi") if known.count() <= BROADCAST_ROWS else docs
    model = learn(stored(measured(some, key, text), "quality-statistics"), labels, key)
    return measured(docs, key, text, whole=True).where((model.column() >= ACCEPT) & (F.col("_number") >= 0)).select("_row.*")
