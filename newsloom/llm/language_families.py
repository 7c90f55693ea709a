"""Language identification in two steps: the family first, then the language among its relatives.

A text is a bag of hashed n-grams of letters (one to four, a blank for whatever lies between words), weighted by the
square root of their counts and scaled to unit length. Linear support vector machines with squared hinge loss separate each
family from the others; inside a family, one machine for each pair of languages votes. All machines are fitted by Spark, one task
each, on at most ``SAMPLE`` distinct labelled texts of each language: those of least hash, so the choice is the
same at any size and on any partitioning. Counts of languages, from which the hash bound is computed, cover all rows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a language that ``FAMILIES`` does not name is a
family of its own; rows with a null key, label or text are not learned from, nor is a text that stands under two
labels; with a single language known all texts get it with score 1, with none they are ``und``; ties go to the language that
sorts first; repeated rows get equal results; long texts are read whole, in pieces; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import stored
from newsloom.llm.rule_ensemble import remainder

#: Distinct labelled texts of a language that are fitted at most, hashed features, n-gram lengths, and letters read at once.
SAMPLE, BITS, ORDERS, PIECE = 1_000, 12, 4, 1 << 18
FEATURES = 1 << BITS
UNKNOWN = "und"
PENALTY, ROUNDS = 1e-4, 400

FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic", "sl": "slavic",
    "hi": "indic", "mr": "indic", "ne": "indic", "bn": "indic", "ur": "indic", "gu": "indic", "pa": "indic",
    "ar": "semitic", "he": "semitic", "fi": "uralic", "et": "uralic", "hu": "uralic", "tr": "turkic", "az": "turkic", "kk": "turkic",
}


def family(lang: str) -> str:
    return FAMILIES.get(lang, f"only {lang}")


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; null without a letter.

    A piece counts the n-grams that end in it; its last points are carried to the next one, for n-grams across the cut.
    """
    total, any_letter = np.zeros(FEATURES), False
    carried = np.array([32], np.uint64)
    for start in range(0, len(text) + 1, PIECE):
        points = np.frombuffer((text[start:start + PIECE].lower() + " " * (start + PIECE > len(text))).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters()[points]
        any_letter |= bool(letter.any())
        points = np.concatenate([carried, np.where(letter, points, 32).astype(np.uint64)])
        blank = points == 32
        points = points[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
        code = np.zeros(len(points), np.uint64)
        for n in range(1, ORDERS + 1):
            # code[e] hashes the n points that end at e.
            code = np.concatenate([code[:1], code[:-1]]) * np.uint64(0x100000001B3) + points + np.uint64(n)
            mixed = code[max(n - 1, len(carried)):]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            total += np.bincount((mixed >> np.uint64(64 - BITS)).astype(np.int64), minlength=FEATURES)
        carried = points[1 - ORDERS:]
    return total if any_letter else None


def features(text: str) -> np.ndarray | None:
    found = counts(text)
    return None if found is None else np.sqrt(found / found.sum()).astype(np.float32)


def separator(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset of a linear machine for y = 1 against y = -1: squared hinge loss, both classes weighing the
    same, by accelerated gradient steps of the length that unit vectors allow."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = z = np.zeros(x.shape[1] + 1, np.float32)
    t = 1.0
    for _ in range(ROUNDS):
        slack = np.maximum(0, 1 - y * (x @ z[:-1] + z[-1])) * y * share
        gradient = np.append(-2 * (x.T @ slack) + PENALTY * z[:-1], -2 * slack.sum())
        new = (z - gradient / 4).astype(np.float32)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z, w = (new + (before - 1) / t * (new - w)).astype(np.float32), new
    return w


def tasks_of(lang: str, langs: list[str]) -> list[tuple[str, int]]:
    """The machines that learn from texts of ``lang``, and on which side."""
    families = sorted({family(one) for one in langs})
    out = [(f"family {f}", 1 if f == family(lang) else -1) for f in families] if len(families) > 1 else []
    for other in langs:
        if other != lang and family(other) == family(lang):
            a, b = sorted((lang, other))
            out.append((f"pair {a} {b}", 1 if lang == a else -1))
    return out


@dataclass(frozen=True)
class Model:
    """Weights by machine, and the known languages in order."""

    langs: list[str]
    machines: dict[str, np.ndarray]

    def decide(self, x: np.ndarray) -> list[tuple[str, float]]:
        """Language and score of unit rows."""
        names = list(self.machines)
        margins = dict(zip(names, (x @ np.array([self.machines[n][:-1] for n in names]).T + [self.machines[n][-1] for n in names]).T, strict=True)) if names else {}
        families = sorted({family(one) for one in self.langs})
        of_family = np.stack([margins.get(f"family {f}", np.zeros(len(x))) for f in families], 1)
        chance = np.exp(2 * (of_family - of_family.max(1, keepdims=True)))
        chance /= chance.sum(1, keepdims=True)
        out = []
        for row, k in enumerate(of_family.argmax(1)):
            mine = [one for one in self.langs if family(one) == families[k]]
            points = dict.fromkeys(mine, 0.0)
            for i, a in enumerate(mine):
                for b in mine[i + 1:]:
                    p = 1 / (1 + np.exp(-4 * float(margins[f"pair {a} {b}"][row])))
                    points[a] += p / (len(mine) - 1)
                    points[b] += (1 - p) / (len(mine) - 1)
            best = max(mine, key=points.get)
            out.append((best, float(chance[row, k]) * (points[best] if len(mine) > 1 else 1.0)))
        return out


def sampled(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``lang`` and unit features of at most ``SAMPLE`` distinct texts of each language outside the held-out quarter."""
    known = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("key")) != 2))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for name, rows in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 4 * SAMPLE / rows))).otherwise(share)
    spread = 1 << 40
    least = known.withColumn("hash", F.xxhash64("text")).where(F.pmod("hash", F.lit(spread)) < share * spread)
    # Which texts are fitted is decided on hashes alone; at most SAMPLE texts of each language are then read.
    chosen = least.groupBy("hash").agg(F.min("lang").alias("lang"), F.max("lang").alias("other")).where("lang = other")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(spread)), "hash"))
    ranked = stored(chosen.withColumn("place", place).where(F.col("place") <= SAMPLE).select("lang", "hash", "place"), "language-choice")
    texts = least.select("hash", "text").join(F.broadcast(ranked), "hash").dropDuplicates(["hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, code, at, whole in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x = features(whole)
                if x is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([code]), pa.array([at], pa.int32()), pa.array([x.astype(np.float16).tobytes()], pa.binary())],
                                                     names=["lang", "hash", "place", "x"])

    return stored(texts.select("lang", "hash", "place", "text").mapInArrow(run, "lang string, hash long, place int, x binary"), "language-sample")


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    rows = sampled(docs, key, text, lang)
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    by_lang = {one: tasks_of(one, langs) for one in langs}
    names = sorted({task for own in by_lang.values() for task, _ in own})
    if not names:
        return Model(langs, {})
    member = rows.sparkSession.createDataFrame([(one, task, side) for one, own in by_lang.items() for task, side in own], "lang string, task string, side int")
    # A family's machine sees all languages, so each gives it a share of the rows that a pair may have.
    limit = F.when(F.startswith("task", F.lit("family ")), F.lit(max(1, 2 * SAMPLE // len(langs)))).otherwise(F.lit(SAMPLE))

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(group.x), np.float16).reshape(len(group), FEATURES).astype(np.float32)
        return pd.DataFrame({"task": [group.task.iloc[0]], "w": [separator(x, group.side.to_numpy(np.float32)).tobytes()]})

    taught = rows.join(F.broadcast(member), "lang").where(F.col("place") <= limit).select("task", "side", "hash", "x")
    machines = taught.groupBy("task").applyInPandas(lambda g: fitted(g.sort_values(["hash", "side"])), "task string, w binary")
    return Model(langs, {r.task: np.frombuffer(r.w, np.float32) for r in machines.collect()})


def predict(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """``key``, held_out, lang_pred and score of every row."""
    model = model or learn(docs, key, text, lang)

    def judged(texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        found = [(k, x) for k, one in enumerate(texts) if one is not None and model.langs and (x := features(one)) is not None]
        if found:
            for (k, _), answer in zip(found, model.decide(np.stack([x for _, x in found])), strict=True):
                out[k] = answer
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                names, scores = zip(*judged(part.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                                 names=[key, "held_out", "lang_pred", "score"])

    held_out: Column = F.coalesce(remainder(F.col(f"`{key}`")) == 2, F.lit(False))
    return docs.select(F.col(f"`{key}`").alias(key), held_out.alias("held_out"), F.col(f"`{text}`").alias("text" if key.lower() != "text" else "body")).mapInArrow(
        run, f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
