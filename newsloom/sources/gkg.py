"""Archive files: 27 tab-separated columns per line, one file per 15 minutes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.rules import java_pattern
from newsloom.functions.text import decode_entities, match_text
from newsloom.functions.url import url_match_text

# --- fixed values: public archive format -----------------------------------------------------
COLUMNS = 27
RECORD_ID, DATE, SOURCE_NAME, DOCUMENT_URL, THEMES, LOCATIONS = 0, 1, 3, 4, 7, 9
PERSONS, ORGANIZATIONS, SHARING_IMAGE, ALL_NAMES, EXTRAS = 11, 13, 18, 23, 26
MAX_THEMES = 15
PROVIDER = "gdelt-gkg"
# ---------------------------------------------------------------------------------------------


def page_title(extras: Column) -> Column:
    """Decoded ``<PAGE_TITLE>`` of the extras column; blank becomes null."""
    raw = F.regexp_extract(extras, r"(?s)<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1)
    title = F.trim(decode_entities(raw))
    return F.when(title != "", title)


def name_list(column: Column, part: int | None = None) -> Column:
    """Names of a ``;`` list: text before the first comma, or the n-th ``#`` part."""

    def name(entry: Column) -> Column:
        if part is None:
            return F.trim(F.substring_index(entry, ",", 1))
        return F.trim(F.coalesce(F.try_element_at(F.split(entry, "#"), F.lit(part + 1)), F.lit("")))

    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ";"), name), lambda n: n != "")


def sorted_lines(lines: DataFrame, anchor: str) -> DataFrame:
    """Lines (column ``value``) with their fields ``f``, title, persons, others and ``outcome``.

    A line is filtered (it names the anchor nowhere; the case-insensitive test on the raw line comes first and
    is part of the meaning: it can drop a line whose accented title would match only after folding), short (too few columns: kept
    apart as corrupt), no_url, no_title, off_topic (title, URL and persons do not name the anchor), or kept. Empty lines are none.
    A column is computed only for lines that got as far as needing it.
    """
    value = F.regexp_replace("value", "\r$", "")
    fields = F.split("value", "\t")
    at = lambda k: F.get("f", F.lit(k))
    named = F.rlike(F.col("value"), F.lit("(?i)" + java_pattern(anchor)))
    parted = lines.withColumn("value", value).filter(F.col("value") != "").withColumn("f", F.when(named, fields))
    reached = parted.withColumn("outcome", F.when(F.col("f").isNull(), "filtered").when(F.size("f") < COLUMNS, "short").when(
        ~F.coalesce(at(DOCUMENT_URL).rlike("(?i)^https?://"), F.lit(False)), "no_url"))
    open_ = F.col("outcome").isNull()
    titled = reached.withColumn("title", F.when(open_, page_title(at(EXTRAS))))
    whole = titled.withColumn("outcome", F.when(open_ & F.col("title").isNull(), "no_title").otherwise(F.col("outcome"))).withColumns({
        "persons": F.when(open_, name_list(at(PERSONS))),
        "others": F.when(open_, F.concat(name_list(at(ORGANIZATIONS)), name_list(at(LOCATIONS), 1), name_list(at(ALL_NAMES)))),
    })
    about = F.concat_ws(" ", match_text(F.col("title")), url_match_text(at(DOCUMENT_URL)), match_text(F.array_join("persons", " ; ")))
    return whole.withColumn("outcome", F.when(open_, F.when(F.rlike(about, F.lit(java_pattern(anchor))), "kept").otherwise("off_topic")).otherwise(F.col("outcome")))


def candidates_of(lines: DataFrame) -> DataFrame:
    """Candidates of the kept ones of ``sorted_lines``."""
    themes = F.filter(F.split(F.get("f", F.lit(THEMES)), ";"), lambda x: x != "")

    def text(i: int) -> Column:
        return F.when(F.get("f", F.lit(i)) != "", F.get("f", F.lit(i)))

    return lines.filter("outcome = 'kept'").select(
        F.lit(PROVIDER).alias("provider"),
        text(RECORD_ID).alias("provider_ref"),
        F.get("f", F.lit(DOCUMENT_URL)).alias("url"),
        "title",
        F.lit(None).cast("string").alias("description"),
        text(SHARING_IMAGE).alias("image_url"),
        text(SOURCE_NAME).alias("source_domain"),
        F.lit(None).cast("string").alias("source_country"),
        F.lit("English").alias("language"),
        F.lit(None).cast("string").alias("author"),
        F.get("f", F.lit(DATE)).alias("published_at"),
        F.array_join(F.array_distinct(F.concat("persons", "others")), " ; ").alias("entities"),
        F.lit(None).cast("int").alias("matched_query_id"),
        F.create_map(
            F.lit("gkgRecordId"), F.get("f", F.lit(RECORD_ID)),
            F.lit("themes"), F.array_join(F.slice(themes, 1, MAX_THEMES), ";"),
        ).alias("metadata"),
    )


def parse_lines(lines: DataFrame, anchor: str) -> DataFrame:
    """Candidates of the lines that name the anchor in title, URL or persons."""
    return candidates_of(sorted_lines(lines, anchor))


OUTCOMES = ["filtered", "short", "no_url", "no_title", "off_topic", "kept"]


@dataclass(frozen=True)
class Scan:
    """Candidates of archive files, the corrupt lines apart, and counts that are there once the candidates were written."""

    candidates: DataFrame
    corrupt: DataFrame
    seen: Observation

    def counts(self) -> dict[str, int]:
        return {name: int(self.seen.get[name]) for name in ("lines", *OUTCOMES)}


def scan_gkg(spark: SparkSession, path: str | list[str], anchor: str) -> Scan:
    """One pass over archive files (plain or gzip text; a directory or list of paths).

    Lines are counted while they stream by (``Dataset.observe``), so counting costs no second read.
    """
    lines = sorted_lines(spark.read.text(path).withColumn("file", F.input_file_name()), anchor)
    seen = Observation(f"archive-{uuid.uuid4().hex}")
    counted = lines.observe(seen, F.count("*").alias("lines"), *[F.count_if(F.col("outcome") == name).alias(name) for name in OUTCOMES])
    return Scan(candidates_of(counted), lines.filter("outcome = 'short'").select("file", "value"), seen)
