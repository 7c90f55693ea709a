"""JSON answers of the provider's search interface, landed as one file per answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.schemas import DOC_ANSWER

PROVIDER = "gdelt-doc"
MIN_SEENDATE_CHARS = 8


def read_answers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, value)``: one row per answer file, the whole text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def answer_items(answers: DataFrame) -> DataFrame:
    """One row per item (or one empty row) with ``outcome``: ok, skipped, empty, rejected, malformed.

    Plain text is a refused query, broken JSON is repaired by blanking control characters, and an
    ``articles`` value of another type is malformed.
    """
    body = F.trim(F.regexp_replace("value", r"[\u0000-\u001f]+", " "))
    empty = body.isin("", "{}", "{ }")
    shape = F.get_json_object("body", "$.articles")
    shaped = (
        answers.withColumn("body", body)
        .withColumn("shape", shape)
        .withColumn("parsed", F.from_json("body", DOC_ANSWER, {"mode": "PERMISSIVE"}))
        .withColumn("valid", F.try_parse_json("body").isNotNull())
    )
    kind = (
        F.when(F.col("body").isin("", "{}", "{ }"), "empty")
        .when(~F.col("body").startswith("{"), "rejected")
        .when(~F.col("valid"), "malformed")
        .when(F.expr("is_variant_null(try_variant_get(try_parse_json(body), '$.articles', 'variant'))"), "malformed")
        .when(F.col("shape").isNull(), "empty")
        .when(~F.col("shape").startswith("["), "malformed")
        .otherwise("items")
    )
    keep = [c for c in answers.columns if c != "value"]
    rows = shaped.withColumn("kind", kind).select(
        *keep, "kind", F.explode_outer(F.when(F.col("kind") == "items", F.col("parsed.articles"))).alias("a"),
        F.col("kind").alias("_k"),
    )
    good = (
        (F.coalesce(F.length("a.url"), F.lit(0)) > 0)
        & (F.coalesce(F.length("a.seendate"), F.lit(0)) >= MIN_SEENDATE_CHARS)
        & (F.trim(F.coalesce("a.title", F.lit(""))) != "")
    )
    outcome = F.when(F.col("kind") != "items", F.col("kind")).when(good, "ok").otherwise("skipped")
    return rows.select(*keep, "a", outcome.alias("outcome"))


def to_candidates(items: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Candidates of the good items; blanks become null."""

    def text(name: str):
        return F.when(F.col(f"a.{name}") != "", F.col(f"a.{name}"))

    null = F.lit(None).cast("string")
    return items.filter("outcome = 'ok'").select(
        F.lit(PROVIDER).alias("provider"), null.alias("provider_ref"), F.col("a.url").alias("url"),
        F.col("a.title").alias("title"), null.alias("description"), text("socialimage").alias("image_url"),
        text("domain").alias("source_domain"), text("sourcecountry").alias("source_country"),
        text("language").alias("language"), null.alias("author"), F.col("a.seendate").alias("published_at"),
        null.alias("entities"), F.col(query_id).cast("int").alias("matched_query_id"),
        F.create_map(F.lit("seendate"), F.col("a.seendate"), F.lit("domain"), F.col("a.domain")).alias("metadata"),
    )


def answer_counts(items: DataFrame) -> DataFrame:
    """``(outcome, n)`` over all answers."""
    return items.groupBy("outcome").agg(F.count("*").alias("n"))


def scan_doc_json(spark: SparkSession, path: str | list[str], query_id: int | Column) -> tuple[DataFrame, DataFrame]:
    """``(candidates, outcome counts)`` of answer files; ``query_id`` may be read from the column ``file``."""
    number = query_id if isinstance(query_id, Column) else F.lit(query_id)
    items = answer_items(read_answers(spark, path)).withColumn("query_id", number)
    return to_candidates(items), answer_counts(items)
