"""Both providers in one record, one record per URL of a fetch window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.schemas import CANDIDATE

_NULLABLE_TEXT = ["provider_ref", "description", "image_url", "source_domain", "source_country", "language", "author", "entities"]


def candidates_union(*frames: DataFrame) -> DataFrame:
    """All candidates under the CANDIDATE schema; missing columns and empty strings are null."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    out = []
    for f in CANDIDATE.fields:
        if f.name not in both.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif f.name in _NULLABLE_TEXT:
            out.append(F.nullif(F.col(f.name), F.lit("")).alias(f.name))
        else:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return both.select(*out)


def window_url_distinct(candidates: DataFrame, *window_keys: str) -> DataFrame:
    """The first candidate per exact URL inside one fetch window.

    Only URLs and arrival numbers are aggregated, per task before the shuffle; whole rows then meet
    their own arrival number, so that copies of one hot URL are not dealt to one task.
    """
    firsts = candidates.groupBy(*window_keys, "url").agg(F.min("arrival").alias("arrival"))
    return candidates.join(firsts, [*window_keys, "url", "arrival"], "left_semi").select(*candidates.columns)
