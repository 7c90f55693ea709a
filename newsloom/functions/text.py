"""Column expressions over titles, descriptions and entity lists."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsloom.functions.binding import let
from newsloom.functions.fold import code_point, fold_accents

# --- fixed values: must equal the published behaviour for results to match -------------------
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "hellip": "…",
}
CONTROL_CHARS = r"[\u0000-\u001f\u007f-\u009f\u200b-\u200f\u2028\u2029\ufeff]"
TITLE_MAX, DESCRIPTION_MAX, AUTHOR_MAX, COUNTRY_MAX, ENTITIES_MAX = 300, 500, 120, 60, 4000
# ---------------------------------------------------------------------------------------------

# The whitespace set of ECMAScript's \s, spelled out because Java's \s is ASCII only.
WS = r"[\t\n\u000b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
WORD_END = r"(?![A-Za-z0-9_])"
WORD_START = r"(?<![A-Za-z0-9_])"

_ENTITY_AT_START = r"^(#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z]+);"


def _entity_text(code: Column) -> Column:
    """Replacement for one entity body (``#x41``, ``#65``, ``amp``); null when it stays as is."""
    hexa = F.regexp_extract(code, r"^#[xX]0*([1-9a-fA-F][0-9a-fA-F]{0,5})$", 1)
    dec = F.regexp_extract(code, r"^#0*([1-9][0-9]{0,6})$", 1)
    number = F.when(hexa != "", F.conv(hexa, 16, 10).cast("long")).when(dec != "", dec.cast("long"))
    valid = (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    names = F.create_map(*[F.lit(x) for kv in NAMED_ENTITIES.items() for x in kv])
    return F.when(code.startswith("#"), F.when(valid, code_point(number))).otherwise(
        F.try_element_at(names, F.lower(code))
    )


def decode_entities(text: Column) -> Column:
    """HTML entities decoded in one pass (``&amp;lt;`` becomes ``&lt;``); unknown ones stay.

    An entity cannot contain a second ampersand, so decoding each ``&``-separated piece once is
    the same as one left-to-right pass and needs no Python.
    """
    parts = F.split(text, "&")

    def piece(p: Column) -> Column:
        code = F.regexp_extract(p, _ENTITY_AT_START, 1)
        rest = p.substr(F.length(code) + 2, F.length(p))
        # concat is null when the entity is unknown, which keeps the piece as it was.
        return F.coalesce(F.concat(_entity_text(code), rest), F.concat(F.lit("&"), p))

    tail = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    return F.when(
        text.contains("&"), F.concat(F.element_at(parts, 1), F.array_join(tail, ""))
    ).otherwise(text)


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    # The Arrow kernel of this name decomposes but does not compose, hence the library function.
    return pa.array([None if s is None else unicodedata.normalize("NFKC", s) for s in text.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Compatibility composition, the one text step Spark cannot express, in Arrow batches.

    Normal forms leave ASCII alone, so only other rows carry a value across. Nothing downstream
    is a Python function, so the planner never merges later expressions into this argument.
    """
    return F.coalesce(_nfkc(F.when(~text.rlike(r"^\p{ASCII}*$"), text)), text)


def clean_display_text(text: Column) -> Column:
    """Readable title or description: markup gone, provider tokenisation spacing repaired."""
    s = F.regexp_replace(nfkc(decode_entities(text)), CONTROL_CHARS, " ")
    # Composition and the control step turned every other kind of white space into a blank.
    blank = "[ \\u1680]"
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]*>", " "), blank + "+", " "))
    s = F.regexp_replace(s, blank + r"+([.,;:!?%)\]}])", "$1")
    s = F.regexp_replace(s, r"([(\[{])" + blank + "+", "$1")
    contraction = r"(?i)([A-Za-z0-9_])" + blank + r"*(['’])" + blank + r"*(s|t|re|ve|ll|d|m)" + WORD_END
    s = let(s, lambda v: F.when(v.rlike("['’]"), F.regexp_replace(v, contraction, "$1$2$3")).otherwise(v))
    s = F.regexp_replace(s, WORD_START + r"([A-Z])\." + blank + r"(?=[A-Z]\.)", "$1.")
    s = F.regexp_replace(s, blank + "*([–—])" + blank + "*", " $1 ")
    return F.trim(F.regexp_replace(s, blank + "+", " "))


def match_text(text: Column) -> Column:
    """Lower-case, accent-free words separated by single spaces; null becomes empty."""
    s = F.lower(let(let(F.coalesce(text, F.lit("")), decode_entities), fold_accents))
    s = F.regexp_replace(s, r"['’]s" + WORD_END, "")
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))


def fold_phrase(phrase: str) -> str:
    """``match_text`` of a configuration phrase (rule patterns are plain text, not entities)."""
    s = "".join(c for c in unicodedata.normalize("NFKD", phrase) if not "\u0300" <= c <= "\u036f").lower()
    s = re.sub(r"['’]s(?![A-Za-z0-9_])", "", s)
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in s).split())


def truncate_words(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a space when one lies past 60 % of the limit."""

    def shortened(cut: Column) -> Column:
        from_end = F.locate(" ", F.reverse(cut))
        last_space = F.lit(limit - 1) - from_end  # 0-based
        at_space = (from_end > 0) & (last_space > limit * 0.6)
        kept = F.when(at_space, F.substring(cut, F.lit(1), last_space)).otherwise(cut)
        return F.concat(F.regexp_replace(kept, WS + "+$", ""), F.lit("…"))

    return let(
        text,
        lambda v: F.when(F.length(v) > limit, let(F.substring(v, 1, limit - 1), shortened)).otherwise(v),
    )


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def words(text: Column) -> Column:
    """Tokens of a match text; empty array for an empty text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


# --- headline similarity ---------------------------------------------------------------------

def trigrams(text: Column) -> Column:
    """Distinct 3-grams of each word padded with two spaces before and one after."""

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: padded.substr(i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words(text), of_word)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared / united 3-grams as a 32-bit float, the precision the thresholds are defined in."""
    shared = F.size(F.array_intersect(a, b))
    return (shared / (F.size(a) + F.size(b) - shared)).cast("float")


def number_tokens(title: Column) -> Column:
    """Distinct numbers of a match text, sorted as text and joined; empty when there are none."""
    found = F.regexp_extract_all(title, F.lit(WORD_START + "([0-9]+)" + WORD_END), F.lit(1))
    return F.array_join(F.array_sort(F.array_distinct(found)), " ")
