"""Rules (rows of a table) compiled to Column expressions over match text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.binding import let
from newsloom.functions.text import WS, fold_phrase

# --- fixed values ----------------------------------------------------------------------------
RULE_FIELDS = ["title", "description", "url", "entities"]
REGEX_COUNT_MAX = 101
DEFAULT_MAX_DISTANCE = 5
# ---------------------------------------------------------------------------------------------
MAX_RULES = 10_000
_BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


@dataclass(frozen=True)
class Rule:
    """One relevance rule row."""

    name: str
    rule_type: str
    pattern: str
    weight: float
    fields: tuple[str, ...] = tuple(RULE_FIELDS)
    pattern_b: str | None = None
    max_distance: int | None = None

    def __post_init__(self) -> None:
        if self.rule_type not in ("phrase", "regex", "proximity"):
            raise ValueError(f"unknown rule type {self.rule_type!r}")
        if not set(self.fields) <= set(RULE_FIELDS):
            raise ValueError(f"unknown field in {self.fields}")
        if not 1 <= len(self.pattern) <= 500:
            raise ValueError("pattern must have 1 to 500 characters")
        if self.rule_type == "proximity" and not (self.pattern_b and self.max_distance):
            raise ValueError("a proximity rule needs pattern_b and max_distance")


@dataclass(frozen=True)
class RelevanceConfig:
    accept_threshold: float
    review_threshold: float
    anchor_pattern: str = ""
    field_multipliers: dict[str, float] = field(
        default_factory=lambda: {"title": 1.0, "description": 0.7, "url": 0.6, "entities": 0.8}
    )
    country_boosts: dict[str, float] = field(default_factory=dict)
    multi_query_bonus: float = 5.0
    frequency_bonus_per_extra: float = 0.1
    frequency_bonus_cap: int = 3

    def __post_init__(self) -> None:
        if self.review_threshold > self.accept_threshold:
            raise ValueError("review_threshold must not exceed accept_threshold")


def rules_from(table: DataFrame, max_rules: int = MAX_RULES) -> list[Rule]:
    """Enabled rules of a RULE table in id order. Rules become expressions, so more than ``max_rules`` are refused."""
    rows = table.filter("enabled").orderBy("id").limit(max_rules + 1).collect()
    if len(rows) > max_rules:
        raise ValueError(f"more than {max_rules} rules")
    return [
        Rule(r.name, r.rule_type, r.pattern, r.weight, tuple(r.fields), r.pattern_b, r.max_distance)
        for r in rows
    ]


def java_pattern(pattern: str) -> str:
    """A rule pattern with ``\\b`` and ``\\s`` given the ASCII / Unicode meaning rules rely on."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "\\b" and not in_class:
            out.append(_BOUNDARY)
        elif two == "\\s":
            out.append(WS[1:-1] if in_class else WS)
        elif two[0] == "\\":
            out.append(two)
        else:
            in_class = two[0] == "[" or (in_class and two[0] != "]")
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def phrase_alternatives(pattern: str) -> list[str]:
    return [p for p in map(fold_phrase, pattern.split("|")) if p]


def phrase_pattern(pattern: str) -> str | None:
    alternatives = phrase_alternatives(pattern)
    if not alternatives:
        return None
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(alternatives) + r")(?![\p{L}\p{N}])"


def _spans_of(tokens: Column, phrase: str) -> Column:
    words = phrase.split(" ")

    def at(word: Column, i: Column) -> Column:
        hit = word == words[0]
        for k, w in enumerate(words[1:], 1):
            hit = hit & (F.get(tokens, i + k) == w)
        return F.when(hit, F.struct(i.alias("start"), (i + (len(words) - 1)).alias("end")))

    return F.filter(F.transform(tokens, at), lambda s: s.isNotNull())


def _spans(tokens: Column, phrases: list[str]) -> Column:
    """``array<struct<start,end>>`` of every occurrence of every phrase, in phrase order."""
    return F.concat(*[_spans_of(tokens, p) for p in phrases])


def proximity_count(text: Column, pattern: str, pattern_b: str, max_distance: int) -> Column:
    """Occurrences of a phrase with some other phrase at token distance 1..max_distance."""
    first, second = phrase_alternatives(pattern), phrase_alternatives(pattern_b)
    if not first or not second:
        return F.lit(0)

    def mentions(phrases: list[str]) -> Column:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | text.contains(p)
        return hit

    def counted(spans: Column) -> Column:
        def near(x: Column) -> Column:
            return F.exists(
                spans.b,
                lambda y: (y.start - x.end).between(1, max_distance) | (x.start - y.end).between(1, max_distance),
            )

        return F.size(F.filter(spans.a, near))

    spans = let(
        F.split(text, " "),
        lambda tokens: let(F.struct(_spans(tokens, first).alias("a"), _spans(tokens, second).alias("b")), counted),
    )
    return F.when(mentions(first) & mentions(second), spans).otherwise(0)


def occurrences(rule: Rule, text: Column) -> Column:
    """How often a rule matches one segment of match text."""
    if rule.rule_type == "phrase":
        pattern = phrase_pattern(rule.pattern)
        return F.regexp_count(text, F.lit(pattern)) if pattern else F.lit(0)
    if rule.rule_type == "regex":
        return F.least(F.regexp_count(text, F.lit(java_pattern(rule.pattern))), F.lit(REGEX_COUNT_MAX))
    return proximity_count(text, rule.pattern, rule.pattern_b, rule.max_distance or DEFAULT_MAX_DISTANCE)


def round2(x: Column) -> Column:
    """Two decimals, halves up, the way binary doubles round after scaling by 100."""
    return F.floor(x * 100 + 0.5) / 100.0
