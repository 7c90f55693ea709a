"""Secret scan by corpus-wide ownership.

Every text is searched for candidates: assignments, access keys and hex runs (the base findings), and
long mixed tokens. Their values are hashed and aggregated over the corpus: in how many repositories and
under how many owners does a value stand? A value that several owners carry is a copied example; one that
stays with a single owner and looks random is a live-looking credential. Base findings are always kept;
mixed tokens are added only where the corpus says that they are owner-specific and live-looking.

Work: one pass of regular expressions; (value, repository) pairs are made distinct before they are
counted, so that a value in a third of all rows costs one row per task; the texts are never shuffled.

Defined cases: a null text counts as empty and has no findings; a null owner or repository counts as one
unnamed owner or repository; repeated rows count once, but each gets its findings; no row is dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import over_batches, stored

# --- fixed values: the kinds of base findings -------------------------------------------------
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex", "mixed"]
# ---------------------------------------------------------------------------------------------
#: A mixed token is a whole run of these characters, 20 or more, with digits and letters.
MIXED = re.compile(r"[A-Za-z0-9+/_-]+")
_DIGIT, _SMALL, _MIXED_LEFT, MIXED_CHARS = re.compile(r"[0-9]"), re.compile(r"[a-z]"), re.compile(r"[^A-Za-z0-9+/_-]"), 20
#: Bits per character from which a value looks random; owners from which it is a copied example.
LIVE_BITS, EXAMPLE_OWNERS = 3.0, 3

_FOUND = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType()),
    T.StructField("hash", T.LongType()), T.StructField("random", T.BooleanType())]))


def bits(value: str) -> float:
    """Shannon entropy in bits per character."""
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values()) if n else 0.0


def mixed(text: str) -> list[tuple[int, int, str]]:
    """Whole runs of token characters that hold a digit and a small letter, 20 characters or more."""
    out, done = [], 0
    for digit in _DIGIT.finditer(text):
        if (at := digit.start()) < done:
            continue
        start = at
        while start > done and not _MIXED_LEFT.match(text, start - 1):
            start -= 1
        done = MIXED.match(text, at).end()
        if done - start >= MIXED_CHARS and _SMALL.search(text, start, done):
            out.append((start, done, text[start:done]))
    return out


def find(text: str | None) -> list[tuple]:
    """(start, kind, end, value hash, looks random) of every candidate, by start and kind."""
    if not text:
        return []
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = [(s, e) for s, _, e, _ in found]
    found += [(s, 3, e, v) for s, e, v in mixed(text) if not any(a < e and s < b for a, b in base)]
    found.sort()
    return [(s, k, e, int.from_bytes(blake2b(v.encode(), digest_size=8).digest(), "little", signed=True), bits(v) >= LIVE_BITS)
            for s, k, e, v in found]


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Key, owner, repository and ``found`` for every row; written once to the shared folder."""
    named = docs.select(F.col(key).alias("key"), F.col(owner).cast("string").alias("owner"),
                        F.col(repository).cast("string").alias("repository"), F.col(text).alias("text"))
    schema = T.StructType([named.schema["key"], T.StructField("owner", T.StringType()), T.StructField("repository", T.StringType()),
                           T.StructField("found", _FOUND)])
    return stored(over_batches(named, ["key", "owner", "repository", "text"], schema,
                               lambda batch: ((k, o, r, find(t)) for k, o, r, t in batch)), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories and class (example, live, other) of every candidate value."""
    values = found.select(F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"),
                          F.explode("found").alias("x")).select("owner", "repository", "x.hash", "x.random")
    return (values.groupBy("hash", "owner", "repository").agg(F.max("random").alias("random"))
            .groupBy("hash", "owner").agg(F.count("*").alias("n"), F.max("random").alias("random"))
            .groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"), F.max("random").alias("random"))
            .withColumn("class", F.when(F.col("n_owners") >= EXAMPLE_OWNERS, "example")
                        .when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("other")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Key and ``spans`` (array of start, kind, end, class, n_owners, n_repositories by start and kind) for
    every row: all base findings, and mixed tokens of class live. Offsets count code points, ends are exclusive."""
    found = candidates(docs, key, text, owner, repository).withColumn("row", F.monotonically_increasing_id())
    found = stored(found, "secret-rows")
    owned = ownership(found)
    spans = (found.select("row", F.explode("found").alias("x")).select("row", "x.*").drop("random")
             .join(owned, "hash")
             .where((F.col("kind") < 3) | (F.col("class") == "live"))
             .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "class", "n_owners", "n_repositories"))).alias("spans")))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return (found.select("row", F.col("key").alias(key)).join(spans, "row", "left")
            .select(key, F.coalesce("spans", empty).alias("spans")))


def _joined(spans: str, base: bool) -> str:
    kept = f"filter({spans}, x -> x.kind < 3)" if base else spans
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({kept}, x -> concat(element_at(array({names}), x.kind + 1), ':', x.start, ':', x.end)), ',')"


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The result of query op1."""
    count = lambda test: F.expr(f"cast(size(filter(spans, x -> {test})) as bigint)")
    return scanned.select(
        key, count("x.kind = 0").alias("n_assign"), count("x.kind = 1").alias("n_access"), count("x.kind = 2").alias("n_hex"),
        F.sha2(F.expr(_joined("spans", True)).cast("binary"), 256).alias("base_sha256"),
        F.expr(_joined("spans", False)).alias("spans"),
        count("x.class = 'live'").alias("n_live"), count("x.class = 'example'").alias("n_example"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", marker: str = "[SECRET]") -> DataFrame:
    """The same rows with the findings of every text replaced by ``marker``, except copied examples. Findings meet their rows by
    the digest of the text, so keys may repeat or be null. Spans of a text may overlap; their union is cut. Null texts stay null."""
    named = docs.select(F.md5(text).alias("redact__digest"), F.col(text).alias("text"), F.col(owner).alias("owner"), F.col(key).alias("repository"))
    spans = (scan(named.where("text is not null"), "redact__digest", "text", "owner", "repository")
             .select(F.col("redact__digest"), F.expr("filter(spans, x -> x.class <> 'example')").alias("redact__spans"))
             .where("size(redact__spans) > 0").dropDuplicates(["redact__digest"]))
    word = "'" + marker.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cut = f"""aggregate(redact__spans, named_struct('at', 0L, 'out', ''),
      (a, x) -> if(x.end <= a.at, a, named_struct('at', x.end, 'out', if(x.start < a.at, a.out,
        concat(a.out, substring(`{text}`, cast(a.at + 1 as int), cast(x.start - a.at as int)), {word})))),
      a -> concat(a.out, substring(`{text}`, cast(a.at + 1 as int))))"""
    joined = docs.join(spans, F.md5(docs[text]) == spans["redact__digest"], "left")
    clean = F.when(F.col("redact__spans").isNull(), F.col(text)).otherwise(F.expr(cut))
    return joined.select(*[clean.alias(c) if c == text else docs[c] for c in docs.columns])
