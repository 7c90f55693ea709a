"""The queries of the corpus operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import (language_families, merkle_manifest, order_minhash, paragraph_minhash, piece_bpe, risk_rules, rule_ensemble, secrets,
                          spaced_seeds, suffix_dedup, uniform_shards, url_models, whitening)
from newsloom.llm.common import table

PIECE_MODEL = "piece_bpe_32k.model"


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for repositories, their sources for owners."""
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_classes(table(spark, sf_dir, "documents"))


def op3_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_minhash.repeats(table(spark, sf_dir, "documents"))


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return piece_bpe.digests(piece_bpe.encode_decode(docs, public_tokenizers.path(PIECE_MODEL)))


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_models.judge(table(spark, sf_dir, "pages"))


def op7_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniform_shards.place(table(spark, sf_dir, "documents"))


def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.deduplicate(table(spark, sf_dir, "documents")))


def op10_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id 5 divides by its checksum are checked with a text in lower case."""
    suspect = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle_manifest.witnesses(table(spark, sf_dir, "documents"), suspect=suspect, now={"text": merkle_manifest.lowered(F.col("text"))})
    return merkle_manifest.verified(found)


def op13_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_families.predict(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_ownership, op2_order_minhash, op3_paragraph_minhash, op4_piece_encoding, op5_spaced_seeds,
                               op6_url_models, op7_uniform_shards, op8_rule_ensemble, op9_suffix_dedup, op10_risk_rules, op11_whitening,
                               op12_merkle_manifest, op13_language_families)
}


def _levels(first: str, name: str, count: int) -> str:
    """Common table expressions of a tree over ``first`` (t, i, h, n): nodes ``name0`` up, and the siblings of each node."""
    out = [f"{name}0 AS (SELECT t, i, h, n FROM {first})"]
    for k in range(count):
        run = "OVER (PARTITION BY t, i // 16 ORDER BY i ROWS BETWEEN"
        out.append(f"""{name}w{k} AS (SELECT t, i, n, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})""")
        out.append(f"""{name}{k + 1} AS (SELECT t, i // 16 AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h,
  (n + 15) // 16 AS n FROM {name}{k} GROUP BY t, i // 16, n)""")
    return ",\n".join(out)


def _folds(first: str, name: str, tree: str, count: int, tree_name: str, place: str) -> str:
    """Walk up ``count`` levels of ``tree``: ``f`` is the node so far and ``p`` the siblings met."""
    out = [f"{name}0 AS (SELECT * FROM {first})"]
    for k in range(count):
        out.append(f"""{name}{k + 1} AS (SELECT a.* EXCLUDE (f, p), CASE WHEN b.n > 1 THEN sha256(b.l || a.f || b.r) ELSE a.f END AS f,
  CASE WHEN b.n > 1 THEN a.p || b.l || b.r ELSE a.p END AS p FROM {name}{k} a JOIN {tree}w{k} b ON a.{tree_name} IS NOT DISTINCT FROM b.t AND a.{place} // {16**k} = b.i)""")
    return ",\n".join(out)


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
#: Trees of five levels (a million leaves a source) under one of three (4,096 sources).
MANIFEST_SQL = f"""WITH leaves AS (SELECT doc_id, source, {_LEAF.format("text")} AS leaf,
  CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
bottom AS (SELECT source AS t, i, leaf AS h, n FROM placed),
{_levels("bottom", "s", 5)},
groups AS (SELECT 0 AS t, row_number() OVER (ORDER BY encode(t) NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, t AS source FROM s5),
{_levels("groups", "g", 3)},
start AS (SELECT p.doc_id, p.source, p.leaf, p.i, 0 AS top, g.i AS gi, g.h AS subroot, (SELECT h FROM g3) AS root, coalesce(p.changed, p.leaf) AS f, '' AS p
  FROM placed p JOIN groups g ON p.source IS NOT DISTINCT FROM g.source),
{_folds("start", "a", "s", 5, "source", "i")},
{_folds("a5", "b", "g", 3, "top", "gi")}
SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM b3"""
ORACLES: dict[str, str] = {"op12_merkle_manifest": MANIFEST_SQL}
