"""Whitening, Merkle manifest and language identification against plain versions."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import difference
from newsloom.llm import language_families, merkle_manifest, whitening
from newsloom.llm.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
VECTORS = "vec_id long, embedding array<float>, component string, n int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, index int, tree string, witness string, held_out string, score string"


# --- whitening -------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.lists(st.tuples(st.integers(0, 3), st.floats(1e-6, 1e6), st.integers(0, 10**6)), min_size=1, max_size=12))
def test_rank_one_updates_keep_the_eigenpairs(d, moves):
    e, u, whole = np.zeros(d), np.eye(d), np.zeros((d, d))
    for kind, rho, seed in moves:
        rng = np.random.default_rng(seed)
        v = [rng.normal(size=d), np.eye(d)[seed % d], np.ones(d), np.zeros(d)][kind]
        e, u = whitening.updated(e, u, v, rho)
        whole += rho * np.outer(v, v)
    size = max(np.abs(whole).max(), 1e-300)
    assert np.abs(u @ np.diag(e) @ u.T - whole).max() / size < 1e-12
    assert np.abs(u.T @ u - np.eye(d)).max() < 1e-12 and (np.diff(e) >= 0).all()


def test_joined_spectra_equal_the_whole():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(400, 12)) * 300).astype(np.int64) + 100_000
    parts = []
    for rows in (x[:7], x[7:200], np.repeat(x[3:4], 50, 0), x[200:]):
        s = whitening.Spectrum.empty(12)
        s.add(rows)
        parts.append(s)
    first = parts[0]
    for other in parts[1:]:
        first.join(other)
    every = np.concatenate([x, np.repeat(x[3:4], 50, 0)])
    centred = every - every.mean(0)
    assert first.n == 450 and first.sums == [int(v) for v in every.sum(0)]
    assert np.allclose(first.values, np.linalg.eigvalsh(centred.T @ centred), rtol=1e-10)


def test_whitened_equals_the_plain_decomposition(spark):
    rng = np.random.default_rng(3)
    good = [(rng.normal(size=5) * [3, 2, 1, 0.5, 0.2]).astype(np.float32).tolist() for _ in range(90)]
    rows = [(k, v) for k, v in enumerate(good)] + [(7, good[7]), (None, good[8]), (3, good[4])]
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (204, []), (205, [1.0] * 4)]
    df = spark.createDataFrame([(k, v, "x", 0) for k, v in rows + bad], VECTORS).repartition(7)
    got = whitening.whitened(df).collect()
    x = np.floor(1024 * np.array([v for _, v in rows], dtype=np.float32).astype(float)).astype(int) + 100_000
    n, s = len(x), x.sum(0)
    values, vectors = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    assert len(got) == 5 * n and {r.component for r in got} == {1, 2, 3, 4, 5}
    want = defaultdict(list)
    for (key, _), row in zip(rows, x, strict=True):
        for c in range(5):
            want[key, c + 1].append((int(((n * row - s) ** 2).sum()), float(abs((row - s / n) @ vectors[:, 4 - c]) / values[4 - c] ** 0.5)))
    have = defaultdict(list)
    for r in got:
        have[r.vec_id, r.component].append((r.deviation, abs(r.whitened)))
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained - values[5 - r.component] / values.sum()) < 1e-12
    assert want.keys() == have.keys()
    for k in want:
        for (a, b), (c, e) in zip(sorted(want[k]), sorted(have[k]), strict=True):
            assert a == c and abs(b - e) < 1e-9
    # One sign for all rows of a component.
    plain = {k: (row - s / n) @ vectors[:, 4] for (k, _), row in zip(rows[:90], x, strict=False)}
    signs = {np.sign(plain[r.vec_id] * r.whitened) for r in got if r.component == 1 and r.vec_id not in (None, 3, 7)}
    assert len(signs) == 1


def test_whitening_without_variance_or_rows(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        got = whitening.whitened(spark.createDataFrame([(k, v, "", 0) for k, v in rows], VECTORS))
        assert got.columns == columns and got.count() == 0
    flat = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], "", 0), (2, [3.0, 2.0], "", 0)], VECTORS)).collect()
    assert [(r.component, round(abs(r.whitened), 9), r.explained) for r in flat] == [(1, 1.0, 1.0)] * 2
    huge = whitening.whitened(spark.createDataFrame([(1, [1e30], "", 0), (2, [0.0], "", 0)], VECTORS)).collect()
    assert [r.deviation for r in huge] == [None, None] and {round(abs(r.whitened), 9) for r in huge} == {1.0}


# --- manifest --------------------------------------------------------------------------------

def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row: tuple) -> str:
    doc_id, text, lang, source, n_chars = row[:5]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root and the siblings left and right of every bottom node, level by level."""
    at, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = nodes[place // 16 * 16:place // 16 * 16 + 16]
            proofs[k].append(("".join(run[:place % 16]), "".join(run[place % 16 + 1:])))
        at = [place // 16 for place in at]
        nodes = [sha("".join(nodes[k:k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], proofs


def manifest(rows: list[tuple]) -> list[tuple]:
    by = defaultdict(list)
    for row in rows:
        by[row[3]].append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        by[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {name: tree([leaf(r) for r in by[name]]) for name in names}
    root, upper = tree([trees[name][0] for name in names])
    out = []
    for name, above in zip(names, upper, strict=True):
        for row, below in zip(by[name], trees[name][1], strict=True):
            steps = below + above
            now = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None:
                now = (row[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1]), *row[2:])
            node = leaf(now)
            for a, b in steps:
                node = sha(a + node + b)
            out.append((row[0], leaf(row), trees[name][0], root, sha("".join(a + b for a, b in steps)), node, node == root))
    return sorted(out, key=repr)


def found(df) -> list[tuple]:
    suspect = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle_manifest.witnesses(df, suspect=suspect, now={"text": merkle_manifest.lowered(F.col("text"))})
    return sorted((tuple(r) for r in merkle_manifest.verified(got).collect()), key=repr)


def made(rows: list[tuple]) -> list[tuple]:
    return [(*r, 0, "t", "w", "h", "s") for r in rows]


def test_manifest_equals_the_plain_tree(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["Abc É", "", None, "x" * 9000 + "Z", "lower"]), rng.choice(["en", None]), rng.choice(["a", "B", "é", None, "", "one"]), rng.choice([None, k]))
            for k in range(300)]
    rows += [rows[5], rows[5], (5, "Other", "en", rows[5][3], 1), (None, "Null key", None, "a", None), (None, None, None, None, None), (900, "Alone", "en", "single", 5)]
    assert found(spark.createDataFrame(made(rows), DOCS).repartition(5)) == manifest(rows)


def test_manifest_of_several_blocks_and_many_groups(spark):
    rows = [(k, f"Text {k}", "en", "hot", k) for k in range(merkle_manifest.BLOCK * 2 + 5)]
    rows += [(k, f"Text {k}", "en", f"own{k}", k) for k in range(300)]
    assert found(spark.createDataFrame(made(rows), DOCS).repartition(6)) == manifest(rows)


def test_manifest_of_nothing_and_of_one_row(spark):
    assert found(spark.createDataFrame([], DOCS)) == []
    rows = [(5, "Only", "en", "s", 4)]
    got = found(spark.createDataFrame(made(rows), DOCS))
    assert got == manifest(rows) and got[0][1] == got[0][2] == got[0][3]


@pytest.mark.parametrize("total", [1, 2, 15, 16, 17, 255, 256, 257, 700])
def test_appended_witnesses_are_those_of_the_finished_tree(total):
    nodes = [sha(str(k)) for k in range(total)]
    grown = merkle_manifest.Appender(merkle_manifest.height(total))
    witnesses = [grown.append(n) for n in nodes]
    root, proofs = tree(nodes)
    assert grown.close() == root
    assert [list(w.levels()) if w else [] for w in witnesses] == proofs


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_manifest_matches_sql(spark):
    name = "op12_merkle_manifest"
    assert difference(spark, SF, name, QUERIES[name], ORACLES[name]) is None


# --- languages -------------------------------------------------------------------------------

SYLLABLES = {"en": ["the", "ing", "sh", "ough", "wh", "and"], "de": ["sch", "ung", "ein", "der", "ü", "ß"], "fr": ["eau", "oi", "les", "ç", "è", "ment"],
             "es": ["ción", "ñ", "los", "ar", "que", "ado"], "xx": ["zq", "qz", "kx", "vv", "wz", "xx"]}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))).capitalize() for _ in range(n)) + ", 12."


def plain_counts(text: str) -> np.ndarray:
    mask, code = 2**64 - 1, "".join(c if c.isalpha() else " " for c in text.lower())
    code = " " + " ".join(code.split()) + " " if code.split() else " "
    out = np.zeros(language_families.FEATURES)
    for n in range(1, language_families.ORDERS + 1):
        for k in range(max(1, n - 1), len(code)):
            h = 0
            for step, c in enumerate(code[k - n + 1:k + 1], 1):
                h = (h * 0x100000001B3 + ord(c) + step) & mask
            h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & mask
            out[h >> (64 - language_families.BITS)] += 1
    return out


def test_counts_are_those_of_all_ngrams_whatever_the_pieces(monkeypatch):
    text = "Straße,  und  ÉTÉ 12 34 été\n\n é ok" * 3
    whole = language_families.counts(text)
    for piece in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language_families, "PIECE", piece)
        assert (language_families.counts(text) == whole).all()
    assert (whole > 0).sum() > 20
    assert language_families.counts("12 34 ...") is None and language_families.counts("") is None
    assert np.abs(plain_counts(text) - whole).sum() <= 2 * language_families.ORDERS


def test_languages_of_held_out_texts(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, lang, rng.randint(3, 60)), lang, "s", k) for k in range(900) for lang in [list(SYLLABLES)[k % 5]]]
    odd = [(2000, None, "en", "s", 0), (2001, "", "de", "s", 0), (2002, "12 ... 34", "en", "s", 0), (2003, prose(rng, "fr", 4) * 3000, None, "s", 0),
           (None, prose(rng, "de", 20), "en", "s", 0), (2004, rows[0][1], "de", "s", 0), (5, rows[5][1], "en", "s", 0)]
    df = spark.createDataFrame(made(rows + odd), DOCS)
    model = language_families.learn(df)
    assert sorted(model.machines) == ["family germanic", "family only xx", "family romance", "pair de en", "pair es fr"]
    got = language_families.predict(df, model=model).collect()
    assert got[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"} and len(got) == len(rows + odd)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    test = [(by[k][0].lang_pred, lang) for k, _, lang, _, _ in rows if by[k][0].held_out]
    assert len(test) > 100 and sum(a == b for a, b in test) / len(test) > 0.98
    assert [by[k][0].lang_pred for k in (2000, 2001, 2002, 2003)] == ["und", "und", "und", "fr"] and by[2000][0].score == 0
    assert by[None][0].lang_pred == "de" and len({r.lang_pred for r in by[5]}) == 1
    # Labels of held-out rows, keys and sources take no part.
    other = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    again = {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in language_families.predict(other).collect()}
    assert again == {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in got}


def test_languages_when_little_is_known(spark):
    assert language_families.predict(spark.createDataFrame([], DOCS)).count() == 0
    none = spark.createDataFrame(made([(1, "some text", None, "s", 0)]), DOCS)
    assert [(r.lang_pred, r.score) for r in language_families.predict(none).collect()] == [("und", 0.0)]
    one = spark.createDataFrame(made([(k, "some text", "en", "s", 0) for k in range(9)] + [(20, "123", "en", "s", 0)]), DOCS)
    assert {(r.lang_pred, r.score) for r in language_families.predict(one).collect()} == {("en", 1.0), ("und", 0.0)}


def test_a_machine_equals_a_slow_fit():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x @ np.arange(6) + 0.3 * rng.normal(size=200) > 0, 1, -1).astype(np.float32)
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

    def loss(w):
        return (share * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) ** 2).sum() + language_families.PENALTY / 2 * (w[:-1] ** 2).sum()

    w = np.zeros(7)
    for _ in range(20_000):
        slack = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) * y * share
        w -= 0.2 * np.append(-2 * x.T @ slack + language_families.PENALTY * w[:-1], -2 * slack.sum())
    assert loss(language_families.separator(x, y)) < loss(w) * 1.01 + 1e-4
