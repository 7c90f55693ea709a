"""Families that share shingles are joined at central texts; only what is left is compared with each other."""

import random

import numpy as np
import pytest

from newsloom.llm import order_minhash, paragraph_minhash

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _changed(rng, base, places):
    words = list(base)
    for k in places:
        words[k] = "".join(rng.choices(_LETTERS, k=9))
    return " ".join(words)


def _families(rng, size, lengths):
    """Texts with a changed word in fifty, which are hardly similar to any but their unchanged text, and that text last."""
    bases = [["".join(rng.choices(_LETTERS, k=6)) for _ in range(n)] for n in lengths]
    texts = [_changed(rng, base, [k * len(base) // cuts + rng.randrange(5, len(base) // cuts - 5) for k in range(cuts)])
             for base in bases for cuts in [len(base) // 50] for _ in range(size)]
    return texts + [" ".join(base) for base in bases]


def _plain(cut):
    root = list(range(len(cut)))
    for i in range(len(cut)):
        for j in range(i):
            if order_minhash.similar(cut[i], cut[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def _counted(monkeypatch):
    counts, write = {}, order_minhash.stored

    def kept(df, name):
        out = write(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(order_minhash, "stored", kept)
    return counts


def test_pairs_of_a_family_grow_with_its_texts(spark, monkeypatch):
    texts = _families(random.Random(5), 300, (150,))
    counts = _counted(monkeypatch)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(df).collect()}
    assert counts["near-pairs"] + counts.get("near-hub-pairs", 0) < 4 * len(texts)
    assert got == dict(enumerate(_plain([order_minhash.shingles(order_minhash.Words().of(t)) for t in texts])))


@pytest.mark.parametrize("seed", [0, 1])
def test_rounds_lose_no_link(spark, monkeypatch, seed):
    monkeypatch.setattr(order_minhash, "CROWD", 0)
    rng = random.Random(seed)
    base = ["".join(rng.choices(_LETTERS, k=4)) for _ in range(50)]
    texts = []
    for _ in range(110):
        low, high = rng.randrange(12), rng.randrange(24, 51)
        texts.append(_changed(rng, base[low:high], rng.sample(range(high - low), rng.choice([0, 0, 1, 2]))))
    counts = _counted(monkeypatch)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(df).collect()}
    assert counts["near-hub-pairs"] and got == dict(enumerate(_plain([order_minhash.shingles(order_minhash.Words().of(t)) for t in texts])))


def test_bands_hold_every_pair_that_can_be_similar(spark):
    """Every two sizes and places meet in a band exactly if the plain condition of the prefixes holds."""
    rows = [(100 * n + p, n, 1, p, 100 * n + p) for n in (1, 2, 3, 4, 5, 7, 9, 10, 13, 20, 24, 25, 31, 40) for p in range(1, n - int(np.ceil(0.8 * n - 1e-9)) + 2)]
    df = spark.createDataFrame(rows, "id long, n int, mark long, place int, class long")
    got = {(r.a, r.b) for r in order_minhash.meeting(df, df.withColumn("band", order_minhash.band(df.n)), 0.8).collect()}
    need = lambda n, m: int(np.ceil(0.8 / 1.8 * (n + m) - 1e-9))
    want = {(a, b) for a, n, _, p, _ in rows for b, m, _, q, _ in rows if a < b and p <= n - need(n, m) + 1 and q <= m - need(n, m) + 1}
    assert got == want and len(want) > 50


def test_lines_of_a_family_are_joined_at_central_lines(spark, monkeypatch):
    texts = _families(random.Random(8), 50, (150, 150, 64))
    counts = _counted(monkeypatch)
    distinct = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    df = distinct.selectExpr("id", "id as class")
    links = order_minhash.prefix_links(distinct, df, lambda pairs: paragraph_minhash.alike(pairs, distinct), repeats=False)
    root = {k: k for k in range(len(texts))}
    for r in links.collect():
        low, high = sorted((root[r.a], root[r.b]))
        root = {k: low if v == high else v for k, v in root.items()}
    cut = [set(order_minhash.shingles(order_minhash.Words().of(t)).tolist()) for t in texts]
    same = [(i, j) for i in range(len(cut)) for j in range(i) if len(cut[i] & cut[j]) >= 0.8 * len(cut[i] | cut[j]) - 1e-9]
    assert all(root[i] == root[j] for i, j in same) and len(set(root.values())) < len(texts)
    assert counts["near-pairs"] + counts["near-hub-pairs"] < 4 * len(texts)
