"""The pipeline over the smallest tables against a plain reading of its stages."""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from newsloom.llm import order_minhash, rule_ensemble, secrets
from newsloom.llm.catalog import PIECE_MODEL
from newsloom.llm.common import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def kept_of_classes(docs: dict[int, str]) -> dict[int, str]:
    cut = {k: order_minhash.shingles(order_minhash.Words().of(t)) for k, t in docs.items() if re.search(r"\w", t)}
    root = {k: k for k in docs}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(cut)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if min(len(cut[a]), len(cut[b])) >= 0.8 * max(len(cut[a]), len(cut[b])) and order_minhash.similar(cut[a], cut[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: t for k, t in docs.items() if top(k) == k}


def without_leaks(docs: dict[int, str], items: list[str]) -> dict[int, str]:
    runs = {tuple(w[i:i + 15]) for w in map(words, items) for i in range(len(w) - 14)}
    return {k: t for k, t in docs.items() if not any(tuple(w[i:i + 15]) in runs for w in [words(t)] for i in range(len(w) - 14))}


def redacted(docs: dict[int, str], owner: dict[int, str]) -> dict[int, str]:
    found = {k: secrets.find(t) for k, t in docs.items()}
    owners, random = defaultdict(set), {}
    for k, spans in found.items():
        for _, _, _, value, live in spans:
            owners[value].add(owner[k])
            random[value] = live
    out = {}
    for k, text in docs.items():
        gone = np.zeros(len(text) + 1, bool)
        starts = set()
        for s, kind, e, value, _ in found[k]:
            n = len(owners[value])
            if n >= secrets.EXAMPLE_OWNERS or (kind == 3 and not (n == 1 and random[value])):
                continue
            if not gone[s:e].any() or not gone[s]:
                starts.add(s)
            gone[s:e] = True
        out[k] = "".join(("[SECRET]" if i in starts else "") + ("" if gone[i] else c) for i, c in enumerate(text))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_pipeline_equals_its_stages_read_plainly(spark):
    rows = table(spark, SF, "documents").collect()
    good = {r.doc_id for r in rule_ensemble.score(table(spark, SF, "documents"), table(spark, SF, "labels")).collect() if r.predicted}
    docs = kept_of_classes({r.doc_id: r.text for r in rows if r.doc_id in good})
    docs = without_leaks(docs, [r.text for r in table(spark, SF, "benchmark").collect()])
    docs = redacted(docs, {r.doc_id: r.source for r in rows})
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_MODEL))
    want = {}
    for k, t in docs.items():
        ids = library.encode(t, add_bos=True, add_eos=True)
        want[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(want) < len(rows)


def test_stages_keep_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
