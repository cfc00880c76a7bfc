"""Texts of hundreds of thousands of words, next to short ones."""

import random

import numpy as np
import pytest

from icefathom.llm import decontamination, language_id, license_scan, order_minhash, quality_rules, suffix_dedup

N = 120_000


@pytest.fixture(scope="module")
def long_text():
    draw = random.Random(21)
    return " ".join(f"w{draw.randrange(60_000)}" for _ in range(N))


def test_alignment_of_long_texts(long_text):
    draw = random.Random(2)
    a = np.array([hash(w) & (2**63 - 1) for w in long_text.split()], np.uint64)
    b = a.copy()
    b[draw.sample(range(N), 4000)] = 7
    assert order_minhash.alike(a, b) == pytest.approx((N - 4000) / N, abs=1e-3)
    rng = np.random.default_rng(5)
    common = rng.integers(0, 9, 9000).astype(np.uint64)  # frequent and rare words in one long text
    common[rng.integers(0, 9000, 2000)] = rng.integers(10, 10**6, 2000)
    other = np.delete(common, rng.integers(0, 9000, 300))
    assert order_minhash.alike(common, other) == pytest.approx(len(other) / 9000)


def test_operators_take_long_texts(spark, docs, long_text):
    words = long_text.split()
    near = " ".join(words[:500] + ["changed"] + words[501:])
    rows = [(1, long_text), (2, near), (3, long_text), (4, "a short text"), (5, "x" * 2_000_000)]
    df = docs(rows).select("doc_id", "text")
    assert {r["doc_id"]: r["class_id"] for r in order_minhash.classes(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    found = {r["doc_id"]: r for r in suffix_dedup.repeats(df).collect()}
    assert [(s["start"], s["end"]) for s in found[2]["spans"]] == [(0, 500), (501, N)]
    assert found[3]["copy_of"] == 1 and not found[1]["spans"] and not found[5]["spans"]
    scanned = {r["doc_id"]: r["n_words"] for r in license_scan.scan(df).collect()}
    assert scanned == {1: N, 2: N, 3: N, 4: 3, 5: 1}
    labels = df.selectExpr("doc_id", "cast(null as int) quality")
    judged = {r["doc_id"]: r for r in quality_rules.judge(df, labels).collect()}
    assert judged[1]["n_words"] == N and judged[5]["word_chars"] == 2_000_000
    bench = spark.createDataFrame([(9, " ".join(words[60_000:60_040]))], "item_id long, text string")
    held = {r["doc_id"]: [s["item_id"] for s in r["spans"]] for r in decontamination.find(df, bench).collect()}
    assert held == {1: [9], 2: [9], 3: [9], 4: [], 5: []}
    trees = language_id.train(docs([(7, "a short text of words"), (10, "w1 w2 w3 w4")]))
    assert {r["lang_pred"] for r in language_id.identify(df, trees).collect()} == {"en"}
