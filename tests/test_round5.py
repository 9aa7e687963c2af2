"""Tests of the findings that were mended after round 4."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.operators import evaluate, pairs, search, sparse


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    rows = [(i, 0, " ".join(rng.choice(words, 12))) for i in range(80)] + [(80, 0, ""), (81, 0, "abcde " * 300), (82, 0, "hgfed " * 70_000)]
    return spark.createDataFrame(rows, "data_id long, chunk_id long, text string").repartition(3).cache()


def test_pairs_without_a_shuffle(texts):
    """Each vector used to be shuffled to nearly every block; now blocks are read from where they were written."""
    plan = pairs.similar_pairs(texts, 0.45, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Exchange range" not in plan and "FlatMapCoGroups" not in plan


def test_lists_are_shuffled_cut(texts):
    plan = pairs.nearest(texts, texts, 3, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "FlatMapCoGroups" not in plan and "WindowGroupLimit" in plan


@pytest.mark.parametrize(("rare", "cells", "held"), [(0, 4_000_000, 2_000_000), (100, 50, 2_000_000), (4, 900, 2_000_000), (4, 4_000_000, 1)])
def test_products_of_blocks(texts, monkeypatch, rare, cells, held):
    """Dense, entry by entry, in slices, and of values that a join gave."""
    monkeypatch.setattr(sparse, "HELD_GRAMS", held)
    vocabulary, weights = pairs.tfidf_model(texts)
    vectors = {r.data_id: dict(zip(r.codes, r["values"], strict=True)) for r in pairs.unit_vectors(texts, vocabulary, weights).collect()}
    parts = pairs.packed(texts, vocabulary, weights, 16).orderBy("block").collect()
    monkeypatch.setattr(pairs, "RARE", rare)
    monkeypatch.setattr(pairs, "CELLS", cells)
    blocks = [pairs.Block(*(r[p] for p in pairs._PARTS)) for r in parts]
    assert len({r.block for r in parts}) == len(parts) and max(b.n for b in blocks) <= 16
    assert sorted(d for b in blocks for d in b.data.tolist() if d in vectors) == sorted(vectors)
    for a in blocks:
        for b in blocks:
            want = [[sum(w * vectors.get(y, {}).get(g, 0.0) for g, w in vectors.get(x, {}).items()) for y in b.data.tolist()] for x in a.data.tolist()]
            assert np.allclose(a.products(b), want, atol=1e-12)


def test_each_pair_of_blocks_once(spark):
    ids = spark.createDataFrame([((p << 33) + i,) for p in range(4) for i in range(5)], "block long")
    met = [(r.block, r.other_block) for r in pairs.meetings(ids, ids, True).collect()]
    assert len(met) == 20 * 21 // 2 == len({frozenset(m) for m in met})
    assert pairs.meetings(ids, ids.where(F.col("block") < 3), False).count() == 60


@pytest.mark.parametrize(("chars", "held"), [(64, 1_000_000), (64, 5), (3, 1_000_000)])
def test_equal_phrases_are_scored_once(spark, monkeypatch, chars, held):
    """Phrases that many records share are one row with the lowest ids, and lists are as if each were scored for each record."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcd"), n)) for n in (2, 3, 6, 6, 7, 7, 8, 8)]
    rows = [(int(d), i, str(rng.choice(words))) for i, d in enumerate(rng.integers(0, 40, 400))] + [(d, 500 + d, " ".join(rng.choice(words, 20))) for d in range(40)] + [(50, 600, None)]
    chunks = spark.createDataFrame(rows, "data_id long, chunk_id long, text string").repartition(3).cache()
    queries = spark.createDataFrame([(i, " ".join(rng.choice(words, 2))) for i in range(12)] + [(99, "zzz")], "query_id long, query string")
    order = lambda df: sorted((r.query_id, r["rank"], r.data_id, round(r.score, 9)) for r in df.collect())
    with monkeypatch.context() as m:
        m.setattr(search, "shared", lambda chunks, k: chunks)
        want = [order(run(queries, chunks, 4)) for run in (search.bm25_search, search.tfidf_search)]
    monkeypatch.setattr(sparse, "SHARED_CHARS", chars)
    monkeypatch.setattr(sparse, "SHARED_TEXTS", held)
    found = sparse.shared_texts(chunks, 4)
    whole = {}
    for d, _, t in rows:
        whole.setdefault(t or "", []).append(d)
    short = {r.text: (r.times, list(r.ids)) for r in found.collect() if len(r.text) <= chars}
    assert short == {t: (len(d), sorted(set(d))[:4]) for t, d in whole.items() if len(t) <= chars}
    assert found.agg(F.sum("times")).first()[0] == len(rows)
    assert [order(run(queries, found, 4)) for run in (search.bm25_search, search.tfidf_search)] == want
    if chars == 64:
        assert sparse.is_shared(search.shared(chunks, 4))


def test_products_entry_by_entry_or_dense(monkeypatch):
    """Short texts meet few entries of the queries and are multiplied by these alone."""
    rng = np.random.default_rng(6)
    own = [np.unique(rng.integers(0, 50, 6)) for _ in range(9)]
    asked = sparse.Asked(np.arange(9), np.append(0, np.cumsum([len(c) for c in own])), np.concatenate(own), rng.random(sum(map(len, own))))
    sheet = sparse.Sheet(asked, 2, 8, np.unique(np.concatenate(own[2:8])))
    row = np.sort(rng.integers(0, 7, 20))
    at, value = rng.integers(0, len(sheet.names), 20), rng.random(20)
    pairs_ = np.unique(row * 100 + at, return_index=True)[1]
    row, at, value = row[pairs_], at[pairs_], value[pairs_]
    want = np.zeros((7, len(sheet.names)))
    want[row, at] = value
    for cells in (0, 10**9):
        monkeypatch.setattr(sparse, "ENTRY_CELLS", cells)
        assert np.allclose(sheet.products(row, at, value, 7, None), want @ sheet.matrix())


def test_weights_are_fitted_once_for_all_rounds(spark, monkeypatch):
    calls, fitted = [], evaluate.tfidf_search
    monkeypatch.setattr(evaluate, "tfidf_search", lambda *a: calls.append(1) or fitted(*a))
    cases = spark.createDataFrame([(1, "abc def", 1, "exact")], "case_id long, query string, expected_data_id long, category string")
    chunks = spark.createDataFrame([(1, 0, "abc def ghi" * 9), (2, 0, "abc" * 30)], "data_id long, chunk_id long, text string")
    _, timed = evaluate.timed_results(cases, {"c": chunks}, rounds=3)
    assert len(calls) == 1 and timed.where("retriever = 'tfidf'").count() == 3


def test_chunks_are_scored_once(texts):
    """Lists were made a second time to see which records they hold already."""
    queries = texts.select(F.col("data_id").alias("query_id"), F.col("text").alias("query")).where("query_id < 5")
    plan = search.tfidf_search(queries, texts, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("MapInArrow") == 1
