"""Retrieval operators against plain Python models, on small fixtures of the shape that the records have."""

import datetime
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.functions import versions
from trawl.operators import cache, chat, chunking, dense, encoders, evaluate, health, ingest, pairs, search, sparse, stored, testset
from trawl.sources import io

RECORD = "data_id long, symptoms string, cause string, diagnosis string, treatment string"
ROWS = [
    (1, "Ringworm", "round bald spots, itching skin  scaly patches", "fungus", "cream"),
    (2, "Flea bites", "itching skin, red bumps scratching often", "fleas", None),
    (4, "Cold", "sneezing often, runny nose ๆ  watery eyes coughing", None, "rest"),
    (7, "Cold copy", "sneezing often, runny nose ๆ  watery eyes coughing", None, "rest"),
    (9, "Thin", "short", "x", "y"),
    (12, "Blank", None, "x", ""),
    (15, "Upper", "ITCHING SKIN itching skin,scaly patches,scaly patches", "", ""),
]
SYNONYMS = [("itching", ["scratchy", "itchy"]), ("skin", ["hide"]), ("none", [])]
STRIP = lambda s: (s or "").strip()


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setitem(cache.EMPTY, "buckets", 4)


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(ROWS, RECORD).repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "itching skin"), (2, "watery eyes"), (3, "zzqqxx"), (4, "a"), (5, "Itching")], "query_id long, query string")


def phrases(t):
    return [p for p in (x.strip() for x in re.split(r"[,ๆ]?\s{1,}|,", t or "")) if len(p) >= 6]


def grams(t, n=3):
    t = f" {STRIP(t)} "
    return [t] if len(t) < n else [t[i : i + n] for i in range(len(t) - n + 1)]


def wb(t):
    out = []
    for w in STRIP(t).lower().split():
        w = f" {w} "
        for n in (2, 3, 4):
            if len(w) >= n:
                out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return out


def combined(r):
    return f"{STRIP(r[2])} {STRIP(r[1])}".strip()


def test_text_functions(spark):
    texts = ["", None, " ", "a", "ab", "  x  y ", "Ünïcödé ไทย", "วง ๆ ผิวแห้งมาก", "a　b", "a" * 500, "MiXed Case wörds"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select(
        "i", T.strip(F.col("t")).alias("s"), T.split_phrases(F.col("t")).alias("p"), T.char_ngrams(F.col("t")).alias("g"),
        T.ngram_count(F.col("t")).alias("n"), T.char_wb_ngrams(F.coalesce("t", F.lit(""))).alias("w"), T.blank_to_space(F.coalesce("t", F.lit(""))).alias("b"),
    ).collect()
    for r in got:
        t = texts[r.i]
        assert (r.s, r.p, r.g, r.n) == (STRIP(t), phrases(t), grams(t), len(grams(t)))
        assert Counter(r.w) == Counter(wb(t))
        assert r.b == (t if STRIP(t) else " ")
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(T.l2_normalize(F.col("v")).alias("u")).collect()
    assert [u.u for u in unit] == [[0.6, 0.8], [0.0, 0.0]]


def expand(p):
    return [p] + [p.replace(t, v) for t, vs in SYNONYMS if t in p for v in vs]


def model_chunks(strategy):
    out = []
    for r in ROWS:
        if strategy == "row_symptom_only":
            own = [(STRIP(r[2]), "symptom_only")]
        elif strategy == "row_combined":
            own = [(combined(r), "combined")]
        elif strategy == "row_full":
            own = [(" ".join(STRIP(x) for x in (r[2], r[1], r[3], r[4])).strip(), "full")]
        else:
            ps = phrases(r[2])
            if strategy == "per_symptom_expanded":
                ps = list(dict.fromkeys(v for p in ps for v in expand(p)))
            own = [(p, "phrase") for p in ps] + [(combined(r), "row")]
        out += [(r[0], i, t, k) for i, (t, k) in enumerate((t, k) for t, k in own if t)]
    return out


@pytest.mark.parametrize("strategy", ["row_symptom_only", "row_combined", "row_full", "per_symptom", "per_symptom_expanded"])
def test_chunks(records, strategy):
    got = chunking.build_chunks(records, strategy, SYNONYMS)
    assert sorted(map(tuple, got.collect())) == sorted(model_chunks(strategy))


def test_chunk_summary_and_names(records):
    got = {r.strategy: r for r in chunking.describe_chunks(records, SYNONYMS).collect()}
    for name, r in got.items():
        lengths = [len(t) for _, _, t, _ in model_chunks(name)]
        assert (r.chunks, r.min_chars, r.max_chars) == (len(lengths), min(lengths), max(lengths))
    empty = chunking.describe_chunks(records.limit(0), SYNONYMS).collect()
    assert len(empty) == 5 and {(r.chunks, r.avg_chars, r.max_chars) for r in empty} == {(0, 0.0, 0)}
    with pytest.raises(ValueError):
        chunking.build_chunks(records, "unknown")
    assert sorted(search.to_raw_names(search.to_honest_names(records)).collect(), key=str) == sorted(records.collect(), key=str)


def rank(scores, k):
    return sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]


def model_bm25(chunks, query, k):
    tfs = [Counter(grams(t)) for _, _, t, _ in chunks]
    n, avg = len(chunks), sum(sum(c.values()) for c in tfs) / max(len(chunks), 1)
    df = Counter(g for c in tfs for g in c)
    best = {}
    for (data_id, *_), tf in zip(chunks, tfs, strict=True):
        dl = sum(tf.values())
        s = sum(max(math.log((n - df[g] + 0.5) / (df[g] + 0.5) + 1), 0) * tf[g] * 2.5 / (tf[g] + 1.5 * (0.25 + 0.75 * dl / avg)) * q for g, q in Counter(grams(query)).items() if tf[g])
        if s > 0:
            best[data_id] = max(best.get(data_id, 0), s)
    return rank(best, k)


def model_tfidf(chunks, query, k):
    tfs = [Counter(wb(t)) for _, _, t, _ in chunks]
    df = Counter(g for c in tfs for g in c)
    idf = {g: math.log((1 + len(chunks)) / (1 + d)) + 1 for g, d in df.items()}

    def vec(tf):
        v = {g: n * idf[g] for g, n in tf.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {g: x / norm for g, x in v.items()}

    q, best = vec(Counter(wb(query))), {}
    for (data_id, *_), tf in zip(chunks, tfs, strict=True):
        d = vec(tf)
        best[data_id] = max(best.get(data_id, 0.0), sum(x * d.get(g, 0) for g, x in q.items()))
    return rank(best, k)


def lists(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.data_id, r.score))
    return out


@pytest.mark.parametrize("strategy", ["row_combined", "per_symptom_expanded"])
def test_search_and_fusion(records, queries, strategy):
    chunks, own = chunking.build_chunks(records, strategy, SYNONYMS).cache(), model_chunks(strategy)
    bm, ti = search.bm25_search(queries, chunks, 20), search.tfidf_search(queries, chunks, 20)
    fused, got_bm, got_ti = lists(search.rrf_fuse([bm, ti], top=4)), lists(bm), lists(ti)
    for q, text in ((r.query_id, r["query"]) for r in queries.collect()):
        want_bm, want_ti = model_bm25(own, text, 20), model_tfidf(own, text, 20)
        assert [i for i, _ in got_bm[q]] == [i for i, _ in want_bm]
        assert [i for i, _ in got_ti[q]] == [i for i, _ in want_ti]
        assert np.allclose([s for _, s in got_bm[q]], [s for _, s in want_bm])
        assert np.allclose([s for _, s in got_ti[q]], [s for _, s in want_ti])
        parts = defaultdict(float)
        for one in (want_bm, want_ti):
            for place, (i, _) in enumerate(one, 1):
                parts[i] += 1 / (60 + place)
        assert [i for i, _ in fused[q]] == [i for i, _ in sorted(parts.items(), key=lambda x: -round(x[1], 12))[:4]]
    assert set(lists(search.rrf_fuse([bm], top=3))) == {q for q, own in got_bm.items() if own}
    assert search.bm25_search(queries, chunks.limit(0)).count() == 0


def test_service_search(spark, records, queries):
    more = queries.union(spark.createDataFrame([(9, "  ")], queries.schema))
    hits = search.search_records(more, records, 3, 0.0)
    assert {r.query_id for r in hits.collect()} == {1, 2, 3, 4, 5}
    one = [r for r in search.search_records(more, records).collect() if r.query_id == 2]
    assert [r.data_id for r in one] == [4, 7] and one[0].disease == "Cold" and all(r.score >= 0.19 for r in one)
    counts = {r.query_id: r.hits for r in search.hit_counts(more, search.search_records(more, records)).collect()}
    assert counts[9] == counts[3] == 0 and counts[2] == 2
    ghost = hits.select("query_id", "data_id", "rank", "score").union(spark.createDataFrame([(1, 999, 9, 0.5)], "a long, b long, c int, d double"))
    assert [r.data_id for r in search.dangling_hits(ghost, records).collect()] == [999]


def flat(df):
    return {(r.query_id, r["rank"]): (r.data_id, round(r.score, 6)) for r in df.collect()}


def test_index_on_disk(spark, records, tmp_path):
    path = str(tmp_path / "index")
    assert stored.index_info(spark, path) is None and stored.is_index_stale(spark, path, "tfidf")
    assert stored.build_index(records.limit(0), path) == 0 and stored.index_info(spark, path) is None
    assert stored.build_index(records, path) == len(ROWS)
    info = stored.index_info(spark, path)
    assert info.records == len(ROWS) and info.dim > 0 and not stored.is_index_stale(spark, path, "tfidf") and stored.is_index_stale(spark, path, "dense")
    with pytest.raises(ValueError):
        stored.build_index(records, path, "unknown")
    own = {(r.code, d): n for r in stored.postings(spark, path, info).collect() for d, n in zip(r.docs, r.counts, strict=True)}
    idf = {r.code: r.idf for r in stored.stored(spark, path, "vocabulary").collect()}
    for r in stored.stored(spark, path, "documents").collect():
        grams = Counter(wb(f"{dict((x[0], x) for x in ROWS)[r.data_id][2] or ''} {dict((x[0], x) for x in ROWS)[r.data_id][1] or ''}"))
        assert sorted(n for (_, d), n in own.items() if d == r.uid) == sorted(grams.values()) and r.length == sum(grams.values())
        assert abs(r.norm - math.sqrt(sum((n * idf[c]) ** 2 for (c, d), n in own.items() if d == r.uid))) < 1e-9


def test_search_of_a_stored_index(spark, records, queries, tmp_path, monkeypatch):
    chunks = search.record_chunks(records)
    for backend, whole in (("tfidf", search.tfidf_search), ("bm25", search.bm25_search)):
        path = str(tmp_path / backend)
        stored.build_index(records, path, backend)
        want = flat(whole(queries, chunks, 4))
        assert flat(search.index_search(queries, path, 4)) == want
        for limit in ({"HELD_CELLS": 3}, {"HELD_ENTRIES": 4}, {"HELD_GRAMS": 3}):
            with monkeypatch.context() as m:
                m.setattr(sparse, *limit.popitem())
                assert flat(search.index_search(queries, path, 4)) == want == flat(whole(queries, chunks, 4))
        with monkeypatch.context() as m:
            m.setattr(stored, "FILTER_GRAMS", 2)
            assert flat(search.index_search(queries, path, 4)) == want
    encoder = lambda texts: [[len(t), t.count("i") + 1.0, t.count("s")] for t in texts]
    path = str(tmp_path / "dense")
    stored.build_index(records, path, "dense", encoder)
    hits = search.search_records(queries, records, 3, index=path, encoder=encoder).collect()
    assert hits and all(0.35 <= r.score <= 1 for r in hits) and stored.index_info(spark, path).dim == 3
    assert [r.data_id for r in search.search_records(queries, records, 2, 0.0, index=str(tmp_path / "tfidf")).where("query_id = 2").orderBy("rank").collect()] == [4, 7]


def test_index_reads_only_the_buckets_of_its_grams(spark, records, tmp_path):
    path = str(tmp_path / "index")
    stored.build_index(records, path, "bm25")
    found = stored.wanted_postings(stored.postings(spark, path, stored.index_info(spark, path)), spark.createDataFrame([(1,), (2,)], "code long"))
    plan = found.groupBy("code").count()._jdf.queryExecution().toString()
    read = re.search(r"SelectedBucketsCount: (\d+) out of (\d+)", plan)
    assert read and int(read[1]) <= 2 and int(read[2]) == stored.LEAST_BUCKETS


@pytest.mark.parametrize("backend", ["tfidf", "bm25"])
def test_index_deltas(spark, records, queries, tmp_path, monkeypatch, backend):
    monkeypatch.setattr(stored, "SEGMENT_DOCS", 2)
    path, anew = str(tmp_path / "index"), str(tmp_path / "anew")
    stored.build_index(records, path, backend)
    assert stored.update_index(records, path) == (0, 0) and not stored.is_index_stale(spark, path, backend, records)
    assert not stored.is_index_stale(spark, path, backend, records.repartition(1))
    for keep, add in (("data_id <> 4", [(20, "New", "watery eyes itching", None, None)]), ("data_id not in (1, 20, 7)", [(7, "Cold copy", "sneezing, itching skin again", None, None), (30, "Last", "a", "", "")])):
        records = spark.createDataFrame(records.where(keep).collect() + [tuple(r) for r in add], RECORD)
        assert stored.is_index_stale(spark, path, backend, records)
        assert stored.update_index(records, path)[0] == len(add)
        assert not stored.is_index_stale(spark, path, backend, records)
        stored.build_index(records, anew, backend)
        assert flat(search.index_search(queries, path, 4)) == flat(search.index_search(queries, anew, 4))
        for name, columns in (("vocabulary", ["code", "df", "idf"]), ("documents", ["data_id", "length"])):
            assert sorted(stored.stored(spark, path, name).select(*columns).collect()) == sorted(stored.stored(spark, anew, name).select(*columns).collect())
    assert len(stored.index_info(spark, path).postings) == 3


def test_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    assert versions.current(spark, root) == (0, None)
    assert versions.commit(spark, root, 0, "a") == 1 and versions.commit(spark, root, 1, "b") == 2
    with pytest.raises(versions.ConcurrentCommit):
        versions.commit(spark, root, 1, "c")
    open(f"{root}/_log/000000000003", "w").close()  # a commit that broke off
    assert versions.current(spark, root) == (2, "b")


def test_ids_of_any_kind(spark, records, queries):
    chunks = search.record_chunks(records)
    named = chunks.withColumn("data_id", F.concat(F.lit("r"), F.lpad("data_id", 3, "0")))
    odd = named.unionByName(spark.createDataFrame([(None, 0, "itching skin")], named.schema))
    asked = queries.withColumn("query_id", F.concat(F.lit("q"), "query_id")).unionByName(spark.createDataFrame([(None, "itching"), ("q7", None)], "query_id string, query string"))
    for run in (search.bm25_search, search.tfidf_search):
        want = {(f"q{q}", r): (f"r{i:03}", s) for (q, r), (i, s) in flat(run(queries, chunks, 3)).items()}
        got = flat(run(asked, odd, 3))
        assert {k: v for k, v in got.items() if k[0] != "q7"} == want
        assert {v for k, v in got.items() if k[0] == "q7"} <= {("r001", 0.0), ("r002", 0.0), ("r004", 0.0)}
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), (None, [1.0, 0.0]), ("c", [0.5, 0.5])], "data_id string, vector array<double>")
    found = dense.dense_search(vectors.withColumnRenamed("data_id", "query_id"), vectors, 3)
    assert {(r.query_id, r["rank"]): r.data_id for r in found.collect()} == {("a", 1): "a", ("a", 2): "c", ("c", 1): "a", ("c", 2): "c"}


def test_many_queries(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(60)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(90)]
    chunks = spark.createDataFrame([(i // 2, i, t) for i, t in enumerate(texts)], "data_id long, chunk_id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, " ".join(rng.choice(words, 3))) for i in range(300)], "query_id long, query string")
    for run in (search.bm25_search, search.tfidf_search):
        want = flat(run(queries, chunks, 5))
        assert len(want) > 1000
        monkeypatch.setattr(sparse, "HELD_CELLS", 900)
        monkeypatch.setattr(sparse, "HELD_ENTRIES", 1500)
        monkeypatch.setattr(sparse, "SLICE_CELLS", 1000)
        assert flat(run(queries, chunks, 5)) == want
        monkeypatch.undo()


def test_pairs_and_nearest(spark):
    rng = np.random.default_rng(3)
    topics = [["".join(rng.choice(list("abcdefghijkl"), 4)) for _ in range(12)] for _ in range(6)]
    texts = [" ".join(rng.choice(topics[i % 6], 9)) for i in range(70)] + ["", "  ", texts_twice := "abcd efgh ijkl", texts_twice]
    rows = [(i * 3, 0, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "data_id long, chunk_id long, text string").repartition(4)
    model = {i: dict(model_tfidf([(*r, "") for r in rows], t, 99)) for i, _, t in rows}
    for cut, block in ((0.45, 7), (0.45, 500), (0.9, 10), (0.1, 25)):
        got = {(r.a, r.b): r.similarity for r in pairs.similar_pairs(df, cut, block).collect()}
        want = {(a, b): s for a, own in model.items() for b, s in own.items() if a < b and s > cut}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for k, block in ((1, 8), (3, 8), (5, 500)):
        got = lists(search.top_k(search.max_pool(pairs.nearest(df, df, k, block)), k))
        for i, own in model.items():
            assert [d for d, _ in got[i]] == [d for d, s in rank(own, k) if s > 0]
    assert pairs.similar_pairs(df.limit(0), 0.5).count() == 0 and pairs.nearest(df.limit(0), df, 2).count() == 0


def test_containing(spark):
    rows = [(3, "a b c d e f g h i"), (1, "x a b c d e f g hh"), (2, "  one two\n three four five six seven, eight"), (4, None), (5, "short")]
    items = [(1, "b c d e f g h"), (2, "two\n three four five six seven, e"), (3, "hor"), (4, "b c d e f g i"), (5, "a b c d e f g h i j"), (6, "a b c")]
    found = evaluate.containing(spark.createDataFrame(rows, "data_id long, cause string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {i: min((d for d, c in rows if c and t in c), default=None) for i, t in items}
    assert {r.item_id: r.data_id for r in found.collect()} == {i: d for i, d in want.items() if d}


def test_dense(spark):
    rng = np.random.default_rng(1)
    d = [(i, i // 2, rng.normal(size=6).tolist()) for i in range(300)]
    q = [(i, rng.normal(size=6).tolist()) for i in range(7)]
    got = lists(dense.dense_search(spark.createDataFrame(q, "query_id long, vector array<double>"), spark.createDataFrame(d, "chunk_id long, data_id long, vector array<double>"), 4))
    for i, v in q:
        best = defaultdict(lambda: -9.0)
        for _, r, w in d:
            best[r] = max(best[r], float(np.dot(v, w)))
        assert [x for x, _ in got[i]] == [x for x, _ in rank(best, 4)]


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, "q1", 10, "exact"), (2, "q2", 20, "typo"), (3, "q3", -1, "negative"), (4, "q4", 40, "exact")], "case_id long, query string, expected_data_id long, category string")
    rows = [("c", "r", 1, 10, 1, 0.9), ("c", "r", 1, 11, 2, 0.8), ("c", "r", 2, 21, 1, 0.7), ("c", "r", 2, 20, 3, 0.4), ("c", "r", 3, 99, 1, 0.3), ("d", "r", 1, 10, 5, 0.5)]
    results = spark.createDataFrame(rows, "chunking string, retriever string, case_id long, data_id long, rank int, score double")
    judged = evaluate.judged(results, cases)
    got = {r.chunking: r for r in evaluate.metrics(judged).collect()}
    assert (got["c"].recall_1, got["c"].recall_3, got["c"].mrr) == (0.3333, 0.6667, round((1 + 1 / 3) / 3, 4))
    assert got["c"].noise_gap == 0.6 and got["d"].noise_gap is None and got["c"].cat_exact == 0.5 and got["c"].cat_typo == 0.0 and got["c"].cat_partial == 0.0
    assert {(r.chunking, r.query, r.got, r["rank"]) for r in evaluate.failures(judged).collect()} == {("c", "q2", 21, 3), ("c", "q4", None, 0), ("d", "q1", None, 5), ("d", "q2", None, 0), ("d", "q4", None, 0)}
    ranked = evaluate.metrics(judged).withColumn("config_ord", F.lit(0))
    assert evaluate.best_by_recall(ranked).first().chunking == "c"
    assert evaluate.recommended(ranked, ("d", "r")).first().gain == 0.3333
    assert evaluate.recommended(ranked.where("chunking = 'd'")).count() == 0
    weak = evaluate.weakest_category(evaluate.category_accuracy(judged)).first()
    assert (weak.category, weak.worst, weak.best, weak.flagged) == ("exact", 0.0, 0.5, True)
    timed = spark.createDataFrame([("c", "r", 1.0), ("c", "r", 9.0), ("c", "r", 2.0)], "chunking string, retriever string, latency_ms double")
    assert evaluate.median_latency(timed).first().median_ms == 2.0
    assert evaluate.tune_threshold(0.3, 0.1) == (0.2, True) and evaluate.tune_threshold(0.1, 0.2) == (0.21, False)


def test_regression_and_noise(spark, records):
    cases = spark.createDataFrame([(1, "round bald spots", "RINGWORM"), (2, "watery eyes", "flea"), (3, "", "x")], "query_id long, query string, expected_disease_contains string")
    got = {r.query_id: r for r in evaluate.regression_check(cases, records).collect()}
    assert got[1].passed and not got[2].passed and not got[3].passed and got[3].top_score is None and got[2].fragile is False and 0 < got[2].margin < 0.05
    total = evaluate.accuracy_summary(evaluate.regression_check(cases, records)).first()
    assert (total.passed, total.total) == (1, 3)
    assert evaluate.noise_floor(cases.select("query_id", "query"), records).first().noise > 0.3


def test_benchmark_matrix(spark, records):
    letters = lambda texts: np.array([[1.0 + t.count(c) for c in "aeinorst"] for t in texts])
    cases = testset.cases_exact(records).where("query <> ''").withColumn("case_id", F.col("expected_data_id"))
    made = {s: chunking.build_chunks(records, s, SYNONYMS) for s in ("row_combined", "per_symptom")}
    results = evaluate.benchmark_results(cases, made)
    got = evaluate.metrics(evaluate.judged(results, cases)).collect()
    assert len(got) == 6 and all(r.recall_3 >= r.recall_1 >= 0.5 for r in got)
    every = evaluate.benchmark_results(cases, {"row_combined": made["row_combined"]}, encoder=letters)
    assert {r.retriever for r in every.select("retriever").distinct().collect()} == {"bm25", "tfidf", "hybrid(bm25+tfidf)", "dense", "hybrid(bm25+dense)"}
    texts, queries = {r.data_id: r.text for r in made["row_combined"].collect()}, {r.case_id: r.query for r in cases.collect()}
    unit = lambda t: letters([t])[0] / np.linalg.norm(letters([t])[0])
    for case, q in queries.items():
        want = rank({i: float(unit(t) @ unit(q)) for i, t in texts.items()}, 5)
        rows = every.where(f"retriever = 'dense' and case_id = {case}").orderBy("rank").collect()
        assert np.allclose([r.score for r in rows], [s for _, s in want], atol=1e-5)


def model_typos(text, seed, rate=0.08):
    for i in range(1, max(1, int(len(text) * rate)) + 1) if text else ():
        digits = hashlib.md5(f"{seed}|{i}".encode()).hexdigest()
        if len(text) >= 3:
            at, kind = int(digits[:7], 16) % (len(text) - 1), int(digits[7:14], 16) % 3
            a, b = text[at], text[at + 1]
            text = text[:at] + (b, a + a + b, b + a)[kind] + text[at + 2 :]
    return text


def test_testset(spark, records):
    cases = testset.make_testset(records)
    counts = {r.category: r.n for r in testset.category_counts(cases).collect()}
    ps = {r[0]: phrases(r[2]) for r in ROWS}
    assert counts["single"] == sum(min(3, len(p)) for p in ps.values()) and counts["partial"] == sum(len(p) >= 3 for p in ps.values())
    assert counts["exact"] == 6 and counts["typo"] == sum(bool(p) for p in ps.values()) and counts["negative"] == 10
    assert sorted(map(str, cases.collect())) == sorted(map(str, testset.make_testset(records.repartition(1)).collect()))
    texts = ["ab", "", None, "abcdef", "é🎉xyz", "a long enough phrase for two edits " * 3]
    seen = spark.createDataFrame([(t, "s") for t in texts], "t string, s string").select("t", testset.add_typos(F.col("t"), F.col("s")).alias("noisy")).collect()
    assert {r.t: r.noisy for r in seen} == {t: model_typos(t, "s") for t in texts}
    terms = [("skin", ["hide"]), ("hide", ["coat"])]
    got = spark.createDataFrame([("skin hide",)], "t string").select(testset.colloquialise(F.col("t"), F.lit(1), terms=terms).alias("c")).first()
    assert got.c == "coat coat"


def test_health(spark, records):
    assert {r.data_id for r in health.thin_records(records).collect()} == {9, 12}
    assert {r.data_id for r in health.few_phrases(records).collect()} == {r[0] for r in ROWS if len(phrases(r[2])) < 3}
    chunks = [(r[0], 0, f"{r[2] or ''} {r[1] or ''}", "") for r in ROWS]
    want = {}
    for a in ROWS:
        for i, s in model_tfidf(chunks, f"{a[2] or ''} {a[1] or ''}", 99):
            if a[0] < i and s > 0.45:
                want[a[0], i] = s
    for block in (2, 100):
        got = {(r.a, r.b): r.similarity for r in health.confusable_pairs(records, block_records=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    blank = (30, None, " ", None, None)  # finds nothing of its own, and is reported
    listed = health.self_lists(records.unionByName(spark.createDataFrame([blank], RECORD))).cache()
    own = [(r[0], 0, combined(r), "") for r in ROWS if combined(r)]
    found = {r[0]: [i for i, _ in model_tfidf(own, r[2] or r[1] or "", 3)] for r in [*ROWS, blank]}
    assert {(r.data_id, r.found) for r in health.self_retrieval_failures(listed).collect()} == {(i, f[0]) for i, f in found.items() if f[0] != i} >= {(30, 1)}
    times = Counter(i for f in found.values() for i in f)
    want = {(i, n) for i, n in times.items() if n > max(3, 0.25 * len(ROWS))}
    assert want and {(r.data_id, r.n) for r in health.magnets(listed, records).collect()} == want
    report = health.health_report(records)
    n = Counter(r.check for r in report.collect())
    assert health.issue_total(report).first().issues == n["thin"] + n["confusable"] + n["self_retrieval"]
    chunks = {r.strategy: r.chunks for r in chunking.describe_chunks(records).collect()}
    assert {r.check: r.value for r in report.where("check like 'chunks:%'").collect()} == {f"chunks:{k}": v for k, v in chunks.items()}


def test_cache(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, " "), (5, "c")], "id long, text string")
    encoder = lambda ts: np.array([[len(t), 1.0] if t != "b" else [0.0, 0.0] for t in ts])
    empty = spark.createDataFrame([], "model string, text_hash string, dim int, vector array<float>, created_at timestamp")
    filled, new = cache.encode_with_cache(empty, "m", texts, encoder)
    assert filled.count() == 5 and new.count() == 4 and all(r.vector is not None for r in filled.collect())
    stored = cache.cache_upsert(empty, new.where("text_hash <> sha2('c', 256)"))
    assert cache.cache_missing(stored, "m", texts).count() == 1 and cache.cache_missing(stored, "other", texts).count() == 4
    counts = cache.encode_counts(cache.cache_upsert(empty, new.where("text_hash <> sha2('b', 256)")), "m", texts).first()
    assert (counts.n_from_cache, counts.n_embedded) == (3, 2)
    twice = cache.cache_upsert(stored, new.withColumn("dim", F.lit(9)))
    assert twice.count() == 4 and {r.dim for r in twice.collect()} == {9}
    both = stored.union(stored.withColumn("model", F.lit("n")))
    assert {(r.model, r.n) for r in cache.cache_stats(both).collect()} == {("m", 3), ("n", 3)}
    left, gone = cache.cache_clear(both, "m")
    assert gone == 3 and left.count() == 3 and cache.cache_clear(both)[1] == 6
    assert cache.latest(stored.union(stored)).count() == 3


def cache_rows(spark, rows):
    return spark.createDataFrame([(m, h, d, [float(d)], datetime.datetime(2020, 1, day)) for m, h, d, day in rows], cache.CACHE)


def test_stored_cache(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "cache")
    seen = lambda: sorted((r.model, r.text_hash, r.dim) for r in cache.stored_cache(spark, root).collect())
    assert seen() == []
    assert cache.upsert_stored(root, cache_rows(spark, [("m", "a", 1, 1), ("m", "a", 2, 3), ("m", "a", 3, 2), ("n", "a", 4, 1), ("m", "b", 5, 1), ("m", "b", 6, 1)]), 4) == 1
    assert seen() == [("m", "a", 2), ("m", "b", 6), ("n", "a", 4)]
    cache.upsert_stored(root, cache_rows(spark, [("m", "b", 7, 1), ("m", "c", 8, 1)]))
    assert seen() == [("m", "a", 2), ("m", "b", 7), ("m", "c", 8), ("n", "a", 4)]
    before = versions.current(spark, root)
    with monkeypatch.context() as m:  # a write that fails after its files leaves what was there
        m.setattr(versions, "commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            cache.upsert_stored(root, cache_rows(spark, [("m", "a", 9, 9)]))
    assert versions.current(spark, root) == before and len(seen()) == 4
    commit, other = versions.commit, []

    def overtaken(session, path, after, folder):
        if not other:
            other.append(1)
            cache.upsert_stored(root, cache_rows(spark, [("n", "z", 1, 1)]))
        return commit(session, path, after, folder)

    with monkeypatch.context() as m:
        m.setattr(versions, "commit", overtaken)
        cache.upsert_stored(root, cache_rows(spark, [("m", "a", 9, 9)]))
    assert seen() == [("m", "a", 9), ("m", "b", 7), ("m", "c", 8), ("n", "a", 4), ("n", "z", 1)]
    plan = cache.stored_cache(spark, root)._jdf.queryExecution().toString()
    assert "parquet" in plan and cache.clear_stored(spark, root, "n") == 2 and len(seen()) == 3 and cache.clear_stored(spark, root) == 3 and seen() == []
    empty = cache_rows(spark, [])
    assert cache.cache_upsert(empty, cache_rows(spark, [("m", "a", 1, 1), ("m", "a", 2, 2)])).count() == 1


def test_stored_ids(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "records")
    rows = lambda *names: spark.createDataFrame([(i, n, "s", "", "") for i, n in enumerate(names)], "pos long, disease string, symptoms string, cause string, treatment string")
    seen = lambda: sorted((r.data_id, r.symptoms) for r in ingest.stored_records(spark, root).collect())
    assert seen() == [] and sorted(r.data_id for r in ingest.load_records(root, rows("a", "b", "b", "c")).collect()) == [1, 2, 3]
    ingest.delete_records(root, spark.createDataFrame([(3,)], "data_id long"))
    assert seen() == [(1, "a"), (2, "b")]
    assert [r.data_id for r in ingest.load_records(root, rows("a", "c")).collect()] == [4]  # 3 is not given again
    commit, other = versions.commit, []

    def overtaken(session, path, after, folder):
        if not other:
            other.append(1)
            ingest.load_records(root, rows("d"))
        return commit(session, path, after, folder)

    with monkeypatch.context() as m:
        m.setattr(versions, "commit", overtaken)
        assert [(r.data_id, r.symptoms) for r in ingest.load_records(root, rows("d", "e")).collect()] == [(6, "e")]
        other.clear()
        with pytest.raises(versions.ConcurrentCommit):
            ingest.load_records(root, rows("f", "g"), tries=1)
    assert seen() == [(1, "a"), (2, "b"), (4, "c"), (5, "d"), (6, "e")]


def test_encoders(spark, records):
    corpus = chunking.row_combined(records)
    got = {(r.data_id, r.gram): r.w for r in encoders.fit_encode(encoders.TFIDF, corpus).collect()}
    from trawl.operators import index

    want = {(r.data_id, r.gram): r.w for r in index.encode_tfidf(corpus, index.fit_tfidf(corpus)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    empty, texts = cache_rows(spark, []), spark.createDataFrame([("abc",), ("abc",), (" ",)], "text string")
    with pytest.raises(ValueError):
        encoders.encode_cached(encoders.TFIDF, empty, texts)
    plain = encoders.of_texts("projected", encoders.projection)
    assert not plain.corpus_coupled and encoders.TFIDF.corpus_coupled
    filled, new = encoders.encode_cached(plain, empty, texts)
    assert new.count() == 2 and {r.text: len(r.vector) for r in filled.collect()} == {"abc": 32, " ": 32}
    vector = np.zeros(32)
    for gram in (" ab", "abc", "bc "):
        vector += [2 * int(d, 16) - 15 for d in hashlib.md5(gram.encode()).hexdigest()]
    assert (encoders.projection(["abc"])[0] == vector).all()


def test_timed_results(spark, records):
    cases = testset.cases_exact(records).where("query <> ''").withColumn("case_id", F.col("expected_data_id"))
    results, timed = evaluate.timed_results(cases, {"row_combined": chunking.row_combined(records)}, 2, encoders.projection, rounds=2)
    assert results.select("retriever").distinct().count() == 5 and timed.count() == 10
    median = {r.retriever: r.median_ms for r in evaluate.median_latency(timed).collect()}
    assert all(ms > 0 for ms in median.values()) and median["hybrid(bm25+dense)"] > median["bm25"]


def test_jdbc_in_ranges(spark):
    url, rows = "jdbc:derby:memory:records;create=true", [(i, f"n{i}", "c", "d", "t") for i in (3, 10, 11, 40, 41, 97)]
    spark.createDataFrame(rows, ingest.RECORDS).write.jdbc(url, "vet_doc")
    found = io.read_records_jdbc(spark, url, parts=4)
    assert found.rdd.getNumPartitions() == 4 and sorted(map(tuple, found.collect())) == rows
    assert sum(n > 0 for n in found.rdd.glom().map(len).collect()) >= 3
    some = found.where("data_id > 40")
    assert some.count() == 2 and re.search(r"PushedFilters: \[.*GreaterThan\(data_id,40", some._jdf.queryExecution().toString().replace("*", ""))
    spark.createDataFrame([], ingest.RECORDS).write.jdbc(url, "none_doc")
    assert io.read_records_jdbc(spark, url, table="none_doc").count() == 0


def test_ingestion(spark, records):
    raw = spark.createDataFrame([(0, None, "Mange", " hair loss ", "mites", None), (1, "Cold", " s ", "c", None, "t"), (2, "New", "sym", None, None, None), (3, "New", "again", None, None, None), (4, "Bad", " ", None, None, None)],
                                "pos long, disease string, symptoms string, cause string, diagnosis string, treatment string")
    rows = ingest.normalize_records(raw)
    assert tuple(rows.where("pos = 0").first())[1:] == ("Mange", "hair loss", "mites", "")
    valid, bad = ingest.split_invalid(rows)
    assert [r.pos for r in bad.collect()] == [4] and valid.count() == 4
    with pytest.raises(ValueError):
        ingest.split_invalid(rows, failfast=True)
    new, skipped = ingest.preview(raw, records)
    assert {r.pos for r in new.collect()} == {0, 2} and {r.pos for r in skipped.collect()} == {1, 3}
    numbered = ingest.assign_ids(spark.range(500).withColumnRenamed("id", "pos").repartition(7), 40).orderBy("pos").collect()
    assert [r.data_id for r in numbered] == list(range(41, 541))
    added = search.to_raw_names(ingest.assign_ids(new, 100))
    passed = ingest.verify_self_retrieval(added, records.unionByName(added)).collect()
    assert len(passed) == 2 and any(r.passed for r in passed)


@pytest.mark.parametrize("coalesce", ["true", "false"])
@pytest.mark.parametrize("advisory", ["64m", "1m"])
def test_ids_of_many_wide_rows(spark, coalesce, advisory):
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": coalesce, "spark.sql.adaptive.advisoryPartitionSizeInBytes": advisory, "spark.sql.shuffle.partitions": "200"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    rows = spark.range(300_000).select((F.lit(900_000) - F.col("id") * 3).alias("pos"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("wide"), F.lit(0).alias("part"))
    got = ingest.assign_ids(rows.repartition(7), 40)
    assert got.columns == ["pos", "wide", "part", "data_id"]
    # the smallest pos is 3; the i-th above it is 3 + 3 i
    found = got.agg(F.count("*").alias("n"), F.count_distinct("data_id").alias("ids"), F.min("data_id").alias("low"), F.max("data_id").alias("high"), F.count_if(F.col("data_id") != 40 + F.col("pos") / 3).alias("wrong")).first()
    for k, v in old.items():
        spark.conf.set(k, v)
    assert tuple(found) == (300_000, 300_000, 41, 300_040, 0)


def test_sparse_grams_are_those_of_the_columns(spark):
    texts = ["", " ", "a", "Ab  c\u3000d", "x" * 5, "ÄÖ ß\x85é", "zero\x00inside it", "🙂 🙂🙂 a", "a\n\nb\tc", "one two " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "data_id long, text string")
    for grams, column in ((sparse.WORD_GRAMS, T.char_wb_ngrams), (sparse.text_grams(3), T.char_ngrams)):
        want = {r.data_id: sorted(Counter(r.g).values()) for r in df.select("data_id", column(F.col("text")).alias("g")).collect()}
        prepared = [(r.data_id, r.text) for r in grams.prepared(df, "text", "data_id").collect()]
        owner, code, count = sparse.counted_grams([t for _, t in prepared], grams)
        got = {i: sorted(count[owner == at].tolist()) for at, (i, _) in enumerate(prepared)}
        assert got == want
        assert len(set(code.tolist())) == len({g for r in df.select(column(F.col("text")).alias("g")).collect() for g in r.g})


@pytest.mark.parametrize("grams", [sparse.WORD_GRAMS, sparse.text_grams(3), sparse.text_grams(5)])
def test_long_texts_in_parts(monkeypatch, grams):
    draw = random.Random(5)
    texts = ["".join(draw.choice("ab\u3000 é🙂\n") for _ in range(n)) for n in (300, 1, 0, 5, 64, 65, 1_000)]
    texts += ["x" * 400, "a " + "yz" * 200 + " b", "\n" * 200, " " + "q" * 64 + " ", "w" * 65, "ab " * 100 + "c" * 130]
    want = sparse.counted_grams(texts, grams)
    for size in (7, 64):
        monkeypatch.setattr(sparse, "SLICE_CHARS", size)
        assert [x.tolist() for x in sparse.counted_grams(texts, grams)] == [x.tolist() for x in want]


def test_long_sessions_in_parts(spark):
    rows = [("hot", i // 2, ("user", "assistant")[i % 2], None if i % 97 == 0 else f"said {i}") for i in range(20_000)]
    rows += [("hot", 7, "user", "said 14"), ("one", 1, "user", "q"), ("none", 1, "system", "s"), (None, 1, "user", "a"), (None, 2, "assistant", "b"), (None, 0, "system", "z")]
    turns = spark.createDataFrame(rows, "session_id string, turn int, role string, content string").repartition(7)
    want = {r.session_id: r for r in chat.last_question(chat.split_roles(turns)).collect()}
    got = {r.session_id: r for r in chat.last_questions(turns, 64).collect()}
    assert got.keys() == want.keys() == {"hot", "one", "none", None}
    for k, r in want.items():
        assert (got[k].system, got[k].question, got[k].earlier, got[k].profiles) == (r.system, r.question, r.earlier, r.profiles)
    parts = chat.earlier_parts(turns, 64).where("session_id = 'hot'").orderBy("part").collect()
    assert "\n".join(p.text for p in parts) == want["hot"].earlier and [p.part for p in parts] == list(range(313)) and {p.turns for p in parts[:-1]} == {64}
    assert parts[-1].turns == 20_000 - 64 * 312 and chat.earlier_parts(turns.limit(0)).count() == 0


def test_chat(spark, records):
    rows = [("s", 1, "system", "be kind"), ("s", 2, "user", "hi"), ("s", 3, "assistant", "hello"), ("s", 4, "tool", "x"), ("s", 5, "user", " watery eyes "), ("t", 1, "user", "q"), ("t", 2, "assistant", "a"), ("u", 1, "system", "x"), ("u", 2, "system", "y")]
    turns = spark.createDataFrame([(*r, {"k": "v"} if r[2] == "system" else None) for r in rows] + [("s", 0, "userprofile", None, {"name": "Mia"})], "session_id string, turn int, role string, content string, detail map<string,string>")
    split = {r.session_id: r for r in chat.last_question(chat.split_roles(turns)).collect()}
    assert split["s"].system == "\nbe kind" and split["s"].question == " watery eyes " and split["s"].earlier == "hi\nhello" and split["s"].profiles == ['{"name":"Mia"}']
    assert split["t"].question == "" and split["t"].earlier == "q" and split["u"].question == "" and split["u"].system == "\nx\ny"
    asked = {r.session_id: r for r in chat.questions(turns).collect()}
    assert all((asked[k].system, asked[k].question, asked[k].profiles) == (r.system, r.question, r.profiles) for k, r in split.items()) and asked.keys() == split.keys()
    pairs = chat.pair_turns(turns)
    assert {(r.session_id, r.user_message, r.ai_response) for r in pairs.collect()} == {("s", "hi", "hello"), ("t", "q", "a")}
    many = spark.createDataFrame([(i, "s", f"u{i}", f"a{i}") for i in range(30)], "id long, session_id string, user_message string, ai_response string")
    history = chat.recent_history(many).first()
    assert history.turns == 20 and [h.user_message for h in history.history] == [f"u{i}" for i in range(10, 30)]
    prompts = {r.session_id: r for r in chat.describe_prompt(chat.batch_rag(turns, records, 1, 0.1)).collect()}
    s = prompts["s"].messages
    assert [m.role for m in s] == ["system", "user", "assistant", "user"] and s[-1].content == "watery eyes" and '"Mia"' in s[0].content and '"disease":"Cold"' in s[0].content
    assert chat.NO_MATCH in prompts["t"].messages[0].content and s[0].chars == len(s[0].content)
    stats = {r.session_id: r for r in chat.prompt_stats(chat.batch_rag(turns, records, 1, 0.1)).collect()}
    assert (stats["s"].history_turns, stats["s"].n_hits, stats["t"].n_hits) == (1, 1, 0)
    log = spark.createDataFrame([], "id long, session_id string, user_message string, ai_response string, timestamp timestamp")
    assert [r.id for r in chat.append_exchanges(log, many.withColumnRenamed("id", "pos"), 5).orderBy("id").collect()] == list(range(6, 36))


def test_sources(spark, records, tmp_path):
    one, many, csv, syn = (str(tmp_path / n) for n in ("one.json", "many.json", "in.csv", "syn.json"))
    open(one, "w").write('{"disease": "A", "symptoms": "b"}')
    open(many, "w").write('[{"symptoms": "A", "cause": "b", "diagnosis": "c"},\n {"disease": "D", "symptoms": "e"}]')
    open(csv, "w", encoding="utf-8-sig").write('disease,symptoms,cause,treatment\nA,"b, ""c""\nd",,x\n')
    open(syn, "w").write('{"_comment": "no", "b": ["x", "y"], "a": []}')
    assert io.read_records_json(spark, one).count() == 1 and io.read_records_json(spark, many).count() == 2
    row = io.read_records_csv(spark, csv).first()
    assert row.disease == "A" and row.symptoms == 'b, "c"\nd' and row.cause is None
    assert io.read_synonyms(spark, syn) == [("b", ["x", "y"]), ("a", [])] and io.read_synonyms(spark, syn + "none") == []
    assert io.synonym_table(spark, [("b", ["x", "y"])]).count() == 2
    cases = spark.createDataFrame([("q, \"x\"", 1, "exact", "n"), (" ", 2, "exact", None)], "query string, expected_data_id long, category string, note string")
    io.write_testset(cases, str(tmp_path / "cases"))
    back = io.read_testset_csv(spark, str(tmp_path / "cases")).collect()
    assert [(r.query, r.expected_data_id) for r in back] == [('q, "x"', 1)]
    io.write_results(cases, cases, str(tmp_path / "out"), "r1")
    io.write_results(cases, cases, str(tmp_path / "out"), "r2")
    io.write_results(cases, cases, str(tmp_path / "out"), "r2")  # a rerun takes the place of its rows
    assert spark.read.parquet(str(tmp_path / "out/latest_results")).count() == 2 and spark.read.parquet(str(tmp_path / "out/failures")).count() == 4
    seed = records.withColumn("pos", F.col("data_id"))
    assert [r.data_id for r in io.seed_if_empty(None, seed).orderBy("data_id").collect()] == list(range(1, len(ROWS) + 1))
    assert io.seed_if_empty(records, seed).count() == len(ROWS) and io.seed_if_empty(records, seed.limit(2), reseed=True).count() == 2
    io.append_seed(records, str(tmp_path / "seed"))
    io.append_seed(records, str(tmp_path / "seed"))
    assert spark.read.parquet(str(tmp_path / "seed")).count() == 2 * len(ROWS)


def test_registry():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "bm25_topk" in queries
