"""What the third round of findings asked for: bounded tasks, with the results as they were."""

import numpy as np
import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators import dense, index, sparse, testset
from trawl.plans import registry
from trawl.sources import io


@pytest.fixture(scope="module")
def wordy(spark):
    rows = [(i // 2, f"r{i}", " ".join(f"phrase{j * 7 % 50:03}" for j in range(i * 9 % 40))) for i in range(30)] + [(99, "none", None)]
    return spark.createDataFrame(rows, "data_id long, symptoms string, cause string").repartition(3)


def test_drawn_inside_rows(wordy):
    """Rows are cut to what may be drawn before anything is sorted or shuffled; records of several rows are drawn from all of them."""
    order = Window.partitionBy("data_id").orderBy(testset.draw("single", F.col("data_id"), F.col("pos")), "pos")
    want = testset.phrases(wordy).withColumn("turn", F.row_number().over(order)).where("turn <= 3")
    got = testset._drawn(wordy, "single", testset.SEED, 3)
    rows = lambda df: sorted((r.data_id, r.pos, r.turn) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 30
    cut = testset.first_drawn(wordy, "single", testset.SEED, 3)
    assert cut.groupBy("data_id").count().agg(F.max("count")).first()[0] <= 6 and "Window" not in cut._jdf.queryExecution().toString()


def test_colloquial_draws_where_terms_are(wordy):
    """Phrases without a term are gone before anything is drawn; terms may make others."""
    plan = testset.cases_colloquial(wordy, [("phrase00", ["x"])])._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan or "contains(" in plan
    got = testset.cases_colloquial(wordy, [("phrase007", ["abcdef1"]), ("abcdef", ["ghijkl"])])
    assert {r.note for r in got.collect()} == {"from: phrase007"} and all("ghijkl1" in r.query for r in got.collect())
    assert testset.cases_colloquial(wordy, []).count() == 0


def test_dense_in_slices(spark, monkeypatch):
    """No task holds more products than a slice of its queries needs; ties go by id."""
    rng = np.random.default_rng(2)
    d = [(i // 2, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(120)]
    q = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(40)]
    frames = spark.createDataFrame(q, "query_id long, vector array<double>"), spark.createDataFrame(d, "data_id long, vector array<double>")
    best = {}
    for i, v in q:
        own = {}
        for r, w in d:
            own[r] = max(own.get(r, -99.0), float(np.dot(v, w)))
        best[i] = sorted(own, key=lambda r: (-own[r], r))[:5]
    key, queries, chunks = (0,), frames[0].toPandas(), frames[1].toPandas()
    monkeypatch.setattr(dense, "CELLS", 300)
    seen = []
    held = dense._best
    monkeypatch.setattr(dense, "_best", lambda pooled, ids, n: seen.append(pooled.size) or held(pooled, ids, n))
    found = dense._scores(5)(key, queries, chunks)
    assert max(seen) <= 300 and len(seen) == 20
    assert {i: own["data_id"].tolist() for i, own in found.groupby("query_id")} == best


def test_queries_reach_the_driver_as_columns(spark, monkeypatch):
    """Neither queries nor vocabularies become row objects on the driver."""
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "toPandas", lambda self: pytest.fail("rows on the driver"))
    monkeypatch.setattr(frame, "collect", lambda self: pytest.fail("rows on the driver"))
    weighed = spark.range(1000).selectExpr("id % 100 AS query_id", "id * 7919 % 311 AS code", "id / 3 AS w").distinct()
    monkeypatch.setattr(sparse, "HELD_ENTRIES", 300)
    parts = list(sparse.query_passes(weighed))
    assert len(parts) > 2 and sum(len(p.codes) for p in parts) == 1000 and np.unique(np.concatenate([p.ids for p in parts])).tolist() == list(range(100))
    weights = index.tfidf_weights(spark.createDataFrame([(5, 0.5), (-3, 1.5)], "code long, idf double"))
    assert weights.codes.tolist() == [-3, 5] and weights.idf.tolist() == [1.5, 0.5]
    monkeypatch.setattr(sparse, "HELD_GRAMS", 1)
    assert index.tfidf_weights(spark.createDataFrame([(5, 0.5), (-3, 1.5)], "code long, idf double")) is None


def test_blocks_are_the_longest_that_fit(monkeypatch):
    rng = np.random.default_rng(4)
    own = [np.unique(rng.integers(0, 80, n)) for n in rng.integers(1, 30, 200)]
    asked = sparse.Asked(np.arange(200), np.append(0, np.cumsum([len(c) for c in own])), np.concatenate(own), np.ones(sum(map(len, own))))
    monkeypatch.setattr(sparse, "HELD_CELLS", 700)
    blocks, at = asked.blocks(), 0
    for start, end, names in blocks:
        cells = lambda e, start=start: len(np.unique(np.concatenate(own[start:e]))) * (e - start)
        assert start == at and (end == start + 1 or cells(end) <= 700) and (end == 200 or cells(end + 1) > 700)
        assert names.tolist() == np.unique(np.concatenate(own[start:end])).tolist()
        at = end
    assert at == 200 and len(blocks) > 5


def test_grams_counted_in_a_table_or_sorted(monkeypatch):
    """Both ways of counting give the same, and codes are sorted only once each."""
    texts = ["the cat the cat", "", "dog  et Élan 🎉🎉", "x" * 40]
    monkeypatch.setattr(sparse, "CELLS_A_GRAM", 1000)
    many = [[x.tolist() for x in sparse.counted_grams(texts, g)] for g in (sparse.WORD_GRAMS, sparse.text_grams(3))]
    monkeypatch.setattr(sparse, "CELLS_A_GRAM", 0)
    assert many == [[x.tolist() for x in sparse.counted_grams(texts, g)] for g in (sparse.WORD_GRAMS, sparse.text_grams(3))]
    names, place = sparse._ranked(np.array([9, 2**63 + 1, 9, 4], np.uint64))
    assert names.tolist() == [4, 9, 2**63 + 1] and place.tolist() == [1, 2, 1, 0]


def test_vocabulary_counted_in_tasks(spark, monkeypatch):
    """Grams are counted and spelled in tasks: no row for each gram of each text is shuffled. Tasks that hold no more hand on what they have."""
    texts = ["the cat sat", "THE cat", "a 🎉 dog\tcat", "", None, "x " * 400 + "longerword" * 30]
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "data_id long, chunk_id long, text string").repartition(2)
    rows = chunks.select("data_id", F.explode(F.array_distinct(T.char_wb_ngrams(F.coalesce("text", F.lit(""))))).alias("gram"))
    want = {r.gram: r["count"] for r in rows.groupBy("gram").count().collect()}
    for slice_chars in (50_000, 100):
        monkeypatch.setattr(sparse, "SLICE_CHARS", slice_chars)
        found = index.fit_tfidf(chunks)
        assert {r.gram: r.df for r in found.collect()} == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Generate explode" not in plan


def test_vectors_are_summed_where_they_are(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(index, "encode_tfidf", lambda *a: pytest.fail("a row for each gram of each text"))
    rows = [(i, t, "xx", "web", 3) for i, t in enumerate(["one two two", "three one", "", "four"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.tfidf_vectors(spark, str(tmp_path)).collect()
    assert {r.data_id for r in found} == {1, 2, 3, 4} and all(r.norm == 1.0 and r.grams > 3 for r in found)


def test_results_are_made_once(spark, monkeypatch, tmp_path):
    rows = [(1, "short", "xx", "web", 5), (2, "phrases enough phrases enough", "xx", "web", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    write, plans = io.write_results, []
    monkeypatch.setattr(io, "write_results", lambda thin, *a: plans.append(thin._jdf.queryExecution().optimizedPlan().toString()) or write(thin, *a))
    found = {(r.kind, r.run_id): r.n for r in registry.run_results(spark, str(tmp_path)).collect()}
    assert found[("results", "r1")] == found[("results", "r2")] and len(plans) == 3
    assert not any("split(" in p for p in plans)
