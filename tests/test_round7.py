"""Tests of the findings that were mended after round 7."""

from __future__ import annotations

import hashlib
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.operators import dense, encoders, health, pairs, search, sparse
from trawl.operators.chunking import row_combined

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_dense_topk_asks_every_vector(spark, tmp_path):
    """Only every fiftieth vector was a query."""
    import __spark_entry__

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query_id, r["rank"]): r.data_id for r in __spark_entry__.queries()["dense_topk"](spark, str(tmp_path)).collect()}
    matrix = np.array([v for _, v in rows], np.float64)
    order = np.lexsort((np.tile(np.arange(120), (120, 1)), -np.round(matrix @ matrix.T, 6)), axis=1)[:, :5]
    assert got == {(i, r + 1): int(order[i, r]) for i in range(120) for r in range(5)}


@pytest.mark.parametrize("k", [1, 4, 50])
def test_dense_blocks(spark, monkeypatch, k):
    """Many blocks on both sides, records in several of them, slices of queries, and products that are no number: nothing is shuffled but lists."""
    monkeypatch.setattr(dense, "BLOCK_ROWS", 16)
    monkeypatch.setattr(dense, "CELLS", 100)
    monkeypatch.setattr(dense, "FIRST", 3)
    rng = np.random.default_rng(9)
    d = [(int(rng.integers(0, 60)), rng.integers(-2, 3, 4).astype(float).tolist()) for _ in range(200)] + [(70, [float("nan"), 1.0, 0.0, 0.0])]
    q = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(45)]
    found = dense.dense_search(spark.createDataFrame(q, "query_id long, vector array<double>"), spark.createDataFrame(d, "data_id long, vector array<double>"), k)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.data_id)
    for i, v in q:
        own = {}
        for r, w in d:
            own[r] = max(own.get(r, -99.0), float(np.dot(v, w))) if r < 70 else -100.0
        assert got[i] == sorted(own, key=lambda r: (-own[r], r))[:k]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and plan.split("Initial Plan")[0].count("Exchange hash") == 2


def test_a_sheet_is_made_once_for_many_chunks(spark, monkeypatch):
    """The matrix of each sheet of queries used to be made anew for each slice of chunks."""
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(40)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(90)]
    grams = sparse.WORD_GRAMS
    owner, code, count = sparse.counted_grams(texts[:30], grams)
    asked = sparse.Asked(np.arange(30), np.searchsorted(owner, np.arange(31)), code, count.astype(float))
    made, rough = [], sparse.Sheet.rough
    monkeypatch.setattr(sparse.Sheet, "rough", lambda self, *a: made.append(self.start) or rough(self, *a))
    monkeypatch.setattr(sparse, "ENTRY_CELLS", 10**9)

    def found(cells, waiting):
        monkeypatch.setattr(sparse, "HELD_CELLS", cells)
        monkeypatch.setattr(sparse, "WAITING_ROWS", waiting)
        lists = sparse.Lists(asked, 4)
        made.clear()
        for start in range(0, 90, 3):
            row, own, n = sparse.counted_grams(texts[start : start + 3], grams)
            lists.add(np.arange(start, start + 3) // 2, row, own, n.astype(float))
        rows = lists.found().to_pylist()
        return len(lists.sheets), len(made), sorted((r["query_id"], r["data_id"], round(r["score"], 9)) for r in rows)

    one, _, want = found(10**7, 512)
    sheets, times, got = found(2_000, 512)
    assert one == 1 and sheets > 2 and got == want and times == sheets
    assert found(2_000, 20)[2] == want
    monkeypatch.setattr(sparse, "SLICE_CELLS", 700)
    assert found(2_000, 20)[2] == want
    monkeypatch.setattr(sparse, "SLICE_CELLS", 4_000_000)
    monkeypatch.setattr(sparse, "ENTRY_CELLS", 0)
    assert found(2_000, 20)[1:] == (0, want)


def _records(spark):
    rng = np.random.default_rng(12)
    topics = [["".join(rng.choice(list("abcdefghijkl"), 4)) for _ in range(12)] for _ in range(5)]
    texts = [" ".join(rng.choice(topics[i % 5], 9)) for i in range(60)] + ["", None, "same same text", "same same text", "  x y"]
    return spark.createDataFrame([(i * 2, f"name{i % 7} {topics[i % 5][0]}", t) for i, t in enumerate(texts)], "data_id long, symptoms string, cause string").repartition(4).cache()


@pytest.mark.parametrize(("k", "block"), [(1, 7), (3, 16), (3, 500)])
def test_one_comparison_gives_lists_and_pairs(spark, k, block):
    """Lists and pairs each used to multiply all blocks, lists in both orders."""
    records = _records(spark)
    lists, found = health._compared(records, k, 0.45, block)
    want = pairs.similar_pairs(health.plain_chunks(records), 0.45).toPandas()
    assert found.first()["n"] == len(want) > 100 and abs(found.first()["total"] - want["similarity"].sum()) < 1e-9
    own = F.when(F.coalesce("cause", F.lit("")) == "", F.col("symptoms")).otherwise(F.col("cause"))
    asked = records.select("data_id", F.lit(0).cast("long").alias("chunk_id"), own.alias("text"))
    near = search.top_k(search.max_pool(search.pad_zeros(pairs.nearest(asked, row_combined(records), k), asked.select(F.col("data_id").alias("query_id")), row_combined(records), k)), k)
    flat = lambda df: sorted((r.query_id, r["rank"], r.data_id, round(r.score, 9)) for r in df.collect())
    assert flat(lists) == flat(near)


def test_counts_of_the_report(spark, monkeypatch):
    """Without the rows of the report, also where a blank record counts as a text for pairs, and where no task holds the vocabulary."""
    records = _records(spark).withColumn("diagnosis", F.lit("")).withColumn("treatment", F.lit(""))
    for rows, held in ((records, 2_000_000), (records.unionByName(records.where("data_id = 0").selectExpr("999L AS data_id", "'' AS symptoms", "' ' AS cause", "diagnosis", "treatment")), 2_000_000), (records, 5)):
        monkeypatch.setattr(sparse, "HELD_GRAMS", held)
        report = health.health_report(rows).cache()
        want = {r["check"]: (r.n, round(r.total, 6)) for r in report.groupBy("check").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).collect()}
        assert {r["check"]: (r.n, round(r.total, 6)) for r in health.health_counts(rows).collect()} == want and len(want) > 5
        assert health.issue_count(rows).first() == health.issue_total(report).first()


def test_files_of_few_blocks(spark):
    """A task's reader used to hold all blocks of a file, each of which takes megabytes."""
    texts = health.plain_chunks(_records(spark)).coalesce(1)
    table = pairs.packed(texts, *pairs.tfidf_model(texts), 1)
    files = table.groupBy(F.input_file_name()).count().toPandas()
    assert files["count"].max() <= pairs.FILE_BLOCKS and files["count"].sum() == 65


def test_projection_counts_in_arrays(monkeypatch):
    """Each gram's md5 used to be made anew for every 128 texts, and grams were counted one by one."""
    rng = np.random.default_rng(13)
    texts = ["", "  ", "a", " ab ", "　x　", "a  \0b", "\0", "\U0001f600é", "x" * 120_000 + " y", "abc" * 30_000, *("".join(rng.choice(list("abc dé"), 40)) for _ in range(200))]

    def plain(text):
        padded, out = f" {text.strip()} ", np.zeros(32)
        for at in range(max(1, len(padded) - 2)):
            out += [2 * int(d, 16) - 15 for d in hashlib.md5(padded[at : at + 3].encode()).hexdigest()]
        return out

    want = np.array([plain(t) for t in texts])
    hashed = []
    monkeypatch.setattr(encoders, "hashlib", type("counted", (), {"md5": staticmethod(lambda x: hashed.append(x) or hashlib.md5(x))}))
    monkeypatch.setattr(encoders, "_DIGITS", encoders._Digits())
    for _ in range(3):
        assert (encoders.projection(texts) == want).all()
    assert len(hashed) == len(set(hashed)) + 2  # the blank text's alone is made each time
    monkeypatch.setattr(encoders, "DIGITS_HELD", 20)
    assert (encoders.projection(texts) == want).all()
