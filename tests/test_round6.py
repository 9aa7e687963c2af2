"""Stored indexes: what is shuffled for their postings, and limits of what a task holds."""

import numpy as np
import pytest

from trawl.operators import search, sparse, stored

RECORD = "data_id long, disease string, symptoms string, cause string, treatment string"


def _records(spark, n, words, seed):
    rng = np.random.default_rng(seed)
    own = ["".join(rng.choice(list("abcdefghijkl"), rng.integers(2, 9))) for _ in range(400)]
    return spark.createDataFrame([(i, f"d{i}", " ".join(rng.choice(own, words)), "", "") for i in range(n)], RECORD)


def _shuffled(spark):
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_postings_are_shuffled_once_and_packed(spark, tmp_path):
    """A row an entry used to be grouped twice, and again for the norms."""
    records, path = _records(spark, 500, 150, 1).repartition(4), str(tmp_path / "index")
    records.count()
    before = _shuffled(spark)
    stored.build_index(records, path)
    entries = stored.postings(spark, path, stored.index_info(spark, path)).selectExpr("sum(size(docs))").first()[0]
    assert entries > 100_000 and _shuffled(spark) - before < 6 * entries


@pytest.mark.parametrize("backend", ["tfidf", "bm25"])
def test_indexes_in_small_parts(spark, tmp_path, monkeypatch, backend):
    """Segments, held postings, ranges of the vocabulary and of what is gone, and files of a bucket, all of more than one."""
    records, path, anew = _records(spark, 40, 30, 2), str(tmp_path / "index"), str(tmp_path / "anew")
    queries = records.where("data_id % 7 = 0").selectExpr("data_id AS query_id", "symptoms AS query")
    stored.build_index(records, anew, backend)
    want = [(r.query_id, r.data_id, r["rank"], round(r.score, 9)) for r in search.index_search(queries, anew, 4).orderBy("query_id", "rank").collect()]
    for module, name, value in ((stored, "SEGMENT_DOCS", 3), (stored, "FILE_SEGMENTS", 4), (stored, "HELD_POSTINGS", 300), (sparse, "HELD_GRAMS", 200), (sparse, "HELD_ENTRIES", 4)):
        monkeypatch.setattr(module, name, value)
    older = records.where("data_id % 3 <> 0").selectExpr("data_id", "disease", "CASE WHEN data_id % 2 = 0 THEN concat('before ', symptoms) ELSE symptoms END AS symptoms", "cause", "treatment")
    stored.build_index(older.unionByName(_records(spark, 60, 5, 3).where("data_id > 45")).repartition(3), path, backend)
    assert stored.update_index(records, path) == (27, 27)
    monkeypatch.setattr(sparse, "HELD_ENTRIES", 4_000_000)
    assert [(r.query_id, r.data_id, r["rank"], round(r.score, 9)) for r in search.index_search(queries, path, 4).orderBy("query_id", "rank").collect()] == want
    columns = ["data_id", "length", "norm"]
    norms = [{r.data_id: (r.length, round(r.norm, 9)) for r in stored.stored(spark, p, "documents").select(*columns).collect()} for p in (path, anew)]
    assert norms[0] == norms[1] and len(norms[0]) == 40
    frequencies = [sorted(map(tuple, stored.stored(spark, p, "vocabulary").select("code", "df").collect())) for p in (path, anew)]
    assert frequencies[0] == frequencies[1] and len(frequencies[0]) > 200


def test_packed_rows(spark):
    rows = [(-5, 2, [0, 3, 4], [1, 1, 9]), (7, 2, [4095], [70_000]), (7, 3, [1, 4094], [2, 1]), (9, 2, [0], [1])]
    table = spark.createDataFrame(rows, "code long, segment long, docs array<short>, counts array<int>").coalesce(1)
    found = stored._packed(table, table["segment"]).collect()
    assert sorted(r.key for r in found) == [2, 3]
    assert sorted((x["code"], x["segment"], x["docs"], x["counts"]) for r in found for x in stored._unpacked(r.data).to_pylist()) == rows
