"""The pipeline's stages against brute force, on rows with the awkward cases in them."""

import random
import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SYLLABLES = ["the", "ing", "tion", "er", "an", "ous"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, mix_id long, mix_times string, mix_time int, c0 string, copies int, kept boolean, rid string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choices(SYLLABLES, k=3)) for _ in range(n))
    out = [(i, text(rng.randint(20, 80)), "en", rng.choice("ab"), 1, "k") for i in range(40)]
    near = out[3][1].split()
    near[-1] = "new"
    out += [(50, out[0][1], "en", "a", 1, "k"), (51, " ".join(near), "en", "b", 1, "k"), (52, "", "en", "a", 1, "k"), (53, None, None, None, None, None), (54, "12 34", "en", "a", 1, "k")]
    return [(*r, 7, "t", 9, "c", 2, None, "r") for r in [*out, out[5], (None, text(30), "en", None, 1, "k")]]


def test_stages(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        seen[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == columns
            assert {tuple(r)[6:] for r in seen[name]} == {(7, "t", 9, "c", 2, None, "r")}
    texts = lambda name: [r.text for r in seen[name]]
    lettered = [r for r in rows if re.search("[a-z]", r[1] or "")]
    assert Counter(texts("language_id")) == Counter(r[1] for r in lettered)
    assert Counter(texts("exact_dedup")) == Counter({t: 1 for t in texts("language_id")})
    assert 50 in {r.doc_id for r in seen["exact_dedup"]} and 0 not in {r.doc_id for r in seen["exact_dedup"]}
    ids = {r.doc_id for r in seen["near_dedup"]}
    assert 3 in ids and 51 not in ids and len(seen["near_dedup"]) == len(seen["exact_dedup"]) - 1
    times = Counter(texts("mixing"))
    assert set(times) <= set(texts("near_dedup")) and max(times.values()) <= 3
    assert Counter(r.decoded for r in seen["sentencepiece"]) == times


def test_reruns_agree(spark):
    """Rows that repeat a doc_id, a text or both, and differ in other columns: what stays and what is taken depends on no partitioning."""
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choices(SYLLABLES, k=3)) for _ in range(n))
    texts = [text(30) for _ in range(40)]
    rows = [(rng.choice([None, 1, 2, i]), rng.choice(texts) if i % 3 else text(30), "en", rng.choice(["a", "b", None]), i, f"k{i}", i % 5, None, i % 3, "c", 2, i % 2 == 0, "r") for i in range(260)]
    rows += [(7, texts[0], "en", "a", i, f"m{i}", i, "x", 1, "c", 2, None, "r") for i in range(9)]
    seen = []
    for parts in (1, 3, 7):
        mixed = rows[:]
        rng.shuffle(mixed)
        docs, kept = spark.createDataFrame(mixed, SCHEMA).repartition(parts), []
        for name, stage in corpus_pipeline.STAGES[1:4]:
            own = spark.createDataFrame(mixed, SCHEMA).repartition(parts) if name == "mixing" else docs
            docs = stage(spark, own, "").cache()
            kept.append(sorted(map(repr, docs.collect())))
        seen.append(kept)
    assert seen[0] == seen[1] == seen[2]
    assert all(0 < len(own) < len(rows) for own in seen[0][:2]) and len(set(seen[0][2])) > 100


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
