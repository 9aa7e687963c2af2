"""Retrieval evaluation: ranks of what was expected, recall, reciprocal rank, noise gap, per-category accuracy, verdicts.

Results are (chunking, retriever, case_id, data_id, rank, score); cases are (case_id, query, expected_data_id, category).
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.scratch import materialise
from trawl.operators.cache import Encoder, encode
from trawl.operators.dense import dense_search
from trawl.operators.search import bm25_search, rrf_depth, rrf_fuse, search_records, shared, tfidf_search, to_honest_names
from trawl.operators.sparse import is_shared

CONFIG = ["chunking", "retriever"]
CATEGORIES = ("exact", "single", "partial", "colloquial", "typo", "negative")
FRAGILE = 0.05


def judged(results: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """A row for each config and case: rank of what was expected (0: not among k), the first hit and its score."""
    seen = results.where(F.col("rank") <= k)
    configs = F.broadcast(results.select(*CONFIG).distinct())  # one row a config
    per_case = seen.join(cases.select("case_id", "expected_data_id"), "case_id").groupBy(*CONFIG, "case_id").agg(
        F.min(F.when(F.col("data_id") == F.col("expected_data_id"), F.col("rank"))).alias("rank"),
        F.max(F.when(F.col("rank") == 1, F.col("data_id"))).alias("got"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"),
    )
    return cases.crossJoin(configs).join(per_case, [*CONFIG, "case_id"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def metrics(judgements: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """One row a config. Config totals and categories come from one pass of grouping sets."""
    positive, asked = F.col("expected_data_id") > 0, F.col("expected_data_id") >= 0
    hit = lambda c: F.when(positive & c, 1).otherwise(0)
    grouped = judgements.groupingSets([[F.col(c) for c in CONFIG], [F.col(c) for c in [*CONFIG, "category"]]], *CONFIG, "category").agg(
        F.grouping("category").alias("total"),
        (F.sum(hit(F.col("rank") == 1)) / F.greatest(F.sum(hit(F.lit(True))), F.lit(1))).alias("recall_1"),
        (F.sum(hit(F.col("rank").between(1, 3))) / F.greatest(F.sum(hit(F.lit(True))), F.lit(1))).alias("recall_3"),
        F.coalesce(F.avg(F.when(asked, F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0))), F.lit(0.0)).alias("mrr"),
        (F.min(F.when(asked & (F.col("rank") == 1), F.col("top_score"))) - F.max(F.when(~asked, F.col("top_score")))).alias("noise_gap"),
        F.avg(F.when(asked, (F.col("rank") == 1).cast("double"))).alias("accuracy"),
    )
    cat = lambda c: F.coalesce(F.max(F.when((F.col("total") == 0) & (F.col("category") == c), F.round("accuracy", 4))), F.lit(0.0)).alias(f"cat_{c}")
    total = lambda c: F.max(F.when(F.col("total") == 1, F.round(c, 4))).alias(c)
    return grouped.groupBy(*CONFIG).agg(*[total(c) for c in ("recall_1", "recall_3", "mrr", "noise_gap")], *[cat(c) for c in categories if c != "negative"])


def failures(judgements: DataFrame) -> DataFrame:
    missed = judgements.where("expected_data_id >= 0 and rank <> 1")
    return missed.select(*CONFIG, "category", "query", F.col("expected_data_id").alias("expected"), "got", "rank")


def benchmark_results(cases: DataFrame, chunkings: dict[str, DataFrame], k: int = 5, encoder: Encoder | None = None) -> DataFrame:
    """Ranked lists of every chunking with BM25, TF-IDF and their fusion, and with an encoder dense search and its fusion with BM25."""
    return timed_results(cases, chunkings, k, encoder, 0)[0]


def timed_results(cases: DataFrame, chunkings: dict[str, DataFrame], k: int = 5, encoder: Encoder | None = None, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """(lists, timings): the lists of ``benchmark_results`` and the milliseconds a query that making each of them took, (chunking,
    retriever, latency_ms) for every round.

    Lists are made once a round, at the depth the fusions need, and written: k rows a query and list. A fused list counts what its
    parts took, too. Chunks and queries are encoded and weights are fitted before, as an index is built before it is searched. With no rounds nothing is timed, and
    fusions are left to the query that reads them."""
    queries = materialise(cases.select(F.col("case_id").alias("query_id"), "query"))
    n, depth, every, timings = max(queries.count(), 1), rrf_depth(k), None, []

    def timed(make, written=True):
        if not rounds:
            return (materialise(make()) if written else make()), []
        lists, found, took = make(), None, []  # what a search fits is fitted once
        for _ in range(rounds):
            began = time.perf_counter()
            found = materialise(lists)
            took.append(1000 * (time.perf_counter() - began) / n)
        return found, took

    for name, chunks in chunkings.items():
        chunks = shared(chunks, depth)  # once for all retrievers
        lists = {"bm25": timed(lambda: bm25_search(queries, chunks, depth)), "tfidf": timed(lambda: tfidf_search(queries, chunks, depth))}
        fused = {"hybrid(bm25+tfidf)": ("bm25", "tfidf")}
        if encoder:
            key = "ids" if is_shared(chunks) else "data_id"
            vectors = materialise(encode(chunks.select(key, "text"), encoder).select(key, "vector"))
            if key == "ids":
                vectors = vectors.select(F.explode("ids").alias("data_id"), "vector")
            asked = materialise(encode(queries.select("query_id", F.col("query").alias("text")), encoder).select("query_id", "vector"))
            lists["dense"] = timed(lambda: dense_search(asked, vectors, depth))
            fused["hybrid(bm25+dense)"] = ("bm25", "dense")
        for retriever, parts in fused.items():
            found, took = timed(lambda: rrf_fuse([lists[p][0] for p in parts], top=k), written=False)
            lists[retriever] = found, [sum(all_) for all_ in zip(took, *[lists[p][1] for p in parts], strict=True)]
        for retriever, (ranked, took) in lists.items():
            timings += [(name, retriever, ms) for ms in took]
            own = ranked.where(F.col("rank") <= k).select(
                F.lit(name).alias("chunking"), F.lit(retriever).alias("retriever"), F.col("query_id").alias("case_id"), "data_id", "rank", "score"
            )
            every = own if every is None else every.unionByName(own)
    return every, cases.sparkSession.createDataFrame(timings, "chunking string, retriever string, latency_ms double")


def containing(records: DataFrame, items: DataFrame, words: int = 5) -> DataFrame:
    """(item_id, data_id): the first record whose symptom list holds an item's text (item_id, text); items that none holds are left out.

    An item's words from the second on stand between white space, so they are words of a record that holds it: records meet items by five
    of them, and only those that share them are looked at. Items of fewer than seven words are looked for one by one."""
    cut = lambda c: F.split(F.col(c), r"\s+")
    sized = items.select("item_id", "text", cut("text").alias("w"))
    anchored = sized.where(F.size("w") >= words + 2).select("item_id", F.xxhash64(F.array_join(F.slice("w", 2, words), " ")).alias("anchor"))
    last = F.size("w") - words
    runs = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))
    held = records.select("data_id", cut("cause").alias("w")).where(last >= 0).select("data_id", F.explode(F.array_distinct(runs)).alias("anchor"))
    pairs = held.join(anchored, "anchor").select("data_id", "item_id")
    texts = records.select("data_id", "cause")
    found = pairs.join(items.select("item_id", "text"), "item_id").join(texts, "data_id").where(F.contains("cause", "text")).select("item_id", "data_id")
    short = sized.where(F.size("w") < words + 2).select("item_id", "text")
    if not short.isEmpty():
        found = found.unionByName(texts.join(short, F.contains("cause", "text")).select("item_id", "data_id"))
    return found.groupBy("item_id").agg(F.min("data_id").alias("data_id"))


def median_latency(timed: DataFrame) -> DataFrame:
    return timed.groupBy(*CONFIG).agg(F.median("latency_ms").alias("median_ms"))


def best_by_recall(rows: DataFrame) -> DataFrame:
    """The config with the highest recall, then reciprocal rank; the first of equals by ``config_ord``."""
    return rows.orderBy(F.desc("recall_1"), F.desc("mrr"), "config_ord").limit(1)


def recommended(rows: DataFrame, baseline: tuple[str, str] = ("row_combined", "tfidf")) -> DataFrame:
    """The best config that keeps noise below its hits, and what it gains on the baseline; no row if there is none."""
    base = rows.where((F.col("chunking") == baseline[0]) & (F.col("retriever") == baseline[1])).select(F.col("recall_1").alias("base_recall_1"))
    best = best_by_recall(rows.where("noise_gap > 0")).select(*CONFIG, "recall_1", "mrr", "noise_gap")
    return best.join(base, how="left").withColumn("gain", F.round(F.col("recall_1") - F.col("base_recall_1"), 4))


def weakest_category(by_category: DataFrame) -> DataFrame:
    """Of (chunking, retriever, category, accuracy): the category that some config does worst at, and the best that any reaches."""
    spread = by_category.groupBy("category").agg(F.min("accuracy").alias("worst"), F.max("accuracy").alias("best"))
    return spread.orderBy("worst", "category").limit(1).withColumn("flagged", F.col("best") < 0.8)


def category_accuracy(judgements: DataFrame) -> DataFrame:
    asked = judgements.where("expected_data_id >= 0")
    return asked.groupBy(*CONFIG, "category").agg(F.avg((F.col("rank") == 1).cast("double")).alias("accuracy"))


def regression_check(cases: DataFrame, records: DataFrame, min_similarity: float = 0.19) -> DataFrame:
    """Two hits a query, no threshold: (query_id, passed, top_score, margin, fragile, filtered). The margin of a lone hit is 99."""
    hits = search_records(cases.select("query_id", "query"), records, k=2, min_similarity=float("-inf"))
    order = Window.partitionBy("query_id").orderBy("rank")
    top = hits.withColumn("next", F.lead("score").over(order)).where("rank = 1").select("query_id", "disease", F.col("score").alias("top_score"), "next")
    passed = F.contains(F.lower(F.coalesce("disease", F.lit(""))), F.lower("expected_disease_contains")) & F.col("top_score").isNotNull()
    margin = F.when(F.col("next").isNull(), 99.0).otherwise(F.round(F.col("top_score") - F.col("next"), 4))
    return cases.join(top, "query_id", "left").select(
        "query_id", passed.alias("passed"), "top_score", margin.alias("margin")
    ).select("*", (F.col("passed") & (F.col("margin") < FRAGILE)).alias("fragile"), (F.col("passed") & (F.col("top_score") < min_similarity)).alias("filtered"))


def noise_floor(off_topic: DataFrame, records: DataFrame) -> DataFrame:
    """The best score that questions beside the point reach, and which one does."""
    hits = search_records(off_topic, records, k=1, min_similarity=float("-inf")).join(off_topic, "query_id")
    return hits.agg(F.max("score").alias("noise"), F.min_by("query", F.struct(-F.col("score"), "query_id")).alias("query"))


def accuracy_summary(checked: DataFrame) -> DataFrame:
    good = F.when(F.col("passed"), F.col("top_score"))
    return checked.agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"), F.min(good).alias("lowest"), F.max(good).alias("highest"))


def tune_threshold(lowest_correct: float | None, highest_noise: float | None) -> tuple[float, bool]:
    """(threshold, whether hits and noise are apart): between them, or just above the noise. Without noise it is 0, without right hits they are not apart."""
    highest_noise = highest_noise or 0.0
    if lowest_correct is not None and lowest_correct > highest_noise:
        return round((lowest_correct + highest_noise) / 2, 2), True
    return round(highest_noise + 0.01, 2), False


def disease_names(records: DataFrame) -> DataFrame:
    return to_honest_names(records).select("data_id", "disease")
