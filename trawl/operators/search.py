"""Batch search: a table of queries (query_id, query) against an index, ranked, fused and attached to records.

Ranked lists are (query_id, data_id, rank, score). Ranking orders by rounded scores, then by data_id, so that equal
texts rank alike whatever order sums were made in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.ids import id_numbers, is_long
from trawl.functions.scratch import materialise
from trawl.functions.text import is_blank, search_text
from trawl.operators import sparse, stored
from trawl.operators.cache import encode
from trawl.operators.index import K1, NGRAM, B, bm25_weights, corpus_stats, tfidf_vocabulary, tfidf_weights

RRF_K, LOOKED = 60, 1_000
TOP_K, MIN_SIMILARITY = 2, {"tfidf": 0.19, "dense": 0.35}


def max_pool(scores: DataFrame) -> DataFrame:
    """A record scores at its best chunk."""
    return scores.groupBy("query_id", "data_id").agg(F.max("score").alias("score"))


def top_k(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", digits).desc(), "data_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "data_id", "rank", "score")


def any_ids(search):
    """Searches work on long ids. Here ids of other types are numbered in their order on the way in and named again on the way out,
    and rows without a query_id or a data_id are left out."""

    def coded(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame | None]:
        rows = rows.where(F.col(column).isNotNull())
        if is_long(rows, column):
            return rows, None
        names = id_numbers(rows, column)
        return rows.join(names, rows[column] == names["id"]).drop(column, "id").withColumnRenamed("number", column), names

    @wraps(search)
    def run(queries: DataFrame, chunks, *args, **options) -> DataFrame:
        queries, query_names = coded(queries, "query_id")
        chunks, data_names = coded(chunks, "data_id") if isinstance(chunks, DataFrame) and not sparse.is_shared(chunks) else (chunks, None)
        hits = search(queries, chunks, *args, **options)
        for column, names in (("query_id", query_names), ("data_id", data_names)):
            if names is not None:
                hits = hits.join(names, hits[column] == names["number"]).drop(column, "number").withColumnRenamed("id", column)
        return hits.select("query_id", "data_id", "rank", "score")

    return run


def shared(chunks: DataFrame, k: int) -> DataFrame:
    """Chunks most of which are short, as phrases are, as ``sparse.shared_texts`` for searches for k or fewer; others as they are, and all whose ids
    are no integers. A look at LOOKED chunks chooses between the two, which find the same."""
    if sparse.is_shared(chunks) or not is_long(chunks, "data_id"):
        return chunks
    size = chunks.limit(LOOKED).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.char_length("text") <= sparse.SHARED_CHARS).alias("short")).first()
    return sparse.shared_texts(chunks, k) if 2 * size["short"] > size["n"] else chunks


@any_ids
def bm25_search(queries: DataFrame, chunks: DataFrame, k: int = 5, k1: float = K1, b: float = B, n: int = NGRAM) -> DataFrame:
    """Only records with a score above zero are listed. Chunks are scored and cut to k where they are, for as many queries at a time
    as a task can hold; a null text or query is an empty one. Of short texts each is scored once."""
    grams, chunks = sparse.text_grams(n), shared(chunks, k)
    stats = corpus_stats(chunks, n).first()  # one row
    weighed = materialise(sparse.query_grams(queries, grams).withColumnRenamed("qn", "w"))
    parts = [sparse.local_lists(chunks, grams, bm25_weights(chunks, grams, np.unique(asked.codes), stats, k1, b), asked, k) for asked in sparse.query_passes(weighed)]
    return top_k(max_pool(_all(parts, queries)), k)


def _all(parts: list[DataFrame], queries: DataFrame) -> DataFrame:
    """The lists of all passes."""
    every = queries.sparkSession.createDataFrame([], "query_id long, data_id long, score double")
    for part in parts:
        every = every.unionByName(part)
    return every


def pad_zeros(scores: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Records without any similarity still fill a list up to k, lowest data_id first: only the k lowest can. The lists are to be pooled, which drops
    the zeros of records that they hold; they are read once."""
    if sparse.is_shared(chunks):
        chunks = chunks.select(F.explode("ids").alias("data_id"))
    first = F.broadcast(chunks.where("data_id is not null").select("data_id").distinct().orderBy("data_id").limit(k))  # k rows
    spare = queries.select("query_id").crossJoin(first)
    return scores.select("query_id", "data_id", "score").unionByName(spare.withColumn("score", F.lit(0.0)))


@any_ids
def tfidf_search(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Lists of k records, those without any similarity last. Chunks are scored and cut to k where they are, for as many queries at
    a time as a task can hold. If no task can hold the vocabulary, it is joined to the chunks' counts once, for their norms; scoring then needs the
    queries' grams alone. A null text or query is an empty one. Of short texts each is scored once."""
    chunks = shared(chunks, k)
    vocabulary = materialise(tfidf_vocabulary(chunks))
    weights = tfidf_weights(vocabulary)
    weighed = materialise(query_vectors(queries, vocabulary))
    normed = sparse.with_norms(chunks, sparse.WORD_GRAMS, vocabulary) if weights is None else None
    parts = []
    for asked in sparse.query_passes(weighed):
        names = np.unique(asked.codes)
        if weights is None:
            own = idf_of(vocabulary, names)
            parts.append(sparse.local_lists(normed, sparse.WORD_GRAMS, own, asked, k, norm="norm"))
        else:
            parts.append(sparse.local_lists(chunks, sparse.WORD_GRAMS, replace(weights, keep=names), asked, k))
    return top_k(max_pool(pad_zeros(_all(parts, queries), queries.select("query_id").distinct(), chunks, k)), k)


def idf_of(vocabulary: DataFrame, codes: np.ndarray) -> sparse.Weights:
    """The weights of these codes, of which a part of the queries has no more than a task can hold."""
    spark = vocabulary.sparkSession
    wanted = spark.createDataFrame(pd.DataFrame({"code": codes}), "code long")
    code, idf = sparse.columns(vocabulary.join(wanted, "code", "left_semi"), "code", "idf")
    order = np.argsort(code)
    return sparse.Weights(code[order].astype(np.int64), idf[order].astype(float))


def query_vectors(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Queries as unit vectors (query_id, code, w) over a vocabulary (code, idf)."""
    raw = sparse.query_grams(queries, sparse.WORD_GRAMS).join(vocabulary.select("code", "idf"), "code")
    raw = raw.select("query_id", "code", (F.col("qn") * F.col("idf")).alias("w"))
    norms = raw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "query_id").select("query_id", "code", (F.col("w") / F.col("norm")).alias("w"))


@any_ids
def index_search(queries: DataFrame, path: str, k: int = 5, encoder: Callable[[list[str]], object] | None = None) -> DataFrame:
    """Lists of k records from what ``stored.build_index`` wrote, whatever backend did; no record is read and nothing is fitted. Of a lexical
    index only the buckets of the queries' grams are read."""
    from trawl.operators.dense import dense_search

    spark = queries.sparkSession
    info = stored.index_info(spark, path)
    if info is None:
        raise ValueError(f"no index under {path}")
    if info.backend == "dense":
        asked = encode(queries.select("query_id", F.col("query").alias("text")), encoder)
        hits = dense_search(asked.select("query_id", "vector"), stored.stored(spark, path, "vectors").select("data_id", "vector"), k)
    else:
        vocabulary = stored.stored(spark, path, "vocabulary")
        if info.backend == "bm25":
            weighed = sparse.query_grams(queries, sparse.text_grams(NGRAM)).join(vocabulary, "code").select("query_id", "code", (F.col("qn") * F.col("idf")).alias("w"))
        else:
            weighed = query_vectors(queries, vocabulary).join(vocabulary.select("code", "idf"), "code").select("query_id", "code", (F.col("w") * F.col("idf")).alias("w"))
        pooled = max_pool(_all(stored.stored_lists(spark, path, materialise(weighed), k), queries))
        if info.backend == "tfidf":
            pooled = max_pool(pad_zeros(pooled, queries.select("query_id").distinct(), stored.stored(spark, path, "documents"), k))
        hits = top_k(pooled, k)
    names = stored.data_names(spark, path)
    if names is None:
        return hits
    return hits.join(names, hits["data_id"] == names["number"]).select("query_id", F.col("id").alias("data_id"), "rank", "score")


def rrf_depth(k: int) -> int:
    """How deep each list is asked for before a fusion to k."""
    return max(4 * k, 20)


def rrf_fuse(lists: Sequence[DataFrame], k: int = RRF_K, weights: Sequence[float] | None = None, top: int = 5) -> DataFrame:
    """Reciprocal rank fusion; ties go to what was seen first, walking the first list, then the next."""
    weights = list(weights) if weights else [1.0] * len(lists)
    tagged = [
        one.select("query_id", "data_id", F.lit(i).alias("src"), "rank", (F.lit(float(w)) / (k + F.col("rank"))).alias("part"))
        for i, (one, w) in enumerate(zip(lists, weights, strict=True))
    ]
    every = tagged[0]
    for one in tagged[1:]:
        every = every.unionByName(one)
    fused = every.groupBy("query_id", "data_id").agg(F.sum("part").alias("score"), F.min(F.struct("src", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "seen")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "data_id", "rank", "score")


def threshold(hits: DataFrame, min_similarity: float) -> DataFrame:
    """Drops hits below the unrounded score, then rounds."""
    return hits.where(F.col("score") >= min_similarity).withColumn("score", F.round("score", 4))


def to_honest_names(records: DataFrame) -> DataFrame:
    return records.select(
        "data_id", F.col("symptoms").alias("disease"), F.col("cause").alias("symptoms"), F.col("diagnosis").alias("cause"), "treatment"
    )


def to_raw_names(records: DataFrame) -> DataFrame:
    return records.select(
        "data_id", F.col("disease").alias("symptoms"), F.col("symptoms").alias("cause"), F.col("cause").alias("diagnosis"), "treatment"
    )


def attach_records(hits: DataFrame, records: DataFrame) -> DataFrame:
    """The records of the hits, under honest names; the planner broadcasts the hits while they are few."""
    return hits.join(to_honest_names(records), "data_id").select("query_id", "rank", "data_id", "disease", "symptoms", "cause", "treatment", "score")


def dangling_hits(hits: DataFrame, records: DataFrame) -> DataFrame:
    return hits.join(records, "data_id", "left_anti")


def record_chunks(records: DataFrame) -> DataFrame:
    return records.select("data_id", F.lit(0).cast("long").alias("chunk_id"), search_text(F.col("cause"), F.col("symptoms")).alias("text"))


def search_records(queries: DataFrame, records: DataFrame, k: int | None = None, min_similarity: float | None = None, index: str | None = None, encoder=None) -> DataFrame:
    """Search as a service does it: blank queries get nothing, k of None or 0 is the default, a missing threshold is the backend's.

    With ``index`` the index under that path is searched, by its backend; without, the records are indexed for this table of
    queries by TF-IDF."""
    asked = queries.where(~is_blank(F.col("query")))
    if index is None:
        backend, hits = "tfidf", tfidf_search(asked, record_chunks(records), k or TOP_K)
    else:
        hits = index_search(asked, index, k or TOP_K, encoder)
        backend = stored.index_info(queries.sparkSession, index).backend
    return attach_records(threshold(hits, MIN_SIMILARITY.get(backend, 0.0) if min_similarity is None else min_similarity), records)


def hit_counts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of every query, zero included."""
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("hits"))
