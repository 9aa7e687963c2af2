"""BM25 and TF-IDF indexes over character n-grams, as plain tables.

Chunks are (data_id, chunk_id, text). Postings are (data_id, chunk_id, gram, tf). A table of queries only needs the
postings of its own grams, so searches pass them in as ``only``: the grams of a chunk then meet them before anything is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import char_ngrams, char_wb_ngrams, ngram_count
from trawl.operators import sparse

K1, B, NGRAM = 1.5, 0.75, 3
#: Grams of a table of queries are broadcast up to this many; beyond, the join is shuffled.
BROADCAST_GRAMS = 500_000


def exploded(chunks: DataFrame, grams, only: DataFrame | None) -> DataFrame:
    rows = chunks.select("data_id", "chunk_id", F.explode(grams).alias("gram"))
    if only is not None:
        few = only.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
        rows = rows.join(F.broadcast(only) if few else only, "gram", "left_semi")
    return rows


def term_frequencies(chunks: DataFrame, n: int = NGRAM, only: DataFrame | None = None) -> DataFrame:
    return exploded(chunks, char_ngrams(F.col("text"), n), only).groupBy("data_id", "chunk_id", "gram").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """Reads ``tf``, so that the planner uses one exchange of postings for this and for the scores."""
    return postings.groupBy("gram").agg(F.count_if(F.col("tf") > 0).alias("df"))


def corpus_stats(chunks: DataFrame, n: int = NGRAM) -> DataFrame:
    """One row: n chunks and their average number of grams, also of ``shared_texts``."""
    times = _times(chunks)
    return chunks.agg(
        F.coalesce(F.sum(times), F.lit(0)).alias("n"),
        (F.coalesce(F.sum(times * ngram_count(F.col("text"), n)), F.lit(0)) / F.greatest(F.coalesce(F.sum(times), F.lit(0)), F.lit(1))).alias("avg_len"),
    )


def _times(chunks: DataFrame):
    """How many chunks a row stands for."""
    return F.col("times") if sparse.is_shared(chunks) else F.lit(1).cast("long")


def bm25_idf(n, df):
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5) + 1.0), F.lit(0.0))


def fit_bm25(chunks: DataFrame, k1: float = K1, b: float = B, n: int = NGRAM, only: DataFrame | None = None) -> DataFrame:
    """Postings with what each adds to a score: (gram, data_id, chunk_id, tf, df, idf, impact)."""
    postings = term_frequencies(chunks, n, only)
    lengths = chunks.select("data_id", "chunk_id", ngram_count(F.col("text"), n).alias("dl"))
    stats = F.broadcast(corpus_stats(chunks, n))  # one row
    held = postings.join(lengths, ["data_id", "chunk_id"]).join(document_frequencies(postings), "gram").crossJoin(stats)
    idf = bm25_idf(F.col("n"), F.col("df"))
    damp = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest(F.col("avg_len"), F.lit(1e-9)))
    return held.select("gram", "data_id", "chunk_id", "tf", "df", idf.alias("idf"), (idf * F.col("tf") * (k1 + 1) / damp).alias("impact"))


def wb_frequencies(texts: DataFrame, only: DataFrame | None = None) -> DataFrame:
    return exploded(texts, char_wb_ngrams(F.col("text")), only).groupBy("data_id", "chunk_id", "gram").agg(F.count(F.lit(1)).alias("tf"))


def fit_tfidf(chunks: DataFrame) -> DataFrame:
    """The vocabulary: (gram, df, idf), smoothed."""
    size = F.broadcast(chunks.agg(F.count(F.lit(1)).alias("n")))
    seen = sparse.named_frequencies(chunks, sparse.WORD_GRAMS)
    return seen.crossJoin(size).select("gram", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def encode_tfidf(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Sparse unit vectors (data_id, chunk_id, gram, w); grams outside the vocabulary do not count."""
    raw = wb_frequencies(texts).join(vocabulary, "gram").select("data_id", "chunk_id", "gram", (F.col("tf") * F.col("idf")).alias("w"))
    norms = raw.groupBy("data_id", "chunk_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, ["data_id", "chunk_id"]).select("data_id", "chunk_id", "gram", (F.col("w") / F.col("norm")).alias("w"))


def _held(rows: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The rows (code, idf) by code, or None if there are more than a task may hold."""
    if rows.limit(sparse.HELD_GRAMS + 1).count() > sparse.HELD_GRAMS:
        return None
    return _by_code(rows)


def _by_code(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order and their idf."""
    code, idf = sparse.columns(rows, "code", "idf")
    order = np.argsort(code)
    return code[order].astype(np.int64), idf[order].astype(float)


def tfidf_vocabulary(chunks: DataFrame) -> DataFrame:
    """(code, df, idf) of all grams inside words, also of ``shared_texts``."""
    size = F.broadcast(chunks.agg(F.coalesce(F.sum(_times(chunks)), F.lit(0)).alias("n")))
    seen = sparse.gram_frequencies(chunks, sparse.WORD_GRAMS).crossJoin(size)
    return seen.select("code", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_weights(vocabulary: DataFrame) -> sparse.Weights | None:
    """The vocabulary as weights, or None if a task could not hold it."""
    held = _held(vocabulary.select("code", "idf"))
    return sparse.Weights(*held) if held else None


def bm25_weights(chunks: DataFrame, grams: sparse.Grams, codes: np.ndarray, stats, k1: float = K1, b: float = B) -> sparse.Weights:
    """Weights of the grams with these sorted codes."""
    found = sparse.gram_frequencies(chunks, grams, codes).select("code", bm25_idf(F.lit(stats["n"]), F.col("df")).alias("idf"))
    return sparse.Weights(*_by_code(found), bm25=(k1, b, float(stats["avg_len"])))
