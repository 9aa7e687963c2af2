"""Data health: thin records, few phrases, pairs that are easily confused, records that do not find themselves, magnets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.scratch import materialise
from trawl.functions.text import split_phrases, strip
from trawl.operators.chunking import describe_chunks, row_combined
from trawl.operators.pairs import BLOCK_ROWS, compared, nearest, similar_pairs, tfidf_model
from trawl.operators.search import max_pool, pad_zeros, top_k

THIN_CHARS, FEW_PHRASES, CONFUSABLE = 20, 3, 0.45


def thin_records(records: DataFrame) -> DataFrame:
    n = F.char_length(strip(F.col("cause")))
    return records.select("data_id", n.cast("long").alias("chars")).where(F.col("chars") < THIN_CHARS)


def few_phrases(records: DataFrame) -> DataFrame:
    n = F.size(split_phrases(F.col("cause")))
    return records.select("data_id", n.cast("long").alias("phrases")).where(F.col("phrases") < FEW_PHRASES)


def plain_chunks(records: DataFrame, *others: str) -> DataFrame:
    text = F.concat(F.coalesce("cause", F.lit("")), F.lit(" "), F.coalesce("symptoms", F.lit("")))
    return records.select("data_id", F.lit(0).cast("long").alias("chunk_id"), text.alias("text"), *others)


def confusable_pairs(records: DataFrame, cut: float = CONFUSABLE, block_records: int = BLOCK_ROWS) -> DataFrame:
    """All pairs of records with a TF-IDF cosine above ``cut``: (a, b, similarity), a < b.

    Records meet where they share a gram of their prefixes (see ``pairs``). Records without an id are left out; rows that repeat an id
    are compared one by one and not with each other."""
    return similar_pairs(plain_chunks(records.where("data_id is not null")), cut, block_records)


def self_lists(records: DataFrame, k: int = 3, block_records: int = BLOCK_ROWS) -> DataFrame:
    """Top lists of every record's own text as a query: its symptoms, or its name if it has none.

    Lists are filled up to k with records of no similarity, the lowest data_id first, so a blank record has a list, too. Records without an id
    are left out; ids must be distinct."""
    return _compared(records, k, None, block_records)[0]


def _compared(records: DataFrame, k: int, cut: float | None, block_records: int) -> tuple[DataFrame, DataFrame | None]:
    """The lists of ``self_lists``, and with ``cut`` one row (n, total), the number of ``confusable_pairs`` and the sum of their similarities: from one
    comparison of all records if a task can hold the vocabulary, and for pairs if no record is blank, since those count there as texts and here not."""
    known = records.where("data_id is not null")
    text = F.when(F.coalesce("cause", F.lit("")) == "", F.col("symptoms")).otherwise(F.col("cause"))
    asked = known.select("data_id", F.lit(0).cast("long").alias("chunk_id"), F.coalesce(text, F.lit("")).alias("text"))
    corpus, pairs = row_combined(known), None
    _, weights = tfidf_model(corpus)
    together = cut is not None and weights is not None and corpus.count() == known.count()
    if weights is None:
        found = materialise(nearest(asked, corpus, k, block_records))
    else:
        rows = plain_chunks(known.withColumn("own", text), "own").drop("chunk_id")
        found, pairs = compared(rows, weights, k, cut if together else None, block_records)
    if cut is not None and not together:
        pairs = confusable_pairs(records, cut, block_records).agg(F.count(F.lit(1)).alias("n"), F.sum("similarity").alias("total"))
    return top_k(max_pool(pad_zeros(found, asked.select(F.col("data_id").alias("query_id")), corpus, k)), k), pairs


def self_retrieval_failures(lists: DataFrame) -> DataFrame:
    """Records that do not come first in their own list."""
    return lists.where("rank = 1 and data_id <> query_id").select(F.col("query_id").alias("data_id"), F.col("data_id").alias("found"))


def magnets(lists: DataFrame, records: DataFrame) -> DataFrame:
    """Records in more lists than a quarter of all records, and more than three."""
    size = F.broadcast(records.agg(F.count(F.lit(1)).alias("records")))
    seen = lists.groupBy("data_id").agg(F.count(F.lit(1)).alias("n")).crossJoin(size)
    return seen.where(F.col("n") > F.greatest(F.lit(3.0), 0.25 * F.col("records"))).select("data_id", "n")


def health_report(records: DataFrame, synonyms: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """(check, data_id, other_id, value) of all checks; thin records, pairs and self-retrieval failures are issues. The chunks that
    each way of cutting makes are reported as ``chunks:`` and its name, without a record."""
    lists = materialise(self_lists(records))
    none = F.lit(None).cast("long")

    def rows(df, check, data_id, other, value):
        return df.select(F.lit(check).alias("check"), data_id.alias("data_id"), other.alias("other_id"), value.cast("double").alias("value"))

    parts = [
        rows(thin_records(records), "thin", F.col("data_id"), none, F.col("chars")),
        rows(few_phrases(records), "few_phrases", F.col("data_id"), none, F.col("phrases")),
        rows(confusable_pairs(records), "confusable", F.col("a"), F.col("b"), F.col("similarity")),
        rows(self_retrieval_failures(lists), "self_retrieval", F.col("data_id"), F.col("found"), F.lit(1.0)),
        rows(magnets(lists, records), "magnet", F.col("data_id"), none, F.col("n")),
        describe_chunks(records, synonyms).select(F.concat(F.lit("chunks:"), "strategy").alias("check"), none.alias("data_id"), none.alias("other_id"), F.col("chunks").cast("double").alias("value")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def health_counts(records: DataFrame, synonyms: list[tuple[str, list[str]]] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """(check, n, total): how many rows ``health_report`` has of each check, and the sum of their values; of ``only`` these checks, if given. Pairs are
    counted where they are found, by the comparison that gives the lists."""
    lists, pairs = _compared(records, 3, CONFUSABLE, BLOCK_ROWS)
    lists = materialise(lists)

    def count(check, df, value):
        return df.groupBy(check.alias("check")).agg(F.count(F.lit(1)).alias("n"), F.sum(value.cast("double")).alias("total"))

    parts = {
        "thin": lambda: count(F.lit("thin"), thin_records(records), F.col("chars")),
        "few_phrases": lambda: count(F.lit("few_phrases"), few_phrases(records), F.col("phrases")),
        "confusable": lambda: pairs.where("n > 0").select(F.lit("confusable").alias("check"), "n", "total"),
        "self_retrieval": lambda: count(F.lit("self_retrieval"), self_retrieval_failures(lists), F.lit(1)),
        "magnet": lambda: count(F.lit("magnet"), magnets(lists, records), F.col("n")),
        "chunks": lambda: count(F.concat(F.lit("chunks:"), "strategy"), describe_chunks(records, synonyms), F.col("chunks")),
    }
    every = None
    for check in only or parts:
        part = parts[check]()
        every = part if every is None else every.unionByName(part)
    return every


ISSUES = ("thin", "confusable", "self_retrieval")


def issue_total(report: DataFrame) -> DataFrame:
    return report.agg(F.count_if(F.col("check").isin(*ISSUES)).alias("issues"))


def issue_count(records: DataFrame) -> DataFrame:
    """``issue_total`` of the records' report, without its rows."""
    return health_counts(records, only=ISSUES).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("issues"))
