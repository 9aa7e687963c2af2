"""Cutting records into searchable chunks.

A record is (data_id, symptoms, cause, diagnosis, treatment) under its stored, shifted names: ``symptoms`` is the
disease's name and ``cause`` its symptom list. A chunk is (data_id, chunk_id, text, kind).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.scratch import spread_small
from trawl.functions.text import split_phrases, strip

BROADCAST_TERMS = 100_000


def _whole(records: DataFrame, text, kind: str) -> DataFrame:
    return records.select("data_id", F.lit(0).cast("long").alias("chunk_id"), text.alias("text"), F.lit(kind).alias("kind")).where("text <> ''")


def row_symptom_only(records: DataFrame) -> DataFrame:
    return _whole(records, strip(F.col("cause")), "symptom_only")


def _combined():
    return strip(F.concat(strip(F.col("cause")), F.lit(" "), strip(F.col("symptoms"))))


def row_combined(records: DataFrame) -> DataFrame:
    return _whole(records, _combined(), "combined")


def row_full(records: DataFrame) -> DataFrame:
    fields = [strip(F.col(c)) for c in ("cause", "symptoms", "diagnosis", "treatment")]
    return _whole(records, strip(F.concat_ws(" ", *fields)), "full")


def _with_row(records: DataFrame, phrases) -> DataFrame:
    """Phrases of a record in order, then its whole row; all within the record, so nothing is shuffled but the records of a small table."""
    kind = lambda k: (lambda t: F.struct(t.alias("text"), F.lit(k).alias("kind")))
    row = F.filter(F.array(_combined()), lambda t: t != "")
    chunks = F.concat(F.transform(phrases, kind("phrase")), F.transform(row, kind("row")))
    chunked = spread_small(records).select("data_id", F.posexplode(chunks).alias("chunk_id", "chunk"))
    return chunked.select("data_id", F.col("chunk_id").cast("long").alias("chunk_id"), "chunk.text", "chunk.kind")


def per_symptom(records: DataFrame) -> DataFrame:
    return _with_row(records, split_phrases(F.col("cause")))


def expand_phrases(phrases: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Adds to phrases (…, phrase) their rewordings: rows (…, ord, variant_ord, variant). The phrase itself comes first;
    each other row replaces all occurrences of one term by one variant, always in the phrase as it was. Up to BROADCAST_TERMS rewordings are
    broadcast; of more, the planner chooses how they meet the phrases."""
    few = synonyms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    terms = F.broadcast(synonyms) if few else synonyms
    reworded = phrases.join(terms, F.contains("phrase", "term")).withColumn("text", F.replace("phrase", "term", "variant"))
    keep = phrases.columns
    own = phrases.select(*keep, F.lit(-1).alias("ord"), F.lit(0).alias("variant_ord"), F.col("phrase").alias("variant"))
    return own.unionByName(reworded.select(*keep, "ord", "variant_ord", F.col("text").alias("variant")))


def per_symptom_expanded(records: DataFrame, synonyms: list[tuple[str, list[str]]]) -> DataFrame:
    """As ``per_symptom`` with every phrase's rewordings, each text once a record. The synonyms are a short ordered list, so
    rewording happens inside the record."""

    def reword(phrase):
        lists = [F.array(phrase)]
        for term, variants in synonyms:
            some = F.array(*[F.replace(phrase, F.lit(term), F.lit(v)) for v in variants]) if variants else F.array().cast("array<string>")
            lists.append(F.when(F.contains(phrase, F.lit(term)), some).otherwise(F.array().cast("array<string>")))
        return F.concat(*lists)

    return _with_row(records, F.array_distinct(F.flatten(F.transform(split_phrases(F.col("cause")), reword))))


def strategies(synonyms: list[tuple[str, list[str]]]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    return {
        "row_symptom_only": row_symptom_only,
        "row_combined": row_combined,
        "row_full": row_full,
        "per_symptom": per_symptom,
        "per_symptom_expanded": lambda records: per_symptom_expanded(records, synonyms),
    }


def build_chunks(records: DataFrame, strategy: str = "row_combined", synonyms: list[tuple[str, list[str]]] = ()) -> DataFrame:
    known = strategies(synonyms)
    if strategy not in known:
        raise ValueError(f"unknown chunking strategy {strategy!r}; known are {sorted(known)}")
    return known[strategy](records)


def describe_chunks(records: DataFrame, synonyms: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """Number and lengths of the chunks that every strategy makes."""
    every = None
    for name, make in strategies(synonyms).items():
        own = make(records).select(F.lit(name).alias("strategy"), F.char_length("text").alias("chars"))
        every = own if every is None else every.unionByName(own)
    found = every.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("chunks"), F.avg("chars").alias("avg"), F.min("chars").alias("min"), F.max("chars").alias("max")
    )
    names = records.sparkSession.createDataFrame([(n,) for n in strategies(synonyms)], "strategy string")
    size = records.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("records"))
    zero = lambda c, d: F.coalesce(c, F.lit(d))
    return names.join(found, "strategy", "left").crossJoin(F.broadcast(size)).select(
        "strategy",
        zero(F.col("chunks"), 0).cast("long").alias("chunks"),
        F.round(zero(F.col("chunks"), 0) / F.col("records"), 2).alias("chunks_per_row"),
        F.round(zero(F.col("avg"), 0.0), 1).alias("avg_chars"),
        zero(F.col("min"), 0).cast("long").alias("min_chars"),
        zero(F.col("max"), 0).cast("long").alias("max_chars"),
    )
