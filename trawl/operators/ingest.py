"""Incremental ingestion of records: shape and field checks, duplicates, ids that are never used again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.functions import versions
from trawl.functions.ids import assign_ids as assign_ids
from trawl.functions.scratch import materialise
from trawl.functions.text import strip
from trawl.operators.search import record_chunks, tfidf_search, to_honest_names, to_raw_names

FIELDS = ("disease", "symptoms", "cause", "treatment")
REQUIRED = ("disease", "symptoms")
RECORDS = "data_id long, symptoms string, cause string, diagnosis string, treatment string"
NOTHING = {"high_water": 0, "folders": [], "deleted": []}


def normalize_records(rows: DataFrame) -> DataFrame:
    """Honest fields, stripped, blank where they are missing.

    A row is in stored names if it has no ``disease``: there, ``symptoms`` is the name, ``cause`` the
    symptoms and ``diagnosis`` the cause. Whole rows are told apart, so that no field is taken for another."""
    has = set(rows.columns)
    field = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
    raw = field("disease").isNull()
    pick = {
        "disease": F.when(raw, field("symptoms")).otherwise(field("disease")),
        "symptoms": F.when(raw, field("cause")).otherwise(field("symptoms")),
        "cause": F.when(raw, field("diagnosis")).otherwise(field("cause")),
        "treatment": field("treatment"),
    }
    rest = [c for c in rows.columns if c not in (*FIELDS, "diagnosis")]
    return rows.select(*rest, *[strip(v).alias(k) for k, v in pick.items()])


def split_invalid(rows: DataFrame, failfast: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): required fields must not be blank. With failfast any rejected row aborts the load."""
    bad = F.lit(False)
    for c in REQUIRED:
        bad = bad | (strip(F.col(c)) == "")
    rejected = rows.where(bad)
    if failfast and not rejected.isEmpty():
        raise ValueError("records lack required fields")
    return rows.where(~bad), rejected


def dedupe_new(rows: DataFrame, existing: DataFrame, allow_duplicates: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new, skipped) of rows with ``pos``: a disease that the table has, or that came before in the batch, is skipped."""
    if allow_duplicates:
        return rows, rows.limit(0)
    known = existing.select(strip(F.col("symptoms")).alias("known")).distinct()
    order = Window.partitionBy("disease").orderBy("pos")
    tagged = rows.join(known, F.col("disease") == F.col("known"), "left").withColumn("turn", F.row_number().over(order))
    fresh = F.col("known").isNull() & (F.col("turn") == 1)
    return tagged.where(fresh).select(rows.columns), tagged.where(~fresh).select(rows.columns)


def preview(rows: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a load would add and skip; nothing is written."""
    valid, _ = split_invalid(normalize_records(rows))
    return dedupe_new(valid, existing)


def _live(spark: SparkSession, root: str, held: dict) -> DataFrame:
    every = spark.createDataFrame([], RECORDS)
    for folder in held["folders"]:
        every = every.unionByName(spark.read.schema(RECORDS).parquet(f"{root}/{folder}"))
    for folder in held["deleted"]:
        every = every.join(spark.read.schema("data_id long").parquet(f"{root}/{folder}"), "data_id", "left_anti")
    return every


def stored_records(spark: SparkSession, root: str) -> DataFrame:
    """The records of the store under ``root``, under stored names, as its last version has them."""
    return _live(spark, root, versions.state(spark, root, NOTHING)[1])


def load_records(root: str, rows: DataFrame, allow_duplicates: bool = False, tries: int = 3) -> DataFrame:
    """Put valid, normalised rows with ``pos`` into the store; returns what was added, under stored names.

    Ids go on from the highest that was ever given, which is kept with the table, so the id of a record that was deleted is not given again. A
    load that another one overtakes is numbered anew behind it; what it wrote before is in no version."""
    spark = rows.sparkSession
    rows = materialise(rows)

    def write() -> DataFrame:
        after, held = versions.state(spark, root, NOTHING)
        new, _ = dedupe_new(rows, _live(spark, root, held), allow_duplicates)
        target = versions.new_folder()
        to_raw_names(assign_ids(new, held["high_water"])).write.parquet(f"{root}/{target}/records")
        added = spark.read.schema(RECORDS).parquet(f"{root}/{target}/records")
        highest = added.agg(F.max("data_id")).first()[0] or held["high_water"]
        versions.commit_state(spark, root, after, target, held | {"high_water": highest, "folders": [*held["folders"], f"{target}/records"]})
        return added

    return versions.retried(write, tries)


def delete_records(root: str, ids: DataFrame, tries: int = 3) -> None:
    """Take records (data_id) out of the store; their ids stay used."""
    spark = ids.sparkSession

    def write() -> None:
        after, held = versions.state(spark, root, NOTHING)
        target = versions.new_folder()
        ids.select(F.col("data_id").cast("long")).distinct().write.parquet(f"{root}/{target}/deleted")
        versions.commit_state(spark, root, after, target, held | {"deleted": [*held["deleted"], f"{target}/deleted"]})

    versions.retried(write, tries)


def verify_self_retrieval(new: DataFrame, records: DataFrame) -> DataFrame:
    """(data_id, passed): each new record's own symptoms must find its disease first."""
    own = to_honest_names(new)
    hits = tfidf_search(own.select(F.col("data_id").alias("query_id"), F.col("symptoms").alias("query")), record_chunks(records), 1)
    found = hits.join(to_honest_names(records).select("data_id", F.col("disease").alias("found")), "data_id")
    return own.join(found.select(F.col("query_id").alias("data_id"), "found"), "data_id", "left").select(
        "data_id", (F.coalesce("found", F.lit("")) == F.col("disease")).alias("passed")
    )
