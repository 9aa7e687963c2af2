"""Readers and writers. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.text import is_blank, strip

RECORD_FIELDS = "disease string, symptoms string, cause string, diagnosis string, treatment string"
TESTSET = "query string, expected_data_id string, category string, note string"
REGRESSION = "query string, expected_disease_contains string, note string"


def read_records_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files with a JSON array of records or a single one each, under honest or stored names."""
    return spark.read.schema(RECORD_FIELDS).option("multiLine", True).json(path)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_records_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records with a header; quoted commas, line breaks and a byte-order mark are understood."""
    return _csv(spark, path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("data_id long, symptoms string, cause string, diagnosis string, treatment string").parquet(path)


def read_records_jdbc(spark: SparkSession, url: str, lower: int | None = None, upper: int | None = None, parts: int = 8, table: str = "vet_doc", properties: dict[str, str] | None = None) -> DataFrame:
    """Records of a database, read in ranges of their key; conditions on columns are put to the database. Bounds that are not given are asked for
    there, one row, and only set where the ranges are cut: no record is left out. A table without records is one range."""
    options = properties or {}
    if lower is None or upper is None:
        key = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier("data_id")
        ends = spark.read.jdbc(url, f"(SELECT min({key}) AS low, max({key}) AS high FROM {table}) ends", properties=options).first()
        found = {k.lower(): v for k, v in ends.asDict().items()}
        lower, upper = (given if given is not None else end for given, end in ((lower, found["low"]), (upper, found["high"])))
    if lower is None or lower == upper:
        return spark.read.jdbc(url, table, properties=options)
    return spark.read.jdbc(url, table, column="data_id", lowerBound=int(lower), upperBound=int(upper) + 1, numPartitions=parts, properties=options)


def read_testset_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path).where(~is_blank(F.col("query")))
    return rows.withColumn("expected_data_id", F.col("expected_data_id").cast("long"))


def read_regression_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path).where(~is_blank(F.col("query")))
    return rows.select(*[strip(F.col(c)).alias(c) for c in ("query", "expected_disease_contains", "note")])


def read_synonyms(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(term, variants) in the file's order; keys that begin with ``_`` are comments; a missing file has none.

    A hand-kept list: it is small and parameterises expressions, so it is read on the driver."""
    from pyspark.errors import AnalysisException

    try:
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    except AnalysisException:
        return []
    rows = whole.select(F.posexplode(F.map_entries("m")).alias("ord", "e"))
    rows = rows.where(~F.col("e.key").startswith("_")).select("ord", "e.key", F.from_json("e.value", "array<string>").alias("variants"))
    return [(r["key"], list(r["variants"])) for r in rows.orderBy("ord").collect()]


def synonym_table(spark: SparkSession, synonyms: list[tuple[str, list[str]]]) -> DataFrame:
    rows = [(i, term, j, v) for i, (term, variants) in enumerate(synonyms) for j, v in enumerate(variants)]
    return spark.createDataFrame(rows, "ord int, term string, variant_ord int, variant string")


def write_testset(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_results(results: DataFrame, failures: DataFrame, path: str, run_id: str) -> None:
    """The latest results and failures, and a copy of each under its run, in the place of what the run has written before."""
    for name, rows in (("results", results), ("failures", failures)):
        rows.write.mode("overwrite").parquet(f"{path}/latest_{name}")
        own = rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        own.partitionBy("run_id").parquet(f"{path}/{name}")


def append_seed(records: DataFrame, path: str) -> None:
    """Mirror new records into the seed table under stored names."""
    records.select("symptoms", "cause", "diagnosis", "treatment").write.mode("append").parquet(path)


def seed_if_empty(records: DataFrame | None, seed: DataFrame, reseed: bool = False) -> DataFrame:
    """The records, or the seed numbered from 1 if there are none or a reseed is asked for; ``seed`` has ``pos``."""
    from trawl.operators.ingest import assign_ids

    if records is not None and not reseed and not records.isEmpty():
        return records
    return assign_ids(seed, 0).select("data_id", "symptoms", "cause", "diagnosis", "treatment")
