"""An embedding cache keyed by (model, hash of the text), in a table or in a store of versions, and encoders that users plug in.

A store keeps a bucketed folder for each model. An upsert writes new folders for the models that it touches, shares the others, and
is committed at the end; who reads meanwhile, or after a write that failed, reads the version before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.functions import versions
from trawl.functions.buckets import bucketed_table
from trawl.functions.scratch import materialise, ship_package, spread_small
from trawl.functions.text import blank_to_space, text_hash

Encoder = Callable[[list[str]], np.ndarray]
ENCODERS: dict[str, Encoder] = {}
BATCH = 128
KEY = ["model", "text_hash"]
CACHE = "model string, text_hash string, dim int, vector array<float>, created_at timestamp"
BUCKETS = 64
EMPTY = {"models": {}, "buckets": BUCKETS}


def register_encoder(name: str, encode: Encoder) -> None:
    """``encode`` turns a list of texts into one vector a row."""
    ENCODERS[name] = encode


def hashed(texts: DataFrame) -> DataFrame:
    return texts.withColumn("text_hash", text_hash(F.col("text")))


def cache_lookup(cache: DataFrame, model: str, texts: DataFrame) -> DataFrame:
    """All texts, with the vectors that the cache has."""
    own = cache.where(F.col("model") == model).select("text_hash", "vector")
    return hashed(texts).join(own, "text_hash", "left")


def cache_missing(cache: DataFrame, model: str, texts: DataFrame) -> DataFrame:
    """Texts that are not cached, each once."""
    own = cache.where(F.col("model") == model).select("text_hash")
    return hashed(texts).join(own, "text_hash", "left_anti").dropDuplicates(["text_hash"])


def newest(rows: DataFrame) -> DataFrame:
    """One row a key: the last created, and of those the greatest."""
    rest = [c for c in rows.columns if c not in KEY]
    order = sorted(rest, key=lambda c: c != "created_at")
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*KEY, "row.*").select(rows.columns)


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new rows put in or in the place of rows with their key; of new rows with one key the newest."""
    new = newest(new.select(cache.columns))
    return cache.join(new.select(*KEY), KEY, "left_anti").unionByName(new)


def _model_table(spark: SparkSession, root: str, folder: str, buckets: int) -> str:
    return bucketed_table(spark, f"{root}/{folder}", "text_hash STRING, dim INT, vector ARRAY<FLOAT>, created_at TIMESTAMP", "text_hash", buckets)


def _stored(spark: SparkSession, root: str, held: dict) -> DataFrame:
    every = spark.createDataFrame([], CACHE)
    for model, folder in sorted(held["models"].items()):
        own = spark.table(_model_table(spark, root, folder, held["buckets"]))
        every = every.unionByName(own.withColumn("model", F.lit(model)).select(every.columns))
    return every


def stored_cache(spark: SparkSession, root: str) -> DataFrame:
    """The cache in the store under ``root`` as its last version has it; empty where there is none."""
    return _stored(spark, root, versions.state(spark, root, EMPTY)[1])


def upsert_stored(root: str, new: DataFrame, buckets: int = BUCKETS, tries: int = 3) -> int:
    """Upsert new rows (see CACHE) into the store: only folders of models that they have are written anew. Returns the version's number.
    Another writer's commit in between is read and written upon."""
    spark = new.sparkSession
    new = materialise(new.select(*spark.createDataFrame([], CACHE).columns))
    models = [r["model"] for r in new.select("model").distinct().collect()]  # a row an encoder

    def write() -> int:
        after, held = versions.state(spark, root, EMPTY | {"buckets": buckets})
        target, folders = versions.new_folder(), dict(held["models"])
        for i, model in enumerate(sorted(models)):
            old = _stored(spark, root, held | {"models": {m: f for m, f in folders.items() if m == model}})
            merged = cache_upsert(old, new.where(F.col("model") == model)).select("text_hash", "dim", "vector", "created_at")
            folders[model] = f"{target}/m{i}"
            merged.repartition(held["buckets"], "text_hash").write.insertInto(_model_table(spark, root, folders[model], held["buckets"]))
        return versions.commit_state(spark, root, after, target, held | {"models": folders})

    return versions.retried(write, tries)


def clear_stored(spark: SparkSession, root: str, model: str | None = None) -> int:
    """Take a model, or all, out of the store; returns the rows that went. Files stay for who still reads older versions."""
    after, held = versions.state(spark, root, EMPTY)
    left = {m: f for m, f in held["models"].items() if model is not None and m != model}
    gone = _stored(spark, root, held | {"models": {m: f for m, f in held["models"].items() if m not in left}}).count()
    versions.commit_state(spark, root, after, versions.new_folder(), held | {"models": left})
    return gone


def encode(texts: DataFrame, encoder: Encoder, batch: int = BATCH) -> DataFrame:
    """Adds ``vector``, unit vectors of the encoder; blank texts go in as one space."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for start in range(0, len(pdf), batch):
                v = np.asarray(encoder(pdf["encoded_text"].iloc[start : start + batch].tolist()), np.float64)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                out += (v / np.where(norm == 0, 1, norm)).astype(np.float32).tolist()
            yield pdf.drop(columns="encoded_text").assign(vector=out)

    rows = spread_small(texts.withColumn("encoded_text", blank_to_space(F.col("text"))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return rows.mapInPandas(run, f"{schema}, vector array<float>")


def encode_with_cache(cache: DataFrame, model: str, texts: DataFrame, encoder: Encoder) -> tuple[DataFrame, DataFrame]:
    """(texts with vectors, rows to upsert). Only texts that are missing are encoded, each once."""
    return fill(cache, model, texts, lambda rows: encode(rows, encoder))


def fill(cache: DataFrame, model: str, texts: DataFrame, add_vectors: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``encode_with_cache`` for a function that adds vectors to a table of texts."""
    new = add_vectors(cache_missing(cache, model, texts).select("text_hash", "text"))
    new = new.select(F.lit(model).alias("model"), "text_hash", F.size("vector").alias("dim"), "vector", F.current_timestamp().alias("created_at"))
    known = cache_lookup(cache, model, texts)
    fresh = new.select("text_hash", F.col("vector").alias("new_vector"))
    filled = known.join(fresh, "text_hash", "left").withColumn("vector", F.coalesce("vector", "new_vector")).drop("new_vector")
    return filled, new


def encode_counts(cache: DataFrame, model: str, texts: DataFrame) -> DataFrame:
    """One row: how many input rows the cache serves and how many are embedded, repeats of a text each counted."""
    found = cache_lookup(cache, model, texts)
    return found.agg(F.count_if(F.col("vector").isNotNull()).alias("n_from_cache"), F.count_if(F.col("vector").isNull()).alias("n_embedded"))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def cache_clear(cache: DataFrame, model: str | None = None) -> tuple[DataFrame, int]:
    """(what is left, rows removed)."""
    gone = cache if model is None else cache.where(F.col("model") == model)
    left = cache.limit(0) if model is None else cache.where(F.col("model") != model)
    return left, gone.count()


def latest(cache: DataFrame) -> DataFrame:
    """One row a key, the newest, for caches that were appended to."""
    order = Window.partitionBy("model", "text_hash").orderBy(F.desc("created_at"))
    return cache.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
