"""Dense search by blocked matrix products.

Queries and chunks are packed into blocks of vectors where they are read, and written once. Each pair of blocks is a row of their cartesian product
(see ``pairs``), so that no vector is shuffled. A task multiplies two blocks at a time, the products of a slice of its queries at once, and cuts
the lists of a block of queries to k records over all blocks that it is given; the global ranking only meets what is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.scratch import materialise, ship_package, spread_small
from trawl.operators import sparse
from trawl.operators.pairs import SLACK, meetings
from trawl.operators.search import any_ids, max_pool

#: Vectors and numbers of a block at most.
BLOCK_ROWS, BLOCK_NUMBERS = 4_096, 500_000
#: Blocks of a file, since a reader holds all blocks of a file at once.
FILE_BLOCKS = 16
#: Products that a task holds at once.
CELLS = 1_000_000
#: Products of a row that are sorted for a first bound.
FIRST = 512


def _best(pooled: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the n best products of each row, by rounded score and then by id; what is no number comes last."""
    if np.isnan(pooled.sum()):
        pooled = np.where(np.isnan(pooled), -np.inf, pooled)
    some = min(len(ids), max(FIRST, 4 * n))  # the n-th best of these is a bound for all
    least = np.partition(pooled[:, :some], some - n, axis=1)[:, some - n]
    row, at = np.nonzero(pooled >= least[:, None] - SLACK)
    score = np.round(pooled[row, at], 6)
    order = np.lexsort((ids[at], -score, row))
    row, at = row[order], at[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < n
    return row[kept], at[kept]


def _scores(k: int):
    def run(key, queries: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        """The best k records of each query. What is below a query's ``least``, if it has one, may be left out."""
        if not len(queries) or not len(chunks):
            return pd.DataFrame({"query_id": [], "data_id": [], "score": []})
        q = np.stack(queries["vector"].to_numpy()).astype(np.float64)
        order = chunks["data_id"].argsort(kind="stable")
        ids = chunks["data_id"].to_numpy()[order]
        d = np.stack(chunks["vector"].to_numpy()[order]).astype(np.float64)
        heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        own = ids[heads]
        n, rows = min(k, len(own)), max(1, CELLS // len(ids))
        found = []
        for start in range(0, len(q), rows):
            pooled = q[start : start + rows] @ d.T
            if len(own) < len(ids):
                pooled = np.maximum.reduceat(pooled, heads, axis=1)
            near = None
            if "least" in queries:
                near = pooled >= queries["least"].to_numpy()[start : start + rows, None] - SLACK
            if near is None or np.count_nonzero(near) > 2 * n * len(near):
                row, at = _best(pooled, own, n)
            else:
                row, at = np.nonzero(near)
            found.append((queries["query_id"].to_numpy()[start + row], own[at], pooled[row, at]))
        return pd.DataFrame(dict(zip(("query_id", "data_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return run


def _packed(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Vectors (key, vector) in blocks, written; in single precision where nothing is lost by it."""

    def run(batches):
        number = 0
        for batch in batches:
            vectors, at = batch.column("vector"), 0
            sizes = vectors.value_lengths().to_numpy()
            if len(sizes) and (sizes != sizes[0]).any():
                raise ValueError("vectors must be of one length")
            while at < batch.num_rows:
                part = vectors.slice(at, max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(sizes[0], 1))))
                ids, values = batch.column(key).slice(at, len(part)), part.flatten().to_numpy(zero_copy_only=False).astype(float)
                single = values.astype(np.float32)
                values = single if np.array_equal(single, values, equal_nan=True) else values
                columns = [pa.array([(TaskContext.get().partitionId() << 33) + number], pa.int64()), pa.array([values.itemsize], pa.int64())]
                columns += [pa.array([x.tobytes()], pa.binary()) for x in (ids.to_numpy().astype(np.int64), values)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "bytes", "ids", "vectors"])
                at, number = at + len(part), number + 1

    rows = rows.select(F.col(key).cast("long"), F.col("vector").cast("array<double>"))
    rows = rows.repartition(parts) if parts else spread_small(rows)
    return materialise(rows.mapInArrow(run, "block long, bytes long, ids binary, vectors binary"), FILE_BLOCKS)


def _unpacked(batch: pa.RecordBatch, i: int, side: str, key: str) -> pd.DataFrame:
    kind = {4: np.float32, 8: float}[batch.column(side + "bytes")[i].as_py()]
    ids, values = (np.frombuffer(batch.column(side + c)[i].as_buffer(), t) for c, t in (("ids", np.int64), ("vectors", kind)))
    return pd.DataFrame({key: ids, "vector": list(values.astype(float).reshape(len(ids), len(values) // len(ids)))})


def _lists(k: int):
    """The lists of each block of queries over all blocks of chunks that it meets in a task."""
    score = _scores(k)

    def run(batches):
        lists, last = {}, None
        for batch in batches:
            for i in range(batch.num_rows):
                number, asker = batch.column("block")[i].as_py(), batch.column("other_block")[i].as_py()
                if number != last:
                    chunks, last = _unpacked(batch, i, "", "data_id"), number
                queries = _unpacked(batch, i, "other_", "query_id")
                if asker not in lists:
                    lists[asker] = [queries["query_id"].to_numpy(), np.full(len(queries), -np.inf), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
                _, least, held = lists[asker]
                new = score(asker, queries.assign(query_id=np.arange(len(queries)), least=least), chunks)
                if len(new):
                    new["score"] = new["score"].fillna(-np.inf)  # what is no number comes last
                    held = sparse._best(k, *(np.concatenate([h, new[c].to_numpy()]) for h, c in zip(held, ("query_id", "data_id", "score"), strict=True)))
                    heads = np.flatnonzero(np.append(True, held[0][1:] != held[0][:-1]))
                    full = np.diff(np.append(heads, len(held[0]))) >= k
                    least[held[0][heads][full]] = np.minimum.reduceat(held[2], heads)[full]
                    lists[asker][2] = held
        for owner, _, (place, data, scores) in lists.values():
            columns = [pa.array(owner[place], pa.int64()), pa.array(data, pa.int64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "data_id", "score"])

    return run


@any_ids
def dense_search(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Exact inner products of queries (query_id, vector) and chunks (data_id, vector), all of one length, pooled to records. Rows without
    a vector are left out on both sides; products that are no number come last."""
    ship_package(queries.sparkSession)
    queries, chunks = (df.where("vector is not null").toDF(*df.columns) for df in (queries, chunks))  # both may come from one table
    parts = min(queries.sparkSession.sparkContext.defaultParallelism, max(1, -(-queries.count() // BLOCK_ROWS)))  # chunks are read once a part
    met = meetings(_packed(chunks, "data_id"), _packed(queries, "query_id", parts), False)
    pooled = max_pool(met.mapInArrow(_lists(k), "query_id long, data_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "data_id")
    score = F.when(F.col("score") == float("-inf"), float("nan")).otherwise(F.col("score"))
    return pooled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "data_id", "rank", score.alias("score"))
