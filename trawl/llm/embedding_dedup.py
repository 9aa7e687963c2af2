"""Embedding near-dedup over an inverted multi-index.

Unit vectors are halved and each half has a codebook of its own; pairs of codes form a product grid of cells.
A vector lives in its own cell and visits others by multi-sequence traversal: both halves' codes are sorted by how far the half
would have to move to get there, and pairs of them are taken off a heap, nearest first, until the target recall is met. For a recall of
1 that is where the next cell lies farther than a linked vector can be, so that links and their counts are exact; for
less, it is the share of that distance within which such a part of simulated partners is found. Every pair that meets is verified in
double precision, and a link counts at both ends though it was met from one.

Equal vectors are one vector with a multiplicity. Vectors travel once for each row of the grid that they visit; a grid
row with many vectors is dealt in blocks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.ids import is_long
from trawl.llm.common import Forest, connected_components, dealt, joined_batches, materialise, numpy_groups, release, ship_package, table

SIMILARITY = 0.98
RECALL = 1.0
SAMPLE = 20_000
CELL_ROWS = 48
BLOCK = 4_096


def codebook(points: np.ndarray, k: int, turns: int = 12, seed: int = 7) -> np.ndarray:
    """k-means centres of the sampled half vectors."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(points)))
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(turns):
        own = (((centres**2).sum(1)) - 2 * points @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def to_boundary(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The own code of every point, and how far it must move at least to get any other code."""
    far = (points**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * points @ centres.T
    own = far.argmin(1)
    apart = np.sqrt(np.maximum((centres**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * centres @ centres.T, 0))
    gap = far - far[np.arange(len(points)), own][:, None]
    return own, np.maximum(gap, 0) / np.maximum(2 * apart[own], 1e-12)


def _units(column: pa.Array) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    """Rows that can link, and their unit vectors, by row."""
    rows, vectors = [], []
    for i, v in enumerate(column.to_pylist()):
        if v is None or any(x is None for x in v):
            continue
        x = np.array(v, np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            scale = np.abs(x).max() if len(x) else 0.0
            if not np.isfinite(x).all() or not scale > 0:
                continue
            x = x / scale
            rows.append(i)
            vectors.append(x / np.sqrt(x @ x))
    return rows, vectors


def traverse(first: np.ndarray, second: np.ndarray, limit: float):
    """Multi-sequence traversal: pairs (i, j, distance) of codes in the order of first[i] + second[j], up to ``limit``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap = [(x[0] + y[0], 0, 0)]
    while heap and heap[0][0] <= limit:
        far, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j]), far
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))


def reach_for(recall: float, units: np.ndarray, books, similarity: float, seed: int = 11) -> float:
    """The share of a link's greatest distance within which ``recall`` of simulated partners at that similarity have their cell."""
    if recall >= 1 or not len(units):
        return 1.0
    rng = np.random.default_rng(seed)
    x = units[rng.integers(0, len(units), 4_000)]
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    y = similarity * x + (1 - similarity**2) ** 0.5 * side / np.linalg.norm(side, axis=1, keepdims=True)
    half, far = x.shape[1] // 2, np.zeros(len(x))
    for book, part in zip(books, (slice(0, half), slice(half, None)), strict=True):
        move, there = to_boundary(x[:, part], book)[1], to_boundary(y[:, part], book)[0]
        far += move[np.arange(len(x)), there] ** 2
    return float(min(1.0, np.quantile(np.sqrt(far / (2 - 2 * similarity)), recall)))


_PLACED = "rid long, vec_id long, label long, dim int, code int, cell int, visits array<struct<code:int,cells:array<int>>>, unit binary"


def _place(books, similarity: float):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            rows, vectors = _units(batch.column("embedding"))
            dim, code, cell = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
            visits: list = [None] * n
            unit: list = [None] * n
            for d in {len(v) for v in vectors}:
                at = [k for k, v in enumerate(vectors) if len(v) == d]
                x = np.stack([vectors[k] for k in at])
                first, second, reach = books.value.get(d) or (np.zeros((1, d // 2)), np.zeros((1, d - d // 2)), 1.0)
                limit = reach**2 * (2 - 2 * similarity) + 1e-9  # beyond rounding
                own1, move1 = to_boundary(x[:, : d // 2], first)
                own2, move2 = to_boundary(x[:, d // 2 :], second)
                move1, move2 = move1**2, move2**2
                for k, i in enumerate(np.array(rows)[at]):
                    found: dict[int, list[int]] = {}
                    for one, two, _ in traverse(move1[k], move2[k], limit):
                        found.setdefault(one, []).append(two)
                    dim[i], code[i], cell[i] = d, own1[k], own2[k]
                    visits[i] = [{"code": one, "cells": cells} for one, cells in found.items()]
                    unit[i] = x[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("rid", "vec_id", "label")],
                    *[pa.array(c, pa.int32()) for c in (dim, code, cell)],
                    pa.array(visits, pa.list_(pa.struct([("code", pa.int32()), ("cells", pa.list_(pa.int32()))]))),
                    pa.array(unit, pa.binary()),
                ],
                ["rid", "vec_id", "label", "dim", "code", "cell", "visits", "unit"],
            )

    return run


def _meet(similarity: float, one_sided: bool):
    """Verifies a block: rows (rid, other, n) with the number of links of a visitor, and links that join what was apart. If not all
    visits are returned (``one_sided``), a home also counts the visitors whose cell it does not visit itself."""

    def run(batches):
        for group in numpy_groups(batches, ["block"]):
            is_home = group["home"].astype(bool)
            homes, guests = group["rid"][is_home], group["rid"][~is_home]
            if not len(homes) or not len(guests):
                continue
            x, y = (np.frombuffer(b"".join(group["unit"][side].tolist()), np.float64).reshape(int(side.sum()), -1) for side in (is_home, ~is_home))
            home_copies, guest_copies = group["copies"][is_home], group["copies"][~is_home]
            cells, visited = group["cell"][is_home], group["cells"][~is_home]
            returned = [set(v.tolist()) for v in group["cells"][is_home]] if one_sided else None
            spots = (group["code"][~is_home].astype(np.int64) * (1 << 31) + group["cell"][~is_home]).tolist()
            guest = np.repeat(np.arange(len(guests)), [len(v) for v in visited])
            to = np.concatenate([*visited, np.zeros(0, np.int32)])
            order = np.argsort(to, kind="stable")
            guest, to = guest[order], to[order]
            counts, extra, forest, edges = np.zeros(len(guests), np.int64), np.zeros(len(homes), np.int64), Forest(), []
            for cell in np.unique(cells):
                here, there = np.flatnonzero(cells == cell), guest[np.searchsorted(to, cell) : np.searchsorted(to, cell, side="right")]
                roots = np.array([forest.root(r) for r in homes[here].tolist()])
                for start in range(0, len(there), 1024):
                    part = there[start : start + 1024]
                    linked = y[part] @ x[here].T >= similarity
                    linked |= guests[part][:, None] == homes[here]  # a vector meets itself whatever rounding does
                    counts[part] += linked @ home_copies[here]
                    others = linked & (guests[part][:, None] != homes[here])
                    for at in np.flatnonzero(others.any(axis=1)).tolist():
                        k, hits = int(part[at]), np.flatnonzero(others[at])
                        if one_sided:
                            for h in here[hits].tolist():
                                if spots[k] not in returned[h]:
                                    extra[h] += guest_copies[k]
                        _, one = np.unique(roots[hits], return_index=True)
                        for h in hits[one].tolist():
                            if forest.join(int(homes[here[h]]), int(guests[k])):
                                edges.append((int(homes[here[h]]), int(guests[k])))
                        roots[np.isin(roots, roots[hits])] = forest.root(int(guests[k]))
            more = np.flatnonzero(extra)
            rid = np.concatenate([guests, homes[more], np.array([a for a, _ in edges], np.int64)])
            other = np.concatenate([np.full(len(guests) + len(more), -1), np.array([b for _, b in edges], np.int64)])
            n = np.concatenate([counts, extra[more], np.zeros(len(edges), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (rid, other, n)], ["rid", "other", "n"])

    return lambda batches: joined_batches(run(batches))


def near_vectors(rows: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of ``rows`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths are equal (labels that are no integers by 64 bits of hash), and their cosine in double
    precision is ``similarity`` or more. A vector that is null, empty, zero or holds a null or a non-finite
    component links with nothing, and is its own component. component_id is the smallest vec_id that links reach;
    rows that repeat a vector link with each other. With a ``recall`` of 1 no link is missed. The codebooks come from about ``sample``
    vectors, drawn by a hash of their ids; their size grows with the rows of a label and has no bound, and the index holds every row. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    ship_package(spark)
    label = F.col("label").cast("long") if is_long(rows, "label") else F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    known = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", label.alias("label"))
    able = known.where("label is not null and embedding is not null")
    size = able.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    n = size["n"]
    codes = max(1, round((n / max(size["labels"], 1) / cell_rows) ** 0.5))
    draw = F.pmod(F.xxhash64(F.lit("codebook"), "vec_id"), F.lit(1 << 30))
    wanted = max(sample, 4 * codes)
    drawn = able.where(draw < int(min(1.0, wanted / max(n, 1)) * (1 << 30))).orderBy(draw, "vec_id").limit(2 * wanted).select("embedding")
    _, drawn = _units(pa.array([r["embedding"] for r in drawn.collect()], pa.list_(pa.float64())))
    books = {}
    for d in {len(v) for v in drawn}:
        x = np.stack([v for v in drawn if len(v) == d])
        pair = codebook(x[:, : d // 2], codes), codebook(x[:, d // 2 :], codes, seed=8)
        books[d] = *pair, reach_for(recall, x, pair, similarity)
    books = spark.sparkContext.broadcast(books)  # a few times the square root of the rows
    placed = materialise(known.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_place(books, similarity), _PLACED))
    able = placed.where("unit is not null and label is not null")

    same = ["label", "dim", "unit"]
    classes = materialise(able.groupBy(*same).agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies")))
    heads = able.drop("unit").join(classes.select("rid", "copies", "unit"), "rid")
    heads = materialise(heads.select("rid", "copies", "label", "dim", "code", "cell", "visits", "unit"))
    key = ["label", "dim", "row"]
    one_sided = recall < 1
    spot = lambda v: F.transform(v["cells"], lambda c: v["code"].cast("long") * (1 << 31) + c)
    own = F.flatten(F.transform("visits", spot)) if one_sided else F.array().cast("array<long>")
    homes = heads.select(F.lit(True).alias("home"), "rid", "copies", "label", "dim", F.col("code").alias("row"), "code", "cell", own.alias("cells"), "unit")
    guests = heads.withColumn("v", F.explode("visits"))
    cells = F.transform(F.col("v.cells"), lambda c: c.cast("long"))
    guests = guests.select(F.lit(False).alias("home"), "rid", "copies", "label", "dim", F.col("v.code").alias("row"), "code", "cell", cells.alias("cells"), "unit")
    blocks = lambda c: F.ceil(F.count(F.lit(1)) / block).cast("int").alias(c)
    sizes = materialise(homes.groupBy(*key).agg(blocks("home_blocks")).join(guests.groupBy(*key).agg(blocks("guest_blocks")), key))
    part = lambda c: F.pmod(F.xxhash64("rid"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))

    def blocked(df, home):
        df = df.join(sizes, key)
        df = df.withColumn("p", part("home_blocks") if home else every("home_blocks")).withColumn("q", every("guest_blocks") if home else part("guest_blocks"))
        return df.select(F.concat_ws("/", *key, "p", "q").alias("block"), "home", "rid", "copies", "code", "cell", "cells", "unit")

    meetings = dealt(blocked(homes, True).unionByName(blocked(guests, False)), n, 20_000, "block")
    found = materialise(meetings.mapInArrow(_meet(similarity, one_sided), "rid long, other long, n long"))
    counts = found.where("other < 0").groupBy("rid").agg((F.sum("n") - 1).alias("n_links"))  # each meets itself once
    linked = materialise(connected_components(found.where("other >= 0").select(F.col("rid").alias("a"), F.col("other").alias("b"))))
    of_head = counts.join(linked.withColumnRenamed("node", "rid"), "rid", "left").select("rid", "n_links", F.coalesce("component", "rid").alias("component"))
    of_head = materialise(of_head)
    twins = classes.where("copies > 1").select(*same, F.col("rid").alias("head"))
    headed = placed.join(twins, same, "left").select("rid", "vec_id", F.coalesce("head", "rid").alias("head"))
    all_ = headed.join(of_head.withColumnRenamed("rid", "head"), "head", "left")
    all_ = materialise(all_.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "head").alias("component")))
    lowest = all_.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    release(placed, classes, heads, sizes, found, linked, of_head)
    return all_.join(lowest, "component").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_embedding_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), g AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY 1),
n AS (SELECT x AS vec_id, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM g LEFT JOIN n USING (vec_id)
"""
